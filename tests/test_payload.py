from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from lodestone.plans import payload
from lodestone.sources import documents


def test_snippets_and_json(spark):
    text = "\n".join(f"line {i}" if i != 30 else "the token here" for i in range(60))
    rows = spark.createDataFrame([("a.py", 1, 60, 0.123456, text, 1, None)], "path string, start_line int, end_line int, score double, snippet string, cos int, sym int")
    got = rows.select(payload.snippet(F.col("snippet"), ["token"]).alias("s"), payload.trimmed(F.col("snippet"), ["token"]).alias("t"), payload.explain({"cosine": "cos", "symbol": "sym"}).alias("e")).first()
    assert got.s.split("\n")[3] == "the token here" and len(got.s.split("\n")) == 24
    assert got.t == "⋯\nline 29\nthe token here\nline 31\n⋯" and got.e == "cosine #1"
    one = json.loads(payload.json_lines(payload.compact(rows)).first().value)
    assert one["lines"] == [1, 60] and one["score"] == 0.1235 and one["also"] == []


def test_docx(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>a &lt; b</w:t></w:r></w:p><w:p ><w:t xml:space='preserve'>second</w:t></w:p></w:document>")
    rows = [("x/a.docx", raw.getvalue()), ("x/~$a.docx", b""), ("b.docx", b"no zip"), ("c.md", "é".encode())]
    got = {r.path: (r.text, r.has_text_layer) for r in documents.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"x/a.docx": ("a < b\nsecond", False), "b.docx": (None, False), "c.md": ("é", True)}
