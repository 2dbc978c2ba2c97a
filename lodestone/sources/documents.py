"""Text of binary documents: the XML of a DOCX and the text operators of a PDF, read in Arrow batches; plain text by decoding."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A document with less text than this has no text layer.
LEAST_TEXT = 50
_XML = "word/document.xml"


def docx_text(raw: bytes | None) -> str | None:
    """Paragraphs of a DOCX, or None if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
            body = z.read(_XML).decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError):
        return None
    lines = []
    for p in re.findall(r"<w:p[ >].*?</w:p>", body, re.S):
        text = "".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p))
        lines.append(text.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&apos;", "'").replace("&amp;", "&"))
    return "\n".join(lines)


def pdf_text(raw: bytes | None) -> str | None:
    """Text that a PDF shows, a line for each move to another one; None if it isn't a PDF. Streams are read as they are or
    inflated; text in fonts with encodings of their own comes out as its codes say, pictures have none."""
    if not (raw or b"").lstrip().startswith(b"%PDF"):
        return None
    lines = []
    for body in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            shown = []
            for show, move in re.findall(rb"(\[(?:\((?:\\.|[^\\()])*\)|[^\]])*\]\s*TJ|\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\"))|((?:T\*|TD|Td)(?![A-Za-z]))", block, re.S):
                if move and shown and shown[-1] != "\n":
                    shown.append("\n")
                shown += [_pdf_string(x) for x in re.findall(rb"\(((?:\\.|[^\\()])*)\)", show, re.S)]
            if text := "".join(shown).strip():
                lines.append(text)
    return "\n".join(lines)


def _pdf_string(raw: bytes) -> str:
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
    code = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else named.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", code, raw, flags=re.S).decode("latin-1")


READERS = {"docx": docx_text, "pdf": pdf_text}


def extract(files: DataFrame) -> DataFrame:
    """files (path, content): path, text, source, has_text_layer. Lock files (~$...) and unreadable ones have no text; bytes of
    plain text that aren't UTF-8 are replaced. Other types have no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [READERS[k.as_py()](c.as_py()) for c, k in zip(b.column("content"), b.column("ext"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string()), b.column("ext")], ["path", "text", "source"])

    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    real = files.filter(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", "content", ext.alias("ext"))
    office = real.filter(F.col("ext").isin(*READERS)).mapInArrow(read, "path string, text string, source string")
    plain = real.filter(F.col("ext").isin("txt", "md", "rst", "log", "csv", "tsv")).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit("text").alias("source"))
    return office.unionByName(plain).withColumn("has_text_layer", F.coalesce(F.char_length("text") >= F.when(F.col("source") == "text", 1).otherwise(LEAST_TEXT), F.lit(False)))
