"""Training-data operators over whole inputs, with their whole results."""

from __future__ import annotations

import random

from lodestone.llm import dedup_spans, langid


def test_cut_spans_keeps_texts_and_columns(docs, rows):
    got = dedup_spans.cut_spans(docs).collect()
    plain = lambda found: sorted((tuple(r) for r in found), key=repr)
    assert plain(r[:-2] for r in got) == plain(rows)
    assert got[0].__fields__ == [*docs.columns, "spans", "kept"]
    for r in got:
        raw, out, at = (r.text or "").encode(), b"", 0
        for s in r.spans:
            assert at <= s.begin < s.end
            out, at = out + raw[at : s.begin], s.end
        assert bytes(r.kept) == out + raw[at:]
    assert {r.doc_id for r in got if r.spans} >= {5, 101}


def test_language_dictionaries_from_whole_texts(spark):
    r = random.Random(1)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    rows = [(i, "licence " * 300 + f"{text(3000)} middle {text(3000)} last", "xx") for i in range(3)]
    rows += [(None, f"leer {text(5)}", "de") for _ in range(400)] + [(7, "same text", "en")] * 400
    found = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    made = dict(langid.dictionaries({k: (n, [langid.normalised(t) for t in texts]) for k, (n, texts) in found.items()}))
    assert len(made["xx"]) > 0.98 * langid.DICT_BYTES and made["xx"].count(b"last") == 3
    assert 100 < len(found["de"][1]) < 230 and found["en"] == (400, ["same text"])
    assert langid.fair_share([10, 20, 500], 100) == 70 and langid.fair_share([3, 4], 100) == 4
