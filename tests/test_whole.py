"""Queries over whole inputs: nothing after a text's first characters or a table's first rows is left out."""

from __future__ import annotations

from lodestone import queries as q


def test_ngram_centroid_whole(spark, tmp_path):
    de, en = "der und nicht straße ", "the with house river "
    rows = [(i, (de if i % 4 < 2 else en) * 30, "de" if i % 4 < 2 else "en") for i in range(8)]
    rows += [(8, en * 12 + de * 90, "de"), (9, "the ", "en"), (11, None, "en"), (12, "", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.predicted for r in q.ngram_centroid(spark, str(tmp_path)).collect()}
    assert got == {i: lang for i, _, lang in rows[:10]} | {11: None, 12: None}


def test_intent_classify_whole(spark, tmp_path):
    rows = [(1, 0, "user", "token refresh " + " " * 40 + "explain"), (1, 1, "assistant", "explain"), (2, 0, "user", "token" + " " * 40 + "in auth.py")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in q.intent_classify(spark, str(tmp_path)).collect())
    assert got == [(1, 0, "semantic"), (2, 0, "filename")]


def test_living_authority_all(spark, tmp_path):
    rows = [(i, f"part {i}", 1.0) for i in range(700)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.id for r in q.living_authority_filter(spark, str(tmp_path)).collect()}
    assert got == {i for i in range(700) if i == 0 or i % 7 != 4 or i % 9 == 4}
