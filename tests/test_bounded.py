"""The bounded hybrid search: same rows as without its bound, and no text in any exchange."""

from __future__ import annotations

import random
import re

import pytest

from lodestone.plans import planner as P
from lodestone.plans import search as H

WORDS = ["token", "refresh", "session", "guide", "value", "part", "user", "open"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    rows = []
    for i in range(3000):
        path = f"{r.choice(['src', 'tests', 'docs'])}/f{int(r.random() ** 2 * 300)}.py"
        line = r.randrange(5) * 10
        vector = [1.0, r.gauss(0, 1), r.gauss(0, 0.5)] if r.random() < 0.97 else [1.0, 0.0]
        rows.append((i, path, r.choice(["en", "de"]), " ".join(r.choices(WORDS, k=r.randrange(9))), line, line + 9, vector))
    rows += [(3000 + i, *rows[i][1:]) for i in range(60)] + [(4000, None, "en", "token", 1, 2, [1.0, 0.0, 0.0]), (4001, "src/n.py", "en", None, 1, 2, [1.0, 0.1, 0.0]), (4002, "src/v.py", "en", "token", 1, 2, None)]
    chunks = spark.createDataFrame(rows, "id long, path string, language string, chunk string, start_line int, end_line int, embedding array<double>").repartition(5).cache()
    symbols = spark.createDataFrame([(f"src/f{i}.py", "refreshToken", "refresh token") for i in range(0, 300, 7)], "file string, name string, name_lower string")
    rank = spark.createDataFrame([(f"src/f{i}.py", i / 300) for i in range(300)], "file string, pagerank double")
    return chunks, symbols, rank


def keys(df):
    return sorted((r["rank"], r["id"], round(r["score"], 9), r["chunk"]) for r in df.collect())


@pytest.mark.parametrize("parameters", [{"top_k": 10}, {"top_k": 25, "rank_by": "file"}, {"top_k": 5, "semantic_only": True}, {"top_k": 40, "use_symbol_boost": False}, {"top_k": 2000}])
def test_same_rows_as_without_bound(corpus, monkeypatch, parameters):
    chunks, symbols, rank = corpus
    for graph in (rank, None):
        spec = P.QuerySpec("refresh token session", (1.0, 0.3, 0.1), **parameters)
        bounded = keys(H.hybrid_search(chunks, spec, symbols=symbols, pagerank=graph))
        with monkeypatch.context() as m:
            m.setattr(H, "sure_score", lambda *a, **k: None)
            assert bounded == keys(H.hybrid_search(chunks, spec, symbols=symbols, pagerank=graph))


def test_reranker_gets_texts_of_its_pool(corpus, monkeypatch):
    chunks, symbols, _ = corpus
    seen = []

    def reranker(rows):
        seen.append(sorted(r["id"] for r in rows.filter("chunk IS NOT NULL").collect()))
        return rows.withColumn("score", H.F.length("chunk").cast("double"))

    spec = P.QuerySpec("refresh token", (1.0, 0.3, 0.1), top_k=5, rerank_pool=30)
    bounded = keys(H.hybrid_search(chunks, spec, symbols=symbols, reranker=reranker))
    monkeypatch.setattr(H, "sure_score", lambda *a, **k: None)
    assert bounded == keys(H.hybrid_search(chunks, spec, symbols=symbols, reranker=reranker))
    assert seen[0] == seen[1] and len(seen[0]) == 30


def test_bound_is_sure_and_leaves_most_out(corpus):
    chunks, _, _ = corpus
    rows = H._eligible(chunks, P.QuerySpec("refresh", (1.0, 0.3, 0.1)), None)
    semantic, lexical = H.F.col("semantic_score"), H.T.lexical_score("refresh token", H.F.col("path"), H.F.col("chunk"))
    lower, exact = semantic * 0.8, semantic * 0.8 + lexical * 0.2
    plain, sharp = H.sure_score(rows, lower, 10, 2), H.sure_score(rows, lower, 10, 2, exact)
    assert plain < sharp
    assert rows.filter(exact >= sharp).dropDuplicates(["path", "start_line"]).count() >= 10
    assert rows.filter(lower + 0.2 >= sharp).count() < min(rows.filter(lower + 0.2 >= plain).count(), rows.count() / 2)
    assert H.sure_score(rows, lower, 100_000, 2) is None


def test_no_text_in_any_exchange(corpus, tmp_path):
    cached, symbols, rank = corpus
    cached.write.parquet(f"file://{tmp_path}/chunks")  # the plan of cached rows has their own exchange
    chunks = cached.sparkSession.read.parquet(f"file://{tmp_path}/chunks")
    plan = H.hybrid_search(chunks, P.QuerySpec("refresh token", (1.0, 0.3, 0.1)), symbols=symbols, pagerank=rank)._jdf.queryExecution().explainString(chunks.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) (?:\w*Exchange|TakeOrderedAndProject|Sort|SortAggregate)\b[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert moved and not any(re.search(r"\bchunk#", x) for x in moved)
