"""Importance resampling against plain loops, its tournament trees and checksums by themselves."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm import resample


def features(text: str | None) -> list[int]:
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def plain(docs: list[tuple], target: list[str | None], percent: int = 25) -> list[tuple]:
    corpus, wanted = Counter(k for _, t in docs for k in features(t)), Counter(k for t in target for k in features(t))
    n_corpus, n_wanted = sum(corpus.values()) + 10_000, sum(wanted.values()) + 10_000
    rows = []
    for doc_id, text in docs:
        f = features(text)
        g = [math.floor(1000 * math.log((wanted[k] + 1) * n_corpus / ((corpus[k] + 1) * n_wanted))) for k in f]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    can = sorted((i for i, r in enumerate(rows) if r[1] >= 39), key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0, rows[i][1], rows[i][2]))
    ranks = {i: n + 1 for n, i in enumerate(can[: percent * len(can) // 100])}
    return sorted(((*r, ranks.get(i)) for i, r in enumerate(rows)), key=str)


def taken(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resample(spark, docs, rows, benchmark):
    target = [r["text"] for r in benchmark.collect()]
    assert taken(resample.resample(docs, benchmark)) == plain([(r[0], r[1]) for r in rows], target)
    assert taken(resample.resample(docs, benchmark.limit(0), percent=60)) == plain([(r[0], r[1]) for r in rows], [], 60)


def test_small_ranges_runs_and_trees(spark, docs, rows, benchmark, monkeypatch):
    # Every piece of the machinery many times: ranges of a row or two, runs of five rows, trees of two runs.
    scored = resample.materialise(resample.scores(docs, benchmark), "scored")
    for draws in (0, 1, 7, 30):
        got = resample.ranked_draw(scored, draws, resample.F.col("n_features") >= 39, range_rows=2, run_rows=5, fan_in=2)
        order = sorted((r for r in scored.collect() if r["n_features"] >= 39), key=lambda r: resample._key(r["score"], r["doc_id"], r["n_features"], r["weight"]))
        assert [tuple(r)[:4] for r in got.filter("rank IS NOT NULL").orderBy("rank").collect()] == [tuple(r) for r in order[:draws]]
        assert got.count() == len(rows)


def test_one_score_for_all(spark):
    # One score holds all rows: its range is divided by id, also where ids are null or repeat.
    data = [(None if i % 50 == 0 else i // 2, 41, 5, 9) for i in range(1000)]
    scored = spark.createDataFrame(data, "doc_id long, n_features long, weight long, score long").repartition(6).cache()
    got = resample.ranked_draw(scored, 900, resample.F.col("n_features") >= 39, range_rows=50, run_rows=70, fan_in=3)
    want = sorted(data, key=lambda r: (r[0] is None, r[0] or 0))
    assert [tuple(r)[:4] for r in got.filter("rank IS NOT NULL").orderBy("rank").collect()] == want[:900]
    assert got.filter("rank IS NULL").count() == 100


def test_empty(spark, none, benchmark):
    assert taken(resample.resample(none, benchmark)) == []


def test_drawn_documents(docs, benchmark):
    drawn = resample.drawn_documents(docs, benchmark, percent=50)
    assert drawn.columns == docs.columns
    ids = {r[0] for r in taken(resample.resample(docs, benchmark, percent=50)) if r[4]}
    assert {r["doc_id"] for r in drawn.collect()} == ids


@pytest.mark.parametrize("k", [1, 2, 3, 7, 64])
def test_tournament(k):
    r = random.Random(k)
    runs = [sorted((r.randrange(20), i) for i in range(r.randrange(30))) for _ in range(k)]
    assert [x[0] for x in resample.merge_runs(runs, 4)] == sorted(x[0] for run in runs for x in run)
    assert list(resample.TournamentTree([])) == []


def test_checksums_of_pairs():
    words = [b"a", b"xyz", "größe".encode(), b"w" * 47, b"w" * 48, b"w" * 49, b"v" * 500, b"b"]
    own, pairs = resample._checksums(words, resample._shift_tables())
    assert own.tolist() == [zlib.crc32(w) for w in words]
    assert pairs.tolist()[1:] == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]


def test_long_texts_are_cut_without_loss(monkeypatch):
    r = random.Random(1)
    text = " ".join("abcde"[: r.randrange(1, 5)] * r.randrange(1, 9) for _ in range(2000))
    whole = Counter(b for _, found in resample.feature_buckets(iter([text.encode(), None, b"one two"]), 10_000, resample._shift_tables()) for b in found.tolist())
    monkeypatch.setattr(resample, "BYTES_AT_ONCE", 64)
    monkeypatch.setattr(resample, "WORDS_AT_ONCE", 50)
    cut = Counter(b for _, found in resample.feature_buckets(iter([text.encode(), None, b"one two"]), 10_000, resample._shift_tables()) for b in found.tolist())
    assert cut == whole == Counter(features(text) + features("one two"))
