"""The substring join against a plain loop."""

from __future__ import annotations

import random

from lodestone.operators import patterns


def test_matches(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abé") for _ in range(n))
    texts = [(i, f"k{i % 5}", word(r.randrange(60))) for i in range(200)] + [(900, None, None), (901, "", ""), (None, "n", "abab"), (3, "k3", "abab"), (3, "k3", "abab")]
    wanted = sorted({word(r.randrange(1, 6)) for _ in range(60)})
    df = spark.createDataFrame([(*t, 1) for t in texts], "id long, key string, text string, hits int").repartition(4)
    known = spark.createDataFrame([(p,) for p in [*wanted, wanted[0], "", None]], "pattern string")
    found = lambda t, p: [i for i in range(len(t)) if t.startswith(p, i)]
    want = sorted(((i, k, p, len(f), f[0]) for i, k, t in texts if t for p in wanted if (f := found(t, p))), key=str)
    for chars in (10**6, 20):  # one block, and many
        got = patterns.matches(df, ["id", "key"], known, block_chars=chars)
        assert got.columns == ["id", "key", "pattern", "hits", "first_at"]
        assert sorted((tuple(x) for x in got.collect()), key=str) == want
    assert patterns.matches(df.limit(0), ["id"], known).count() == 0
    assert patterns.matches(df, ["id"], known.limit(0)).count() == 0


def test_texts_are_not_moved(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, text string")
    plan = patterns.matches(df, ["id"], spark.createDataFrame([("b",)], "pattern string"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[-1]
