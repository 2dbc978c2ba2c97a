"""Closest names beside the standard library's, name by name."""

from __future__ import annotations

import random
from difflib import SequenceMatcher, get_close_matches

import pytest

from lodestone.operators import likeness
from lodestone.queries import closest_part_names, table

SF = "/root/testdata/sf0.001"


def plain(typed, known, cutoff=0.6):
    out = {}
    for t in set(typed) - {None}:
        best = next(iter(get_close_matches(t, sorted(set(known) - {None}), n=1, cutoff=cutoff)), None)
        out[t] = (best, None if best is None else SequenceMatcher(None, best, t).ratio())
    return out


def found(df):
    rows = df.collect()
    assert len({r.typed for r in rows}) == len(rows)
    return {r.typed: (r.name, r.ratio) for r in rows}


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("letters", ["abc", "abcdefghijß𝄞 _"])
def test_like_the_standard_library(spark, letters, block):
    r = random.Random(len(letters))
    word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(1, 14)))
    known = [word() for _ in range(150)] + ["", None, "aab", "aba", "aab", "a" * 260 + "bc" * 20]
    typed = [word() for _ in range(25)] + ["", None, "aab", "ba", "qqqqqq", "qqqqqq", "a" * 250 + "cb" * 20]
    frames = [spark.createDataFrame([(x, 1) for x in xs], "typed string, name int") for xs in (typed, known)]
    for cutoff in (0.6, 0.85):
        assert found(likeness.closest_names(frames[0], frames[1].repartition(4), cutoff, block)) == plain(typed, known, cutoff)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "x string"), spark.createDataFrame([("a",)], "x string")
    assert found(likeness.closest_names(some, none)) == {"a": (None, None)}
    assert found(likeness.closest_names(none, some)) == {}
    with pytest.raises(ValueError):
        likeness.closest_names(some, some, 0)


def test_query(spark):
    names = [r[0] for r in table(spark, SF, "part").select("p_name").collect()]
    got = closest_part_names(spark, SF).collect()
    want = plain([r.typed for r in got], names)
    assert {r.typed: (r.name, r.ratio) for r in got} == want and len(got) > 2 and all(r.name for r in got)
