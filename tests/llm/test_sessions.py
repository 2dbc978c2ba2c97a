"""Late sessions against a plain replay that regroups all events of a user after each batch."""

from __future__ import annotations

import random

import pytest

from lodestone.llm import sessions

EVENTS = "user long, seconds long, batch long, value long, island long, n string, u int"


def plain(events: list[tuple], gap: int) -> list[tuple]:
    out = []
    for user in {e[0] for e in events}:
        mine = [e for e in events if e[0] == user and e[1] is not None and e[2] is not None]
        standing: list[tuple] = []
        for batch in sorted({e[2] for e in mine}):
            groups: list[list[tuple]] = []
            for e in sorted((e for e in mine if e[2] <= batch), key=lambda e: e[1]):
                if groups and e[1] - groups[-1][-1][1] <= gap:
                    groups[-1].append(e)
                else:
                    groups.append([e])
            after = []
            for g in groups:
                start, end, new = g[0][1], g[-1][1], sum(e[2] == batch for e in g)
                inside = [v for v in standing if start <= v[2] and v[3] <= end]
                if new:
                    out += [(*v, batch, start) for v in inside]
                    after.append((user, batch, start, end, len(g), new, len(inside), sum(e[3] or 0 for e in g)))
                else:
                    after += inside
            standing = after
        out += [(*v, None, None) for v in standing]
    return sorted(out, key=str)


def versions(spark, events: list[tuple], gap: int) -> list[tuple]:
    df = spark.createDataFrame([(*e, 7, "n", 1) for e in events], EVENTS)
    return sorted((tuple(r) for r in sessions.session_versions(df, gap).collect()), key=str)


@pytest.mark.parametrize(("seed", "span", "rows", "gap"), [(0, 3_000, 100, 240), (1, 40_000, 300, 240), (2, 200_000, 1_500, 240), (3, 600, 80, 1), (4, 200, 60, 0)])
def test_replay(spark, seed, span, rows, gap):
    r = random.Random(seed)
    events = []
    for user in (0, 1, 2, None):
        for _ in range(rows):
            s = r.randrange(-500, span)
            events.append((user, s, s // 1800 + r.choice([0, 0, 1, 3]), r.choice([None, r.randrange(2**32)])))
    events += events[:20] + [(1, None, 3, 4), (1, 5, None, 4)]
    assert versions(spark, events, gap) == plain(events, gap)


def test_session_over_many_blocks(spark):
    # One session of 26 blocks of time, whose start has to be traced through solid blocks; another begins behind it.
    events = [(7, s, s // 1800 + (s // 200) % 3, s) for s in range(0, 26 * 240 * sessions.BLOCK, 200)] + [(7, 10**7, 9999, 1), (8, 3, 0, 1), (8, 3, 0, 1)]
    assert versions(spark, events, 240) == plain(events, 240)


def test_order_of_rows_and_partitions_do_not_matter(spark):
    r = random.Random(9)
    events = [(u % 3, r.randrange(20_000), r.randrange(12), u) for u in range(400)]
    want = versions(spark, events, 240)
    r.shuffle(events)
    df = spark.createDataFrame([(*e, 7, "n", 1) for e in events], EVENTS).repartition(5)
    assert sorted((tuple(x) for x in sessions.session_versions(df).collect()), key=str) == want


def test_empty_and_nulls(spark):
    assert versions(spark, [], 240) == []
    turns = spark.createDataFrame([(None, 1, "user", "a"), (3, None, "user", "a"), (3, 0, None, None)], "conv_id long, turn long, role string, text string")
    assert sessions.turn_events(turns).count() == 1
    assert sessions.session_versions(sessions.turn_events(turns.limit(0))).count() == 0
