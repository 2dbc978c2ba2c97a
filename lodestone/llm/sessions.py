"""Sessions of users whose events arrive late, with every version a session had and what took its place.

A user's session is a run of events of which neighbours in time are at most `gap` seconds apart. Events arrive in batches,
not in order of time. After each batch a session that holds one of its events is a new version; it retracts the standing
sessions that it swallowed.

1. Events of one user, second and batch become one row (`n_events`, `h_sum`): repeated rows and bursts cost nothing more.
2. Islands: runs of *all* events of a user that are at most `gap` apart. Whatever has arrived by some batch is a part of all
   events, so no session of any batch reaches over an island's ends, and islands are replayed apart. They are found in
   blocks of `BLOCK` gaps of a user's time; a run that enters a block from the one before is traced by pointer doubling
   over the (user, block) rows that are crossed. A user with a third of all rows is spread by block and by island.
3. Replay: an island's rows in order of batch go through a list of disjoint sessions kept sorted by start. A new event is
   placed by bisection and splices the sessions within its gap; after a batch the touched sessions are logged.

An island holds at most a row for each of its seconds and batches, whatever the number of events. Islands are streamed from a
sorted partition one at a time; nothing is collected or broadcast.

Edge cases: events without time or batch are left out; a null user is a user; a null value adds 0 to h_sum; equal rows all
count; an empty table gives an empty result; other columns, of any name, are ignored. Ties in time are one second of one session.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, shuffle_buckets

GAP = 240
#: Gaps in a block of a user's time.
BLOCK = 64

VERSIONS = "user long, batch long, start_s long, end_s long, n_events long, n_new long, n_retracted long, h_sum long, retracted_batch long, retracted_start_s long"


def turn_events(conversations: DataFrame) -> DataFrame:
    """user, seconds, batch and value of each turn: times and lateness are derived from checksums of the ids. Rows without
    conversation or turn have no time."""
    ids = conversations.filter(F.col("turn").isNotNull() & F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.crc32(F.col("conv_id").cast("string")).alias("c"),
        F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("h"),
    )
    timed = ids.select(
        (2 * F.shiftright("conv_id", 3) + F.col("c") % 2).alias("user"),
        (F.shiftright("c", 1) % 7200 + 300 * F.col("turn") + F.col("h") % 600).alias("seconds"),
        F.floor(F.col("h") / 600).alias("g"),
        F.col("h").alias("value"),
    )
    late = F.when(F.col("g") % 3 == 0, F.col("g") % 4).otherwise(0)
    return timed.select("user", "seconds", (F.floor(F.col("seconds") / 1800) + late).alias("batch"), "value")


def _summed(events: DataFrame, gap: int) -> DataFrame:
    """A row for each user, second and batch, with the start of its run inside its block."""
    rows = (
        events.select(*(F.col(c).cast("long").alias(c) for c in ("user", "seconds", "batch", "value"))).filter("seconds IS NOT NULL AND batch IS NOT NULL")
        .groupBy("user", "seconds", "batch").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("value"), F.lit(0)).alias("h"))
        .withColumn("block", F.floor(F.col("seconds") / (BLOCK * max(gap, 1))))
    )
    in_block = Window.partitionBy("user", "block").orderBy("seconds", "batch")
    before = F.lag("seconds").over(in_block)
    rows = rows.withColumn("opens", F.when(before.isNull() | (F.col("seconds") - before > gap), F.col("seconds")))
    return rows.withColumn("run", F.last("opens", ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("opens")


def _entered(rows: DataFrame, gap: int) -> DataFrame:
    """user, block, island: for each block whose first run began in an earlier block, where it began."""
    blocks = rows.groupBy("user", "block").agg(F.min("seconds").alias("first_s"), F.max("seconds").alias("last_s"), F.max("run").alias("last_run"))
    blocks = materialise(blocks, "blocks")
    left = blocks.select(F.col("user").alias("u"), (F.col("block") + 1).alias("next"), F.col("last_s").alias("left_s"), F.col("last_run").alias("left_run"), (F.col("last_run") == F.col("first_s")).alias("solid"))
    crossed = blocks.join(left, F.col("user").eqNullSafe(F.col("u")) & (F.col("block") == F.col("next")) & (F.col("first_s") - F.col("left_s") <= gap)).select("user", "block", "left_run", "solid")
    crossed = materialise(crossed, "crossed")
    # The run on the left began in the left block, unless it fills that block and entered it too.
    above = crossed.select(F.col("user").alias("u"), (F.col("block") + 1).alias("next"), F.lit(True).alias("entered"))
    traced = crossed.join(above, F.col("user").eqNullSafe(F.col("u")) & (F.col("block") == F.col("next")), "left").select(
        "user", "block", F.when(F.col("solid") & F.col("entered"), F.col("block") - 1).alias("pointer"), F.col("left_run").alias("island")
    )
    while True:
        traced = materialise(traced, "traced")
        if traced.filter("pointer IS NOT NULL").isEmpty():
            return traced.select("user", "block", "island")
        there = traced.select(F.col("user").alias("u"), F.col("block").alias("at"), F.col("pointer").alias("further"), F.col("island").alias("known"))
        traced = traced.join(there, F.col("user").eqNullSafe(F.col("u")) & (F.col("pointer") == F.col("at")), "left").select(
            "user", "block", F.col("further").alias("pointer"), F.when(F.col("pointer").isNull(), F.col("island")).otherwise(F.col("known")).alias("island")
        )


def islands(events: DataFrame, gap: int = GAP) -> DataFrame:
    """user, island (its first second), batch, seconds, n, h: the rows to replay."""
    rows = materialise(_summed(events, gap), "runs")
    entered = _entered(rows, gap).select(F.col("user").alias("u"), F.col("block").alias("b"), F.col("island").alias("from_before"))
    first = rows.groupBy("user", "block").agg(F.min("seconds").alias("first_s")).select(F.col("user").alias("v"), F.col("block").alias("w"), "first_s")
    entered = entered.join(first, F.col("u").eqNullSafe(F.col("v")) & (F.col("b") == F.col("w"))).select("u", "b", "from_before", "first_s")
    # A block's first run has its first second as start; only that run can have entered.
    joined = rows.join(entered, F.col("user").eqNullSafe(F.col("u")) & (F.col("block") == F.col("b")) & (F.col("run") == F.col("first_s")), "left")
    return joined.select("user", F.coalesce("from_before", "run").alias("island"), "batch", "seconds", "n", "h")


def replay_island(rows: Iterator[tuple[int, int, int, int]], gap: int) -> Iterator[tuple]:
    """Versions of one island's sessions from its (batch, second, n, h) rows, batches ascending. A version is a tuple of
    batch, start, end, n_events, n_new, n_retracted, h_sum, retracted_batch, retracted_start_s."""
    starts: list[int] = []
    #: Beside starts: [end, n_events, h_sum, n_new, the standing versions inside].
    sessions: list[list] = []
    touched: dict[int, None] = {}
    now: int | None = None

    def close() -> Iterator[tuple]:
        for start in sorted(touched):
            at = sessions[bisect_left(starts, start)]
            end, n, h, new, inside = at
            for version in inside:
                yield (*version, now, start)
            at[3], at[4] = 0, [(now, start, end, n, new, len(inside), h)]
        touched.clear()

    for batch, second, n, h in rows:
        if batch != now:
            yield from close()
            now = batch
        # Sessions from `low` up to `high` are within the gap of the event: they are spliced into one.
        low = high = bisect_left(starts, second)
        if low and second - sessions[low - 1][0] <= gap:
            low -= 1
        while high < len(starts) and starts[high] - second <= gap:
            high += 1
        spliced = sessions[low:high]
        start = min([second, *starts[low:high]])
        for old in starts[low:high]:
            touched.pop(old, None)
        whole = [max([second, *(x[0] for x in spliced)]), n + sum(x[1] for x in spliced), h + sum(x[2] for x in spliced), n + sum(x[3] for x in spliced), [v for x in spliced for v in x[4]]]
        starts[low:high], sessions[low:high] = [start], [whole]
        touched[start] = None
    yield from close()
    for *_, inside in sessions:
        for version in inside:
            yield (*version, None, None)


def _replayed(gap: int):
    schema = pa.schema([(c.split()[0], pa.int64()) for c in VERSIONS.split(", ")])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        rows = rows_of(batches)
        row = next(rows, None)
        while row is not None:
            user, island = key = row[:2]

            def own() -> Iterator[tuple]:
                nonlocal row
                while row is not None and row[:2] == key:
                    yield row[2:]
                    row = next(rows, None)

            for version in replay_island(own(), gap):
                out.append((user, *version))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return run


def session_versions(events: DataFrame, gap: int = GAP) -> DataFrame:
    """Every version of every session of `events` (user, seconds, batch, value): batch, start_s and end_s, n_events and n_new
    (of its batch), n_retracted, h_sum, and the version that retracted it (null if it stands in the end)."""
    rows = islands(events, gap).repartition(shuffle_buckets(events.sparkSession), "user", "island").sortWithinPartitions("user", "island", "batch", "seconds")
    return rows.select("user", "island", "batch", "seconds", "n", "h").mapInArrow(_replayed(gap), VERSIONS)
