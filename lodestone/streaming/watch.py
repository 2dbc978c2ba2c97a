"""A watch over files: a stream of sightings (file, mtime, seen_at) whose state is the newest version of each file, and an index that
follows what the state says.

A file is a key of its own in the state store, so that its newest version is known over all micro-batches, restarts and late or repeated
sightings: a sighting that isn't newer says nothing. A file that wasn't sighted for `heartbeat` of event time has vanished (a timer
in the state says so). What changed in a micro-batch goes to the index as one refresh, whose step carries the batch's number: a
batch that is run again after a failure is skipped if its step was committed, and written over if it wasn't. Texts never enter the
state: they are loaded for the changed files alone.

Edge cases: a null file isn't a file; a null mtime is older than any; a null seen_at doesn't move the heartbeat; a file that vanished and
comes back is new; an empty batch changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.sources import index as K

HEARTBEAT_SECONDS = 600
CHANGES = "file string, kind string, mtime double"

Loader = Callable[[DataFrame], DataFrame]


def _newest(heartbeat: int):
    """State of a file: (its newest mtime, when it was last seen in ms)."""

    def step(key: tuple[str], sightings: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        said = []
        if state.hasTimedOut:
            state.remove()
            said.append((key[0], "vanished", None))
        else:
            known, seen = state.get if state.exists else (None, None)
            newest = known
            for rows in sightings:
                times = rows["mtime"].dropna()
                newest = max([t for t in (newest, times.max() if len(times) else None) if t is not None], default=None)
                at = rows["seen_at"].dropna()
                if len(at):
                    seen = max(seen or 0, int(at.max().timestamp() * 1000))
            if not state.exists or (newest is not None and newest > (known if known is not None else -math.inf)):
                said.append((key[0], "changed", newest))
            state.update((newest, seen))
            if seen is not None:
                state.setTimeoutTimestamp(max(seen + heartbeat * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(said, columns=["file", "kind", "mtime"])

    return step


def changes(sightings: DataFrame, heartbeat: int = HEARTBEAT_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """file, kind (changed or vanished), mtime of a stream of sightings (file, mtime double, seen_at timestamp)."""
    rows = sightings.filter("file IS NOT NULL").select("file", "mtime", "seen_at").withWatermark("seen_at", delay)
    return rows.groupBy("file").applyInPandasWithState(_newest(heartbeat), CHANGES, "mtime double, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def into_index(index: K.Index, load: Loader, embed: K.Embedder, now: Callable[[], float] | None = None):
    """A foreachBatch function: a micro-batch's changes become one step of the index. load(files) gives file, text, language and
    mtime of the files that still exist."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        told = index.work("told", batch)
        if told.isEmpty():
            return
        last = told.groupBy("file").agg(F.max_by("kind", F.struct(F.coalesce("mtime", F.lit(-math.inf)), (F.col("kind") == "changed"))).alias("kind"))
        changed = load(last.filter("kind = 'changed'").select("file"))
        gone = last.filter("kind = 'vanished'").select("file")
        K.refresh(index, changed, embed, None, now() if now else None, batch=batch_id, gone=gone)

    return apply


def watch(sightings: DataFrame, index: K.Index, load: Loader, embed: K.Embedder, checkpoint: str, heartbeat: int = HEARTBEAT_SECONDS, now: Callable[[], float] | None = None, **trigger):
    """Starts a query that keeps an index up with a stream of sightings; by default it takes what is there, then ends. Started again
    on its checkpoint, it goes on where it was."""
    writer = changes(sightings, heartbeat).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(into_index(index, load, embed, now)).trigger(**(trigger or {"availableNow": True})).start()
