"""The closest known name of each typed one, by the share of characters in matching blocks.

The ratio of two names is 2 * (characters in matching blocks) / (characters of both), as the standard library has it. Typed
names are a stated set, sent out in blocks of a bounded size; known names are matched where they are read. Of each known name
only how often its characters occur is compared with all of a block, in arrays of BINS: characters of one bin count as equal,
so the sum of the lesser counts is never below the characters that blocks can match. Names are matched block by block in
order of that bound, until it falls below the best ratio found (or the cutoff). A partition sends one row a typed name.

Edge cases: null names are left out, repeated ones count once; a typed name without a match has a null name and ratio; of
known names of one ratio the greatest by code points is taken; an empty name matches the empty name alone; an empty table
of known names leaves all without a match.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTOFF, BLOCK, BINS, ROWS = 0.6, 4096, 64, 4096


def character_counts(names: list[str]) -> np.ndarray:
    """How often characters of each bin occur: a row for each name."""
    points = [np.frombuffer(n.encode("utf-32-le", "surrogatepass"), np.uint32) % BINS for n in names]
    return np.array([np.bincount(p, minlength=BINS) for p in points], np.int32).reshape(-1, BINS)


def closest_names(typed: DataFrame, known: DataFrame, cutoff: float = CUTOFF, block: int = BLOCK) -> DataFrame:
    """typed, name, ratio: for each distinct name of typed (first column) the closest of known (first column), if its ratio
    is `cutoff` or more."""
    if not 0 < cutoff <= 1:
        raise ValueError("cutoff must be above 0 and at most 1")
    asked = typed.select(F.col(typed.columns[0]).alias("typed")).filter("typed IS NOT NULL").distinct()
    names = known.select(F.col(known.columns[0]).alias("name")).filter("name IS NOT NULL")
    n = asked.count()
    blocks = max(1, -(-n // block) * 2) if n > block else 1
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("typed"), F.lit(blocks)) == b)
        near = _near(names, part.toArrow().column(0).to_pylist(), cutoff)
        found = near if found is None else found.unionByName(near)
    best = found.groupBy("typed").agg(F.max(F.struct("ratio", "name")).alias("best")).select("typed", "best.name", "best.ratio")
    return asked.join(best, "typed", "left")


def _near(known: DataFrame, asked: list[str], cutoff: float) -> DataFrame:
    sent = known.sparkSession.sparkContext.broadcast((asked, character_counts(asked), np.array([len(q) for q in asked])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, counts, sizes = sent.value
        best: list[tuple[float, str | None]] = [(cutoff, None)] * len(queries)
        for b in batches:
            for lo in range(0, len(b), ROWS):
                names = b.column(0).slice(lo, ROWS).unique().to_pylist()
                mine, lengths = character_counts(names), np.array([len(x) for x in names])
                for q, text in enumerate(queries):
                    best[q] = _closer(text, counts[q], sizes[q], names, mine, lengths, best[q])
        told = [(q, name, ratio) for q, (ratio, name) in zip(queries, best, strict=True) if name is not None]
        columns = zip(*told, strict=True) if told else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["typed", "name", "ratio"])

    return known.mapInArrow(run, "typed string, name string, ratio double")


def _closer(text: str, counts: np.ndarray, size: int, names: list[str], mine: np.ndarray, lengths: np.ndarray, best: tuple[float, str | None]) -> tuple[float, str | None]:
    """The better of `best` and the closest of some names."""
    both = lengths + size
    may = np.flatnonzero(2 * np.minimum(lengths, size) >= best[0] * both - 1e-9)
    bound = np.ones(len(may))
    np.divide(2 * np.minimum(mine[may], counts).sum(axis=1), both[may], out=bound, where=both[may] > 0)
    matcher = None
    for k in np.argsort(-bound, kind="stable"):
        if bound[k] < best[0] - 1e-9:
            break
        matcher = matcher or SequenceMatcher(None, "", text)
        matcher.set_seq1(names[may[k]])
        ratio, name = matcher.ratio(), names[may[k]]
        if ratio > best[0] or ratio == best[0] and (best[1] is None or name > best[1]):
            best = (ratio, name)
    return best
