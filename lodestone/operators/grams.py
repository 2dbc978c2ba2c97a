"""Character trigrams of texts as whole numbers, counted and summed where texts are read: no row for each trigram, no exchange of texts.

A trigram is its three code points, 21 bits each. A text of fewer characters is one trigram, filled up with a number that is no code point, so that the empty
text has one too; a null text has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILL, BITS = (1 << 21) - 1, 21
#: Characters whose trigrams are laid out at a time (a longer text is laid out whole); weights (trigrams x classes of a fold) that go to tasks.
PART_CHARS, MOST_WEIGHTS = 1_000_000, 8_000_000


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of texts one after another, and where each text's begin."""
    counts = np.array([len(t) for t in texts], np.int64)
    long = np.maximum(counts, 3)
    ends = np.cumsum(long)
    points = np.frombuffer("".join(t if len(t) >= 3 else t.ljust(3, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    for i in np.flatnonzero(counts < 3):
        points[ends[i] - 3 + counts[i] : ends[i]] = FILL
    every = points[:-2] << 2 * BITS | points[1:-1] << BITS | points[2:]
    inside = np.ones(len(every), bool)
    inside[ends[:-1] - 1] = inside[ends[:-1] - 2] = False
    return every[inside], np.cumsum(long - 2) - (long - 2)


def _parts(texts: pa.Array, groups: list) -> Iterator[tuple[object, np.ndarray, list[str]]]:
    """(group, its rows, their texts): a part is of one group, and of a bounded size."""
    texts, rows = texts.cast(pa.binary()), {}
    for i, g in enumerate(groups):
        rows.setdefault(g, []).append(i)
    for g, mine in rows.items():
        some, said, size = [], [], 0
        for i in mine:
            if (t := texts[i].as_py()) is None:
                continue
            some.append(i)
            said.append(t.decode("utf-8", "replace"))
            size += len(said[-1])
            if size >= PART_CHARS:
                yield g, np.array(some), said
                some, said, size = [], [], 0
        if some:
            yield g, np.array(some), said


def counts(rows: DataFrame, fold: str = "fold", name: str = "name", text: str = "text") -> DataFrame:
    """fold, name, g, w: how often each trigram occurs in the texts of a fold and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (f, k), _, texts in _parts(batch.column(2), [*zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]):
                codes, n = np.unique(trigrams(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), f, np.int32)), pa.array([k] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], names=["fold", "name", "g", "w"])

    found = rows.select(F.col(fold).cast("int").alias("fold"), F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    return found.mapInArrow(run, "fold int, name string, g long, w long").groupBy("fold", "name", "g").agg(F.sum("w").alias("w"))


def dots(rows: DataFrame, key: str, weights: DataFrame, fold: str = "fold", text: str = "text", most: int = MOST_WEIGHTS) -> DataFrame:
    """key, fold, name, dot: the summed weights (fold, name, g, w; stored, as it is read again) of all trigrams of the texts of a key, for each class of their
    fold with one of them. Weights go to the tasks if they are few; else trigrams meet them by a join."""
    kind = rows.schema[key].dataType.simpleString()
    asked = rows.select(F.col(key).alias("key"), F.col(fold).cast("int").alias("fold"), F.col(text).cast("string").alias("text"))
    sizes = weights.groupBy("fold").agg(F.count_distinct("g").alias("g"), F.count_distinct("name").alias("n")).collect()
    if sum(r["g"] * (r["n"] + 1) for r in sizes) <= most:
        found = asked.mapInArrow(_summed(_sent(weights)), f"key {kind}, fold int, name string, dot long")
    else:
        met = asked.mapInArrow(_counted, f"key {kind}, fold int, g long, n long").join(weights, ["fold", "g"])
        found = met.select("key", "fold", "name", (F.col("n") * F.col("w")).alias("dot"))
    return found.groupBy("key", "fold", "name").agg(F.sum("dot").alias("dot")).withColumnRenamed("key", key)


def _sent(weights: DataFrame):
    """fold: (its trigrams in order, its classes, a row of weights for each trigram), sent to the tasks."""
    table, out = weights.select("fold", "name", "g", "w").toArrow(), {}
    fold, g, w = (table.column(c).to_numpy() for c in ("fold", "g", "w"))
    name = np.array(table.column("name").to_pylist(), object)
    for f in np.unique(fold):
        mine = fold == f
        codes, at = np.unique(g[mine], return_inverse=True)
        names = sorted(set(name[mine]))
        places = {n: i for i, n in enumerate(names)}
        worth = np.zeros((len(codes), len(names)), np.int64)
        worth[at, [places[n] for n in name[mine]]] = w[mine]
        out[int(f)] = (codes, names, worth)
    return weights.sparkSession.sparkContext.broadcast(out)


def _summed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, rows, texts in _parts(batch.column(2), batch.column(1).to_pylist()):
                if f not in sent.value:
                    continue
                codes, names, worth = sent.value[f]
                mine, starts = trigrams(texts)
                at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
                known = codes[at] == mine
                for i, name in enumerate(names):
                    dot = np.add.reduceat(np.where(known, worth[at, i], 0), starts)
                    some = np.flatnonzero(dot)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[some])), pa.array(np.full(len(some), f, np.int32)), pa.array([name] * len(some), pa.string()), pa.array(dot[some])], names=["key", "fold", "name", "dot"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for f, rows, texts in _parts(batch.column(2), batch.column(1).to_pylist()):
            for row, text in zip(rows, texts, strict=True):
                codes, n = np.unique(trigrams([text])[0], return_counts=True)
                at = pa.array(np.full(len(codes), row))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.full(len(codes), f, np.int32)), pa.array(codes), pa.array(n.astype(np.int64))], names=["key", "fold", "g", "n"])
