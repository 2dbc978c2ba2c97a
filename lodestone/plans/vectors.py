"""Nearest vectors of many queries: queries in blocks of a bounded size, each block against all rows where they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vector import EPSILON

#: Queries that are sent to the rows at a time, and rows that are compared at a time with a part of them.
BLOCK, ROWS, PART = 4096, 2048, 512


def cosine_topk_many(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query, id, score, rank of the k nearest of rows (id, embedding) to each of queries (query, embedding), ties by id. Queries
    go out in blocks; a partition keeps k rows a query, and these meet by query. A
    task holds the scores of PART queries and ROWS rows at a time, a few times 8 MB. Null vectors and those of another
    dimension than the query's are compared with none.

    Blocks are cut by the queries' order, so a block is at most `block` vectors on the driver; with many blocks the rows are
    read once for each.
    """
    sizes = [r[0] for r in queries.filter("embedding IS NOT NULL").select(F.size("embedding").alias("n")).distinct().orderBy("n").collect()]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id",)} | {"query": queries.schema["query"].dataType.simpleString()}
    out = None
    for size in sizes:
        mine = queries.filter(F.size("embedding") == size).select("query", "embedding")
        n = mine.count()
        w = Window.orderBy("query")
        numbered = mine if n <= block else mine.withColumn("__b", F.floor((F.row_number().over(w) - 1) / block))
        for b in range(-(-n // block)):
            part = (numbered if n <= block else numbered.filter(F.col("__b") == b)).select("query", "embedding").toArrow()
            found = _block(rows, part, size, k, kinds)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"query {kinds['query']}, id {kinds['id']}, score double, rank int")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _better(score: np.ndarray | None, ids: pa.Array | None, more: np.ndarray, keys: pa.Array, k: int) -> tuple[np.ndarray, pa.Array]:
    """The k best (score, id) a query of those so far (a row of scores a query, their ids row after row) and of more (a column for each
    of keys), ties by id. Only the scores that reach a query's k-th best are put in order."""
    rank = np.empty(len(keys), np.int64)
    rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
    n = min(k, more.shape[1])
    least = -np.partition(-more, n - 1, axis=1)[:, n - 1]
    row, place = np.nonzero(~(more < least[:, None]))  # what isn't a number comes last
    order = np.lexsort((rank[place], -more[row, place], row))
    row, place = row[order], place[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < n
    top, own = more[row[first], place[first]].reshape(-1, n), keys.take(pa.array(place[first]))
    if score is None:
        return top, own
    m = score.shape[1]
    every = pa.concat_arrays([ids, own])
    at = np.hstack([np.arange(len(ids)).reshape(-1, m), len(ids) + np.arange(len(own)).reshape(-1, n)])
    both = np.hstack([score, top])
    rank = np.empty(len(every), np.int64)
    rank[pc.sort_indices(every).to_numpy()] = np.arange(len(every))
    order = np.lexsort((rank[at], -both), axis=1)[:, :k]
    return np.take_along_axis(both, order, 1), every.take(pa.array(np.take_along_axis(at, order, 1).ravel()))


def _block(rows: DataFrame, part: pa.Table, size: int, k: int, kinds: dict[str, str]) -> DataFrame:
    names = part.column("query").combine_chunks()
    q = part.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(names), size)
    sent = rows.sparkSession.sparkContext.broadcast((names, q, np.sqrt((q * q).sum(axis=1))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, mine, lengths = sent.value
        found: list[tuple] = [(None, None)] * -(-len(queries) // PART)  # for each part of the queries: scores, ids
        for b in batches:
            fits = np.flatnonzero(pc.equal(pc.list_value_length(b.column(1)), size).fill_null(False).to_numpy(zero_copy_only=False))
            for lo in range(0, len(fits), ROWS):
                some = b.take(pa.array(fits[lo : lo + ROWS]))
                x = some.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, size)
                norms = np.sqrt((x * x).sum(axis=1))
                for p in range(len(found)):
                    own = slice(p * PART, (p + 1) * PART)
                    score = (mine[own] @ x.T) / (lengths[own, None] * norms + EPSILON)
                    found[p] = _better(*found[p], score, some.column(0), k)
        for p, (score, ids) in enumerate(found):
            if score is not None:
                names = np.repeat(np.arange(p * PART, p * PART + len(score)), score.shape[1])
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(names)), ids, pa.array(score.ravel())], ["query", "id", "score"])

    return rows.select("id", "embedding").mapInArrow(near, f"query {kinds['query']}, id {kinds['id']}, score double")
