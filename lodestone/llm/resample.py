r"""Importance resampling towards a target distribution, without replacement: the documents that look most like the target.

Texts become counts of hashed n-gram features (runs of one and two words). A bucket's gain is the log ratio of its share in the
target to its share in the corpus; a document's weight is the mean gain of its features. Weight plus a Gumbel deviate from a hash
of the id is its score, and the `percent` of eligible documents with the highest scores are drawn, ranked.

1. count: tasks sum the buckets of their texts into one array each; arrays are added by bucket. The gains, one for each of the fixed
   number of buckets, are the model.
2. weigh: features are computed again and their gains summed, in arrays over many texts (nothing of the size of the texts is stored).
3. draw: a histogram of scores gives the lowest score that can be drawn, and the bounds of score ranges of at most
   `RANGE_ROWS` rows (a heavy score is divided by id). Each partition sorts its eligible rows into runs, cut at the bounds and written
   to the shared folder. Runs of a range meet in one task, where tournament trees of at most `FAN_IN` runs merge them, in passes; the
   rows of the ranges before give the first rank, and the merge stops ranking at the exact number to draw.

Crc32 is linear, so the checksum of two words is put together from those of the words, by tables for each length.

Edge cases: null or empty texts have no feature, weight 0, and aren't drawn; a null id is hashed as an empty one and comes after all ids
on a tie; repeated rows each get a row and a rank (rows that tie in id too are ordered by features and weight, and else equal);
an empty table gives an empty result; an empty target gives gains from the corpus alone. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, shuffle_buckets

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 7, 25, 20
#: Rows of a score range and of a run at most, and how many runs a tree merges.
RANGE_ROWS, RUN_ROWS, FAN_IN = 500_000, 500_000, 64
#: Words worked on at once, and bytes of a text cut at once.
WORDS_AT_ONCE, BYTES_AT_ONCE = 200_000, 1 << 20
#: Words up to this length have tables; checksums with longer ones are computed plainly.
LONGEST = 48

#: Letters and digits of ASCII in lower case, bytes of other characters as they are, anything else a space.
_PLAIN = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_ROW = "doc_id long, n_features long, weight long, score long"


def _shift_tables() -> np.ndarray:
    """[length, byte of the checksum, its value]: what a checksum becomes as `length` more bytes follow, without their own part."""
    tables = np.zeros((LONGEST + 1, 4, 256), np.uint32)
    zero = zlib.crc32(b"\0")
    value = np.arange(256, dtype=np.uint32)
    for k in range(4):
        tables[0, k] = value << np.uint32(8 * k)
    step = np.array([zlib.crc32(b"\0", v) ^ zero for v in range(256)], np.uint32)  # of the low byte; the others just move down
    for n in range(1, LONGEST + 1):
        before = tables[n - 1]
        tables[n] = step[before & 255] ^ (before >> np.uint32(8))
    return tables


def _pieces(texts: Iterator[bytes | None]) -> Iterator[tuple[int, list[bytes], bool]]:
    """(number of the text, words, whether the first of them was in the piece before) of texts cut at spaces."""
    for i, text in enumerate(texts):
        plain, at, last = (text or b"").translate(_PLAIN), 0, None
        while True:
            end = len(plain) if len(plain) - at <= BYTES_AT_ONCE else plain.find(b" ", at + BYTES_AT_ONCE)
            end = len(plain) if end < 0 else end
            words = plain[at:end].split()
            if last is not None and words:
                yield i, [last, *words], True
            elif words:
                yield i, words, False
            last, at = words[-1] if words else last, end
            if end == len(plain):
                break


def _checksums(words: list[bytes], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, and of each word and the one before with a space between (the first has none: 0)."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    own = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))
    spaced = np.fromiter((zlib.crc32(b" ", c) for c in own.tolist()), np.uint32, len(known))
    lengths = np.fromiter(map(len, known), np.int64, len(known))
    left, right = spaced[ids[:-1]], ids[1:]
    n = lengths[right]
    short = np.minimum(n, LONGEST)
    moved = tables[short, 0, left & 255] ^ tables[short, 1, (left >> np.uint32(8)) & 255] ^ tables[short, 2, (left >> np.uint32(16)) & 255] ^ tables[short, 3, left >> np.uint32(24)]
    pairs = moved ^ own[right]
    for i in np.flatnonzero(n > LONGEST).tolist():
        pairs[i] = zlib.crc32(words[i + 1], int(left[i]))
    return own[ids], np.concatenate([np.zeros(min(1, len(words)), np.uint32), pairs])


def feature_buckets(texts: Iterator[bytes | None], buckets: int, tables: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of texts, buckets) of all features, many at a time."""
    words: list[bytes] = []
    starts: list[tuple[int, int, bool]] = []

    def done() -> tuple[np.ndarray, np.ndarray]:
        single, pair = _checksums(words, tables)
        at = np.array([s for s, _, _ in starts])
        text = np.repeat([t for _, t, _ in starts], np.diff([*at, len(words)]))
        has_single, has_pair = np.ones(len(words), bool), np.ones(len(words), bool)
        has_pair[at] = False
        has_single[[s for s, _, carried in starts if carried]] = False
        return np.concatenate([text[has_single], text[has_pair]]), (np.concatenate([single[has_single], pair[has_pair]]) % np.uint32(buckets)).astype(np.int64)

    for i, piece, carried in _pieces(texts):
        starts.append((len(words), i, carried))
        words.extend(piece)
        if len(words) >= WORDS_AT_ONCE:
            yield done()
            words, starts = [], []
    if words:
        yield done()


def _bytes_of(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_py() for x in column.cast(pa.binary()))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the texts. One array a task is summed where it is read, and one row a bucket by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, total = _shift_tables(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in feature_buckets(_bytes_of(batch.column(0)), buckets, tables):
                total += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed share in the target to that in the corpus, rounded down."""
    k = len(corpus)
    all_corpus, all_target = float(corpus.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _shift_tables()
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for text, found in feature_buckets(_bytes_of(batch.column(1)), len(gain), tables):
                n += np.bincount(text, minlength=batch.num_rows)
                total += np.rint(np.bincount(text, weights=gain[found], minlength=batch.num_rows)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_features long, weight long")


def scores(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of each document."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    deviate = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights(docs, gain).withColumn("score", F.col("weight") + deviate)


class TournamentTree:
    """Merges sorted runs of keys: every inner node holds the loser of its match, the root's winner is the next key."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, root: int) -> int:
        """Leaves are the nodes k..2k-1; the winner of `root`'s subtree, bottom up."""
        best = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, root - 1, -1):
            a, b = best[2 * node], best[2 * node + 1]
            best[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return best[root]

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (key := self.heads[self.winner]) is not None:
            yield key
            self.heads[self.winner] = next(self.runs[self.winner], None)
            at, node = self.winner, (self.winner + self.k) // 2
            while node:
                if self._beats(self.losers[node], at):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.winner = at


def merge_runs(runs: list[list[tuple]], fan_in: int = FAN_IN) -> Iterator[tuple]:
    """All keys in order, in passes over at most fan_in runs at once."""
    while len(runs) > fan_in:
        runs = [list(TournamentTree([iter(r) for r in runs[i : i + fan_in]])) for i in range(0, len(runs), fan_in)]
    return iter(TournamentTree([iter(r) for r in runs]))


def _key(score: int, doc_id: int | None, n: int, weight: int) -> tuple:
    """In order of rank: score down, id up with null last."""
    return (-score, doc_id is None, doc_id or 0, n, weight)


def _bounds(eligible: DataFrame, draws: int, most: int) -> tuple[int, list[tuple]]:
    """The least score that can be drawn, and keys at which ranges end (each is the first key of the next range). Scores are sums of
    bounded logarithms, some 100,000 values at most, however many rows there are."""
    counts = sorted(((r["score"], r["n"]) for r in eligible.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    ends, heavy, inside, before = [], [], 0, 0
    least = counts[-1][0] if counts else 0
    for score, n in counts:
        if inside and inside + n > most:
            ends.append((-score,))
            inside = 0
        if n > most:
            heavy.append((score, n))
        inside, before, least = inside + n, before + n, score
        if before >= draws:
            break
    for score, n in heavy:
        parts = -(-n // most)
        at = eligible.filter(F.col("score") == score).agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
        ends += [(-score, False, d) for d in sorted({*(at or ())})]
    return least, sorted(ends)


def _sorted_runs(ends: list[tuple], rows: int):
    """Rows of a partition as sorted runs, each cut into its ranges: range, keys as five lists."""

    def cut(keys: list[tuple]) -> Iterator[tuple]:
        keys.sort()
        marks = [0, *(bisect_left(keys, e) for e in ends), len(keys)]
        for i in range(len(marks) - 1):
            if marks[i] < marks[i + 1]:
                yield i, keys[marks[i] : marks[i + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(keys: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i, part in cut(keys):
                score, null, doc_id, n, weight = zip(*part, strict=True)
                ids = [None if x else d for x, d in zip(null, doc_id, strict=True)]
                lists = [pa.array([list(c)], pa.list_(pa.int64())) for c in ([-s for s in score], ids, n, weight)]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([len(part)], pa.int64()), *lists], names=["range", "size", "score", "doc_id", "n_features", "weight"])

        keys: list[tuple] = []
        for batch in batches:
            keys += [_key(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if len(keys) >= rows:
                yield from packed(keys)
                keys = []
        if keys:
            yield from packed(keys)

    return run


def _merged(first_rank: dict[int, int], draws: int, fan_in: int):
    """Rows of the ranges of a partition with their ranks; rows beyond the draw come without."""

    def ranked(number: int, runs: list[list[tuple]]) -> Iterator[tuple]:
        rank = first_rank[number]
        merged = merge_runs(runs, fan_in)
        if rank <= draws:
            for score, null, doc_id, n, weight in merged:
                yield None if null else doc_id, n, weight, -score, rank
                rank += 1
                if rank > draws:
                    break
        for score, null, doc_id, n, weight in merged:
            yield None if null else doc_id, n, weight, -score, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_features", "weight", "score", "rank")])

        def ranges() -> Iterator[tuple[int, list[list[tuple]]]]:
            number, runs = None, []
            for batch in batches:
                for r in batch.to_pylist():
                    if r["range"] != number:
                        if runs:
                            yield number, runs
                        number, runs = r["range"], []
                    runs.append([_key(*row) for row in zip(r["score"], r["doc_id"], r["n_features"], r["weight"], strict=True)])
            if runs:
                yield number, runs

        out: list[tuple] = []
        for number, runs in ranges():
            for row in ranked(number, runs):
                out.append(row)
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return run


def ranked_draw(scored: DataFrame, draws: int, eligible: Column, range_rows: int = RANGE_ROWS, run_rows: int = RUN_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """`scored` (doc_id, n_features, weight, score; materialised) with the ranks 1..draws of the highest scores among eligible rows."""
    spark = scored.sparkSession
    most = max(1, min(range_rows, draws // shuffle_buckets(spark)))
    least, ends = _bounds(scored.filter(eligible), draws, most)
    entered = eligible & (F.col("score") >= least) & F.lit(draws > 0)
    rest = scored.filter(~F.coalesce(entered, F.lit(False))).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    lists = ", ".join(f"{c} array<long>" for c in ("score", "doc_id", "n_features", "weight"))
    runs = materialise(scored.filter(entered).select("score", "doc_id", "n_features", "weight").mapInArrow(_sorted_runs(ends, run_rows), f"range int, size long, {lists}"), "runs")
    sizes = {r["range"]: r["n"] for r in runs.groupBy("range").agg(F.sum("size").alias("n")).collect()}
    first_rank, at = {}, 1
    for number in sorted(sizes):
        first_rank[number] = at
        at += sizes[number]
    met = runs.repartition(max(1, len(ends) + 1), "range").sortWithinPartitions("range")
    return met.mapInArrow(_merged(first_rank, draws, fan_in), f"{_ROW}, rank long").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and its rank if it is among the `percent` drawn of the documents
    with at least `least_words` words."""
    scored = materialise(scores(docs, target, buckets, seed), "scored")
    # n words have 2n - 1 features.
    eligible = F.col("n_features") >= 2 * max(least_words, 0) - 1
    draws = percent * scored.filter(eligible).count() // 100
    return ranked_draw(scored, draws, eligible)


def drawn_documents(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that were drawn, by id. Documents of one id are drawn together."""
    drawn = resample(docs, target, **parameters).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("__drawn")), "left_semi")
