r"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, topic). Very frequent words, and the end of a text, are classes of
their own; other words fall into classes by a hash of their ending.

* P(class | history) is a softmax over hashed features of words: the word before (bigram), the one before that (skip), and
  both (trigram), and over the topic. Its tables have more buckets as there are more training tokens, up to a bound.
* The topic of a history is that of most of the frequent words among the last 16; frequent words get their topics by
  spectral clustering of which of them follow one another.
* P(word | class, topic) is a softmax of its own: a weight for each word and topic over the word's share in its class. These
  weights stand in tables that grow with the vocabulary, by hash of the word.

1. encode: texts are read and cut into tokens once. Chunks of texts, as token numbers in the chunk's own vocabulary, are
   written to the shared folder, with the words that are frequent in them. A hash of its id puts a text into one of STEPS
   parts; a chunk is of one part.
2. topics: words that may be frequent are counted in all chunks; successions of those that are, are summed and clustered.
3. count: a chunk sends its distinct words, by hash (64 bits stand for a word), with their training counts by topic. They
   are summed where they meet; each chunk gets its words' totals back in the order it sent them.
4. fit: distributed gradient steps. The class softmax takes one step for each part of the training tokens: a task sums the
   gradient of its chunks under the broadcast weights, slices of the gradients are summed by a shuffle, and Adagrad scales
   them. The word weights then take theirs under sums over each class and topic, which all tables make together.
5. score: a chunk meets its words' totals and is scored in numpy, a block of tokens at a time.

Nothing but the order of floating point sums depends on how rows lie in partitions: scores of two layouts agree.

What reaches the driver or is broadcast (frequent words, successions, class weights, sums by class and topic) has a fixed
bound; word counts and weights stay in tables that grow with the corpus.

Edge cases: a null text is empty; an empty text is its end alone; a null id trains; repeated rows each count and each get a
row; without training tokens all words are unknown and the base score is 0; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm.common import id_mod, scratch_path, shuffle_buckets

#: A word is a class of its own, or has a topic of its own, from these shares of all training tokens on.
CLASS_SHARE, TOPIC_SHARE = 1 / 96, 1 / 1024
TAILS, TOPICS, WINDOW = 20, 8, 16
#: Buckets of the bigram and skip tables, twice as many of the trigram's: one for so many training tokens, within bounds.
TOKENS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1 << 14, 1 << 10, 1 << 14
CHUNK_BYTES, BLOCK = 8 << 20, 1 << 16
STEPS, RATE, SLICES = 4, 0.25, 8
WORD_STEPS, WORD_RATE, RIDGE = 2, 0.2, 0.05
END = np.uint64(0xE0D0E0D0E0D0E0D0)
START_ID, END_ID = np.uint32(0x51A27), np.uint32(0xE0D0E0D0)

ENCODED = "kind int, step int, chunk long, docs array<long>, held binary, sizes binary, codes binary, names binary, tails binary, payload binary"


def word_hash(word: bytes) -> int:
    return xxh64_intdigest(word, 8)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts, the number among them of each word, and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    flat = lists.flatten()
    n = np.diff(lists.offsets.to_numpy())
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    words = coded.dictionary
    empty = pc.index(words, "").as_py()
    if empty >= 0:
        real = codes != empty
        n = np.bincount(np.repeat(np.arange(len(n)), n)[real], minlength=len(n))
        codes = codes[real]
        codes[codes > empty] -= 1
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return words, codes, n


def _row(**values) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "step": pa.int32(), "chunk": pa.int64(), "docs": pa.list_(pa.int64())}
    names = [c.split(" ")[0] for c in ENCODED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], kinds.get(n, pa.binary())) for n in names], names)


def encode(docs: DataFrame, held: Column) -> DataFrame:
    """kind 0: chunks of encoded texts, their words in order of hash; kind 1: their number of training tokens and words, and
    the words that are frequent in them (hash, training count, ending)."""

    def chunk_rows(part: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        words, codes, n = tokens(part.column("text").combine_chunks())
        out = part.column("held").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        raw = words.cast(pa.large_binary()).to_pylist()
        h = np.fromiter(map(word_hash, raw), np.uint64, len(raw))
        tails = np.fromiter((crc32(w[-3:]) % TAILS for w in raw), np.uint8, len(raw))
        trained = np.bincount(codes[np.repeat(~out, n)], minlength=len(raw))
        order = np.argsort(h, kind="stable")
        rank = np.empty(len(h), np.uint32)
        rank[order] = np.arange(len(h), dtype=np.uint32)
        h, tails, trained = h[order], tails[order], trained[order]
        step, total = part.column("step")[0].as_py(), int(trained.sum() + (~out).sum())
        yield _row(
            kind=0, step=step, chunk=number, docs=part.column("doc_id").to_pylist(), held=out.tobytes(), sizes=n.astype("<u4").tobytes(),
            codes=rank[codes].tobytes(), names=h.tobytes(), tails=tails.tobytes(),
        )
        some = np.flatnonzero(trained >= max(1, total * TOPIC_SHARE / 2))
        yield _row(kind=1, step=step, chunk=number, payload=total.to_bytes(8, "little") + h[some].tobytes() + trained[some].astype("<u4").tobytes() + tails[some].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held_back, size = [[] for _ in range(STEPS)], [0] * STEPS
        for b in batches:
            some = max(1, int(len(b) * CHUNK_BYTES / max(1, b.column("text").nbytes)))
            for lo in range(0, len(b), some):
                cut = b.slice(lo, some)
                for step in pc.unique(cut.column("step")).to_pylist():
                    held_back[step].append(cut.filter(pc.equal(cut.column("step"), step)))
                    size[step] += held_back[step][-1].column("text").nbytes
                    if size[step] >= CHUNK_BYTES // 2:
                        yield from chunk_rows(pa.Table.from_batches(held_back[step]), number)
                        number, held_back[step], size[step] = number + 1, [], 0
        for rest in filter(None, held_back):
            yield from chunk_rows(pa.Table.from_batches(rest), number)
            number += 1

    step = F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held")).withColumn("step", step)
    return rows.mapInArrow(run, ENCODED)


@dataclass
class Heads:
    """Frequent words, in order of hash: their shares of the training tokens, endings, topics (TOPICS: none)."""

    tokens: int
    hashes: np.ndarray
    counts: np.ndarray
    tails: np.ndarray
    topics: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def own(self) -> np.ndarray:
        """Hashes of the words that are classes of their own."""
        return self.hashes[self.counts >= CLASS_SHARE * self.tokens]

    @property
    def classes(self) -> int:
        """Endings, then the end of a text, then words of their own."""
        return TAILS + 1 + len(self.own)

    @property
    def buckets(self) -> int:
        return int(min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, (self.tokens // TOKENS_A_BUCKET)).bit_length())))

    def class_of(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        at, own = _found(self.own, hashes)
        return np.where(own, TAILS + 1 + at, tails.astype(np.int64))

    def topic_of(self, hashes: np.ndarray) -> np.ndarray:
        at, own = _found(self.hashes, hashes)
        return np.where(own, self.topics[at], TOPICS) if len(self.hashes) else np.full(len(hashes), TOPICS)


def _found(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of some values among known (sorted) ones, and whether they are there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def frequent_words(encoded: DataFrame) -> Heads:
    """Words of at least TOPIC_SHARE of all training tokens, with their exact counts.

    A chunk lists the words of at least half that share of its own tokens, so chunks that don't list a word hold less than
    half the share of all tokens. What is listed less often than the other half can't be frequent; the others, at most
    2 / TOPIC_SHARE words, are counted in all chunks.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0):
                raw = p.as_py()
                k = (len(raw) - 8) // 13
                h, n, tails = np.frombuffer(raw, np.int64, k, 8), np.frombuffer(raw, np.uint32, k, 8 + 8 * k), np.frombuffer(raw, np.uint8, k, 8 + 12 * k).astype(np.int32)
                columns = (np.append(h, 0), np.append(n.astype(np.int64), int.from_bytes(raw[:8], "little")), np.append(tails, -1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "n", "tail"])

    rows = encoded.filter("kind = 1").select("payload").mapInArrow(listed, "h long, n long, tail int").groupBy("h", "tail").agg(F.sum("n").alias("n"))
    total = rows.filter("tail = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    may = rows.filter((F.col("tail") >= 0) & (F.col("n") >= TOPIC_SHARE / 2 * total) & (F.col("n") > 0)).toArrow()
    h = may.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    h, tails = h[order], may.column("tail").to_numpy()[order]
    sent = encoded.sparkSession.sparkContext.broadcast(h)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for row in b.to_pylist():
                held, n, codes, names, _ = _chunk(row)
                at, own = _found(sent.value, names)
                trained = np.bincount(codes[np.repeat(~held, n)], minlength=len(names))
                out[at[own]] += trained[own]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["at", "n"])

    n = np.zeros(len(h), np.int64)
    if len(h):
        sums = encoded.filter("kind = 0").select(*CHUNK).mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        n[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    often = n >= max(1, TOPIC_SHARE * total)
    return Heads(total, h[often], n[often], tails[often])


def _summed(rows: DataFrame) -> DataFrame:
    """slice, payload of float64 vectors: the sum of each slice's."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for p in table.column("payload"):
            x = np.frombuffer(zstandard.decompress(p.as_py()), np.float32)
            total = x.astype(np.float64) if total is None else total + x
        return pa.table({"slice": table.column("slice")[:1], "payload": pa.array([total.tobytes()], pa.binary())})

    return rows.groupBy("slice").applyInArrow(add, "slice int, payload binary")


def _slices(vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k, part in enumerate(np.array_split(vector.ravel(), SLICES)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress(part.astype(np.float32).tobytes(), 1)], pa.binary())], ["slice", "payload"])


def _collected(rows: DataFrame, size: int) -> np.ndarray:
    """The whole summed vector (SLICES rows of a fixed size)."""
    parts = {r["slice"]: np.frombuffer(r["payload"]) for r in _summed(rows).collect()}
    return np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.zeros(size)


CHUNK = "held", "sizes", "codes", "names", "tails"


def _chunk(row: dict) -> tuple[np.ndarray, ...]:
    kinds = {"held": bool, "sizes": np.uint32, "codes": np.uint32, "names": np.uint64, "tails": np.uint8}
    held, n, codes, names, tails = (np.frombuffer(row[k], kinds[k]) for k in CHUNK)
    return held, n.astype(np.int64), codes, names, tails


def topics(encoded: DataFrame, heads: Heads) -> np.ndarray:
    """A topic for each frequent word: those that follow one another (other words aside) are put together. A spectral
    embedding of their successions, cut into TOPICS by k-means from far apart starts."""
    k = len(heads.hashes)
    if k <= TOPICS:
        return np.arange(k)
    sent = encoded.sparkSession.sparkContext.broadcast(heads.hashes)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for b in batches:
            for row in b.to_pylist():
                held, n, codes, names, _ = _chunk(row)
                at, own = _found(sent.value, names)
                keep = np.repeat(~held, n) & own[codes]
                text, word = np.repeat(np.arange(len(n)), n)[keep], at[codes][keep]
                same = text[1:] == text[:-1]
                total += np.bincount(word[:-1][same] * k + word[1:][same], minlength=k * k)
        yield from _slices(total)

    seen = _collected(encoded.filter("kind = 0").select(*CHUNK).mapInArrow(follow, "slice int, payload binary"), k * k).reshape(k, k)
    both = seen + seen.T + 1e-3
    scale = 1 / np.sqrt(both.sum(axis=1))
    _, vectors = np.linalg.eigh(both * scale[:, None] * scale[None, :])
    x = vectors[:, ::-1][:, :TOPICS]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = [x[int(heads.counts.argmax())]]
    while len(centres) < TOPICS:
        centres.append(x[int(np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0).argmax())])
    centres = np.array(centres)
    for _ in range(30):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[near == t].mean(axis=0) if (near == t).any() else centres[t] for t in range(TOPICS)])
    return near


def histories(ids: np.ndarray, topic: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' words (32 bit names and topics) with an end after each: the name before each token, the one before that, and
    the topic of the words before."""
    ends = np.cumsum(n + 1) - 1
    size = int((n + 1).sum())
    body = np.ones(size, bool)
    body[ends] = False
    first, name = ends - n, np.full(size, END_ID)
    name[body] = ids
    before, skip = np.full(size, START_ID), np.full(size, START_ID)
    before[1:], skip[2:] = name[:-1], name[:-2]
    before[first] = START_ID
    skip[first] = START_ID
    second = first + 1
    skip[second[second <= ends]] = START_ID
    votes = np.zeros((size + 1, TOPICS), np.int32)
    told = np.flatnonzero(body)[topic < TOPICS]
    votes[told + 1, topic[topic < TOPICS]] = 1
    np.cumsum(votes, axis=0, out=votes)
    at = np.arange(size)
    start = np.maximum(at - WINDOW, np.repeat(first, n + 1))
    votes = votes[at] - votes[start]
    best = votes.argmax(axis=1)
    return before, skip, np.where(votes[at, best] > 0, best, TOPICS)


def _tokens(row: dict, heads: Heads, training: bool) -> tuple[np.ndarray, ...]:
    """Of a chunk's tokens (training ones only): word number (the number of words for an end), class, and histories."""
    held, n, codes, names, tails = _chunk(row)
    if training:
        codes, n = codes[np.repeat(~held, n)], n[~held]
    ends = np.cumsum(n + 1) - 1
    word = np.full(int((n + 1).sum()), len(names), np.int64)
    body = np.ones(len(word), bool)
    body[ends] = False
    word[body] = codes
    short = (names >> np.uint64(32)).astype(np.uint32)
    of = np.append(heads.class_of(names, tails), TAILS)
    return word, of[word], *histories(short[codes], heads.topic_of(names)[codes], n)


WORDS = "place int, chunk long, payload binary"


def word_counts(encoded: DataFrame, heads: Heads, places: int) -> DataFrame:
    """Each chunk's distinct words by place: n, then hashes, endings, training counts by topic."""
    sent = encoded.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                word, _, _, _, topic = _tokens(row, sent.value, True)
                names, tails = np.append(np.frombuffer(row["names"], np.uint64), END), np.append(np.frombuffer(row["tails"], np.uint8), np.uint8(TAILS))
                counts = np.bincount(word * (TOPICS + 1) + topic, minlength=len(names) * (TOPICS + 1)).astype(np.uint32).reshape(len(names), -1)
                place = _place(names, places)
                order = np.argsort(place, kind="stable")
                for w in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                    raw = zstandard.compress(names[w].tobytes() + tails[w].tobytes() + np.ascontiguousarray(counts[w].T).tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([int(place[w[0]])], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([raw], pa.binary())], ["place", "chunk", "payload"])

    return encoded.filter("kind = 0").select("chunk", *CHUNK).mapInArrow(run, WORDS)


def _place(names: np.ndarray, places: int) -> np.ndarray:
    return ((names >> np.uint64(11)) % np.uint64(places)).astype(np.int64)


COUNTED = "kind int, chunk long, place int, payload binary"


def count(table: pa.Table, heads: Heads) -> pa.Table:
    """kind 0: for a chunk, its words' classes and training counts by topic; 1: distinct known words' classes and counts."""
    width, place = TOPICS + 1, table.column("place")[0].as_py()
    raw = [zstandard.decompress(p.as_py()) for p in table.column("payload")]
    size = np.array([len(p) // (9 + 4 * width) for p in raw])
    h = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(raw, size, strict=True)])
    tails = np.concatenate([np.frombuffer(p, np.uint8, n, 8 * n) for p, n in zip(raw, size, strict=True)])
    counts = np.concatenate([np.frombuffer(p, np.uint32, n * width, 9 * n).reshape(width, n).T for p, n in zip(raw, size, strict=True)])
    order = np.argsort(h)
    first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    total = np.add.reduceat(counts[order].astype(np.uint64), first, axis=0) if len(h) else counts.astype(np.uint64)
    of = np.empty(len(h), np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    classes = heads.class_of(h[order][first], tails[order][first]).astype(np.uint8)
    pack = lambda w: zstandard.compress(classes[w].tobytes() + np.ascontiguousarray(total[w].T).tobytes(), 1)
    ends = np.cumsum(size)
    rows = [(0, int(c), place, pack(of[e - n : e])) for c, n, e in zip(table.column("chunk").to_pylist(), size, ends, strict=True)]
    rows.append((1, None, place, pack(np.flatnonzero(total.sum(axis=1) > 0))))
    kinds, names = (pa.int32(), pa.int64(), pa.int32(), pa.binary()), [c.split(" ")[0] for c in COUNTED.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def _counted(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Classes and counts by topic of some words."""
    raw = zstandard.decompress(raw)
    n = len(raw) // (1 + 8 * (TOPICS + 1))
    return np.frombuffer(raw, np.uint8, n).astype(np.int64), np.frombuffer(raw, np.int64, n * (TOPICS + 1), n).reshape(TOPICS + 1, n).T


@dataclass
class Words:
    """P(word | class, topic): totals by class (and topic), and of each step the sums that the next weights need.

    A word's weight by topic starts from its smoothed share there and takes gradient steps. Its course follows from its own
    counts and these sums, so weights aren't stored: whoever has a word's counts has its weights.
    """

    tokens: int
    distinct: int
    by_class: np.ndarray
    words: np.ndarray
    by_topic: np.ndarray
    sums: list[np.ndarray] = field(default_factory=list)

    def share(self, classes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of a word in its class, smoothed; one share is for all unknown words."""
        return (n + 0.5) / (self.by_class + 0.5 * (self.words + 1))[classes]

    def weights(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each word's weight by topic, after as many steps as there are sums."""
        n = counts.sum(axis=1)
        q = self.share(classes, n)[:, None]
        prior = 0.5 * (self.words + 1)[classes][:, None]
        of = self.by_topic[classes]
        known = (n > 0)[:, None]
        start = np.where(known, counts + prior * q, 0.5) / (of + prior + 0.5)
        out = np.log(start / q)
        for z in self.sums:
            p = q * np.exp(out) / z[classes]
            out = out + np.where(known, WORD_RATE * (counts - of * p - RIDGE * out) / (counts + of * p + 1), 0.0)
        return out

    def masses(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """By class and topic, the sum of share times exp(weight) of some words."""
        mass = self.share(classes, counts.sum(axis=1))[:, None] * np.exp(self.weights(classes, counts))
        return np.stack([np.bincount(classes, mass[:, t], len(self.words)) for t in range(TOPICS + 1)], axis=1)

    def unknown(self) -> np.ndarray:
        """The same for the unknown word of each class."""
        every = np.arange(len(self.words))
        return self.masses(every, np.zeros((len(every), TOPICS + 1)))

    def log_words(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """ln P(word | class, topic), a column for each topic. The last sums normalise."""
        last = Words(self.tokens, self.distinct, self.by_class, self.words, self.by_topic, self.sums[:-1])
        return np.log(last.share(classes, counts.sum(axis=1)))[:, None] + last.weights(classes, counts) - np.log(self.sums[-1][classes])


def fit_words(counted: DataFrame, heads: Heads, steps: int = WORD_STEPS) -> Words:
    """Sums over all tables of known words, once for each gradient step and once to normalise."""
    known, size = counted.filter("kind = 1").select("payload"), (heads.classes, TOPICS + 1)

    def summed(each) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for p in b.column(0):
                    x = each(*_counted(p.as_py()))
                    total = x if total is None else total + x
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(total.ravel()), pa.array(np.arange(total.size))], ["x", "at"])

        got = known.mapInArrow(run, "x double, at long").groupBy("at").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(max(size[0] * (size[1] + 1), max((r["at"] + 1 for r in got), default=0)))
        for r in got:
            out[r["at"]] = r["x"]
        return out

    by = lambda classes, counts: np.stack([np.bincount(classes, counts[:, t], size[0]) for t in range(size[1])] + [np.bincount(classes, minlength=size[0])], axis=1)
    base = summed(by).reshape(size[0], size[1] + 1)
    model = Words(int(base[:, :-1].sum()), int(base[:, -1].sum()), base[:, :-1].sum(axis=1), base[:, -1], base[:, :-1])
    for _ in range(steps + 1):
        sent = counted.sparkSession.sparkContext.broadcast(model)
        z = summed(lambda classes, counts: sent.value.masses(classes, counts))[: size[0] * size[1]].reshape(size) + model.unknown()  # noqa: B023
        model = Words(model.tokens, model.distinct, model.by_class, model.words, model.by_topic, [*model.sums, z])
    return model


class ClassModel:
    """Weights of bigram, skip, trigram and topic features by class."""

    def __init__(self, classes: int, buckets: int, bias: np.ndarray, topic: np.ndarray):
        self.classes, self.buckets, self.bias, self.topic = classes, buckets, bias.astype(np.float32), topic.astype(np.float32)
        self.weights = [np.zeros((n, classes), np.float32) for n in (buckets, buckets, 2 * buckets)]

    @property
    def size(self) -> int:
        return sum(w.size for w in self.weights)

    def features(self, before: np.ndarray, skip: np.ndarray) -> list[np.ndarray]:
        a, b = before.astype(np.uint64), skip.astype(np.uint64)
        both = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
        one = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(self.buckets)
        return [one(a).astype(np.int64), one(b).astype(np.int64), ((both >> np.uint64(29)) % np.uint64(2 * self.buckets)).astype(np.int64)]

    def log_classes(self, before: np.ndarray, skip: np.ndarray, topic: np.ndarray) -> np.ndarray:
        """ln P(class | history), a row for each token."""
        logits = self.bias + self.topic[topic]
        for w, f in zip(self.weights, self.features(before, skip), strict=True):
            logits += w[f]
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logits

    def gradient(self, target: np.ndarray, before: np.ndarray, skip: np.ndarray, topic: np.ndarray, out: list[np.ndarray], seen: list[np.ndarray]) -> None:
        """Adds the gradient of the log likelihood of tokens' classes by weights, and how often each feature occurs."""
        rest = -np.exp(self.log_classes(before, skip, topic))
        rest[np.arange(len(target)), target] += 1
        for g, n, f in zip(out, seen, self.features(before, skip), strict=True):
            order = np.argsort(f, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(f[order]) != 0))
            g[f[order][first]] += np.add.reduceat(rest[order], first, axis=0, dtype=np.float64)
            n[f[order][first]] += np.diff(np.append(first, len(f)))


def fit_classes(encoded: DataFrame, heads: Heads, words: Words, steps: int = STEPS) -> ClassModel:
    """Starts from the classes' shares by topic, then takes a distributed gradient step over each part of the tokens."""
    spark, size = encoded.sparkSession, heads.classes
    unigram = words.by_class + 0.5
    bias = np.log(unigram / unigram.sum())
    share = (words.by_topic.T + 50 * np.exp(bias)) / (words.by_topic.sum(axis=0)[:, None] + 50)
    model = ClassModel(size, heads.buckets, bias, np.log(share) - bias)
    if not words.tokens:
        return model
    squares = [np.zeros(w.shape) for w in model.weights]
    for step in range(steps):
        sent = spark.sparkContext.broadcast((model, heads))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, known = sent.value  # noqa: B023
            out, seen = [np.zeros(w.shape) for w in m.weights], [np.zeros(len(w)) for w in m.weights]
            some = False
            for b in batches:
                for row in b.to_pylist():
                    _, target, before, skip, topic = _tokens(row, known, True)
                    some |= len(target) > 0
                    for lo in range(0, len(target), BLOCK):
                        cut = slice(lo, lo + BLOCK)
                        m.gradient(target[cut], before[cut], skip[cut], topic[cut], out, seen)
            if some:
                yield from _slices(np.concatenate([x.ravel() for x in (*out, *seen)]))

        part = encoded.filter((F.col("kind") == 0) & (F.col("step") == step % STEPS)).select(*CHUNK).mapInArrow(run, "slice int, payload binary")
        total = _collected(part, model.size + sum(len(w) for w in model.weights))
        sent.unpersist()
        at, ends = 0, model.size
        for w, square in zip(model.weights, squares, strict=True):
            g, n = total[at : at + w.size].reshape(w.shape), total[ends : ends + len(w)]
            at, ends = at + w.size, ends + len(w)
            g = (g - w) / (n[:, None] + 50)
            square += g * g
            w += (RATE * g / (np.sqrt(square) + 1e-2)).astype(np.float32)
    return model


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(encoded: DataFrame, counted: DataFrame, heads: Heads, words: Words, classes: ClassModel, places: int) -> DataFrame:
    """A row for each document: see RESULT."""
    sent = encoded.sparkSession.sparkContext.broadcast((heads, words, classes))

    def run(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        return pa.concat_tables([scored(row, replies.filter(pc.equal(replies.column("chunk"), row["chunk"]))) for k in range(len(chunks)) for row in chunks.slice(k, 1).to_pylist()])

    def scored(one: dict, replies: pa.Table) -> pa.Table:
        known, w, m = sent.value
        held, n, _, names, _ = _chunk(one)
        names = np.append(names, END)
        told = sorted(zip(replies.column("place").to_pylist(), replies.column("payload").to_pylist(), strict=True))
        parts = [_counted(p) for _, p in told]
        order = np.argsort(_place(names, places), kind="stable")
        of, counts = np.empty(len(names), np.int64), np.empty((len(names), TOPICS + 1), np.int64)
        of[order], counts[order] = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        total = counts.sum(axis=1)
        word, _, before, skip, topic = _tokens(one, known, False)
        by_word = w.log_words(of, counts).astype(np.float32)
        own = np.empty(len(word))
        for lo in range(0, len(word), BLOCK):
            cut = slice(lo, lo + BLOCK)
            own[cut] = m.log_classes(before[cut], skip[cut], topic[cut])[np.arange(len(word[cut])), of[word[cut]]]
        own += by_word[word, topic]
        first = np.cumsum(n + 1) - (n + 1)
        base = np.log10(total + 0.5) - math.log10(w.tokens + 0.5 * (w.distinct + 1))
        by_doc = lambda x: np.add.reduceat(x, first)
        columns = [one["docs"], held, n + 1, by_doc((total > 0)[word].astype(np.int64)), np.full(len(n), w.tokens), by_doc(base[word]), by_doc(own) / math.log(10)]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in RESULT.split(", ")])

    # Chunks are numbered by part; a stride for each part deals them out evenly, where a hash would heap some.
    parts = encoded.filter("kind = 1").agg(F.coalesce(F.max(F.shiftright("chunk", 32)), F.lit(0))).first()[0] + 1
    n = 2 * places
    spot = F.pmod(F.shiftright("chunk", 32) * max(1, n // parts) + F.col("chunk").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(n)).cast("int").alias("spot")
    at = lambda df: df.repartitionById(n, F.col("spot")).groupBy("spot")
    chunks = encoded.filter("kind = 0").select(spot, "chunk", "docs", *CHUNK)
    replies = counted.filter("kind = 0").select(spot, "chunk", "place", "payload")
    return at(chunks).cogroup(at(replies)).applyInArrow(run, RESULT)


@dataclass
class Fitted:
    """All that scoring needs."""

    encoded: DataFrame
    counted: DataFrame
    heads: Heads
    words: Words
    classes: ClassModel
    places: int


def fit(docs: DataFrame, held: Column | None = None, steps: int = STEPS) -> Fitted:
    """A model of the documents (doc_id, text) that aren't held out, and the tables of all of them."""
    spark, places = docs.sparkSession, shuffle_buckets(docs.sparkSession)
    path = scratch_path(spark, "encoded")
    encode(docs, id_mod("doc_id", 5) == 1 if held is None else held).write.partitionBy("kind", "step").option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(ENCODED).parquet(path)
    heads = frequent_words(encoded)
    heads.topics = topics(encoded, heads)
    path = scratch_path(spark, "counted")
    sent = word_counts(encoded, heads, places).repartitionById(places, F.col("place"))
    sent.groupBy("place").applyInArrow(lambda t: count(t, heads), COUNTED).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    counted = spark.read.schema(COUNTED).parquet(path)
    words = fit_words(counted, heads)
    return Fitted(encoded, counted, heads, words, fit_classes(encoded, heads, words, steps), places)


def score_documents(docs: DataFrame, held: Column | None = None, steps: int = STEPS) -> DataFrame:
    """docs (doc_id, text) scored by a model of those that aren't held out: see RESULT."""
    f = fit(docs, held, steps)
    return score(f.encoded, f.counted, f.heads, f.words, f.classes, f.places)
