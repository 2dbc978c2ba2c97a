r"""Token ids as binary shards with a minimal perfect hash index.

`write` range-partitions documents by id, encodes whole texts, and writes shards in ascending id order. A shard is a
row of Parquet in the shared folder (so that Spark's commit protocol covers lost executors and any file system):

    part, shard     its place: parts are ranges of ids, shards are numbered within a part
    first, last     its least and greatest document id
    before          ids in earlier shards of its part
    docs, ids       how many of each it has
    nulls, keys     how many documents at its start have a null id; the others' ids, raw 64 bit
    payload         raw little-endian 32 bit ids, end ids included, document after document
    index           a minimal perfect hash of its document keys, then by slot: 16 bit fingerprints and 32 bit
                    ordinals; by ordinal: where each document begins and how long it is

A document is found by its shard's range, then with a few probes and one comparison of fingerprints, and no other
document is touched.

Texts are cut where the byte-level pre-tokenizer always cuts: around runs of white space, whose last space goes with
the word behind it, and between ASCII letters, digits and marks. Distinct pieces are encoded many in one call with newlines
between them, and a worker remembers those that occur more than once in a batch, within bounds. This gives the ids of the whole text; texts with white space beyond ASCII or with the tokenizer's added tokens are encoded whole.

Edge cases: null or empty texts are the end id alone; a null id comes first, under a key of its own; rows with one
id are ordered by their texts' hashes and keyed by their turn among them; a text above the shard size has a shard of its own; an empty
table gives no shard; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, scratch_path, shuffle_buckets, sized_broadcast
from lodestone.llm.mph import MinimalPerfectHash, fingerprint, mixed

END_ID = 2
#: Ids in a shard: it is closed when the next document would pass this.
SHARD_IDS = 1 << 18
#: UTF-8 bytes of texts encoded at a time; distinct pieces, and bytes of them, that a Python worker remembers.
BATCH_BYTES, MOST_PIECES, MOST_BYTES = 4 << 20, 400_000, 16 << 20
#: Pieces that are encoded in one call.
JOINED = 1000

SHARD = "part int, shard int, first long, last long, before long, docs int, ids long, nulls int, keys binary, payload binary, index binary"
_ODD_SPACE = regex.compile(r"[^\S\x09-\x0D\x20]")
#: Of bytes: 0 the space, 1 other white space, 2 letters, 3 digits, 4 marks that always end a run of letters or digits,
#: 5 all others (apostrophes can begin a contraction; bytes beyond ASCII may be anything).
_KIND = np.full(256, 5, np.uint8)
_KIND[32] = 0
_KIND[9:14] = 1
_KIND[[b for b in range(33, 127) if b != 39]] = 4
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[48:58] = 3
#: Whether a piece begins between two kinds (first times 6, plus second), runs of white space aside.
_CUT = np.zeros(36, bool)
for _a in range(6):
    for _b in range(6):
        _CUT[6 * _a + _b] = (_a > 1 >= _b) or (_a == 1 < _b) or (1 < _a < 5 and 1 < _b < 5 and _a != _b)


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library, with a bounded memory of pieces."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        single = self.whole(["\n"])[0]
        self.newline = single[0] if len(single) == 1 else None
        self.known: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.held = 0
        self.flat, self.filled = np.empty(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.empty(MOST_PIECES, np.int64), np.empty(MOST_PIECES, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, at: int, ids: np.ndarray, n: np.ndarray) -> None:
        """Ids of pieces numbered from `at` on."""
        while self.filled + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), np.uint32)])
        if at + len(n) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty(len(x) + len(n), np.int64)]) for x in (self.starts, self.lengths))
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.starts[at : at + len(n)] = self.filled + np.cumsum(n) - n
        self.lengths[at : at + len(n)] = n
        self.filled += len(ids)

    def _codes(self, pieces: list[bytes], often: np.ndarray) -> tuple[np.ndarray, int]:
        """The number of each of some distinct pieces, encoding those that aren't known; of these only those that occur often
        are remembered. Then how many ids those take: what lies behind may be overwritten by the next call."""
        if len(self.known) > MOST_PIECES or self.held > MOST_BYTES:
            self.forget()
        find, at = self.known.get, len(self.known)
        codes = np.fromiter((find(p, -1) for p in pieces), np.int64, len(pieces))
        for some in (often, ~often):
            new = np.flatnonzero((codes < 0) & some).tolist()
            alone = [i for i in new if not pieces[i].strip() or self.newline is None]
            if alone:
                rows, skip = self.whole([pieces[i].decode("utf-8") for i in alone]), set(alone)
                n = np.array([len(r) for r in rows], np.int64)
                self._store(at, np.fromiter((i for r in rows for i in r), np.uint32, int(n.sum())), n)
                codes[alone] = np.arange(at, at + len(alone))
                at, new = at + len(alone), [i for i in new if i not in skip]
            for lo in range(0, len(new), JOINED):
                part = new[lo : lo + JOINED]
                ids = np.array(self.whole([b"\n".join([pieces[i] for i in part]).decode("utf-8")])[0], np.uint32)
                gaps = np.flatnonzero(ids == self.newline)
                if len(gaps) != len(part) - 1:
                    raise ValueError("a piece holds the newline's id")
                self._store(at, ids[ids != self.newline], np.diff(np.concatenate([[-1], gaps, [len(ids)]])) - 1)
                codes[part] = np.arange(at, at + len(part))
                at += len(part)
            if some is often:
                kept, learnt = self.filled, [i for i in (*alone, *new)]
                self.known.update((pieces[i], int(codes[i])) for i in learnt)
                self.held += sum(len(pieces[i]) for i in learnt)
        return codes, kept

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end ids included, and how many each text has."""
        texts = [t or "" for t in texts]
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self.added) or not t.isascii() and _ODD_SPACE.search(t)]
        plain = [t.encode("utf-8") for t in texts]
        for i in odd:
            plain[i] = b""
        sizes = np.array([len(p) for p in plain], np.int64)
        data = np.frombuffer(b"".join(plain), np.uint8)
        edges = np.cumsum(sizes)
        texts_at = (edges - sizes)[sizes > 0]
        kind = _KIND[data]
        pair = kind[:-1] * np.uint8(6) + kind[1:]
        begins = np.ones(len(data), bool)
        begins[1:] = _CUT[pair]
        run = np.flatnonzero((pair < 8) & (kind[1:] < 2)) + 1  # white space behind white space
        begins[texts_at] = True
        if len(run):  # the last of a run begins a piece if something of the same text follows
            ends_text = np.isin(run + 1, edges)
            follows = ~ends_text & (kind[np.minimum(run + 1, len(kind) - 1)] > 1)
            begins[run] = follows | np.isin(run, texts_at)
        at = np.flatnonzero(begins)
        del kind, pair, begins, run, plain
        if len(at):
            offsets = np.append(at, len(data)).astype(np.int32)
            cut = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            indices = cut.indices.to_numpy()
            numbers, kept = self._codes(cut.dictionary.to_pylist(), np.bincount(indices, minlength=len(cut.dictionary)) > 1)
            codes = numbers[indices]
            del cut, indices, offsets
            n = self.lengths[codes]
            ends = np.cumsum(n)
            ids = self.flat[np.repeat((self.starts[codes] - (ends - n)).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)]
            per_text = np.diff(np.append(0, ends)[np.searchsorted(at, np.append(0, edges))])
            self.filled = kept
        else:
            ids, per_text = np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        if odd:
            rows, split = self.whole([texts[i] for i in odd]), np.split(ids, np.cumsum(per_text)[:-1])
            for i, row in zip(odd, rows, strict=True):
                split[i], per_text[i] = np.array(row, np.uint32), len(row)
            ids = np.concatenate(split)
        total = per_text + 1
        out = np.empty(int(total.sum()), np.uint32)
        last = np.cumsum(total) - 1
        body = np.ones(len(out), bool)
        body[last] = False
        out[body], out[last] = ids, self.end_id
        return out, total


_CODERS: dict[tuple[str, int], Encoder] = {}


def kept_encoder(path: str, end_id: int = END_ID) -> Encoder:
    """This process's encoder of a tokenizer: Python workers run many tasks, and what one learnt serves the next."""
    if (path, end_id) not in _CODERS:
        _CODERS.clear()
        _CODERS[path, end_id] = Encoder(path, end_id)
    return _CODERS[path, end_id]


def document_keys(ids: list[int | None]) -> np.ndarray:
    """A 64 bit key for each of a shard's documents, in order: of its id, and of its turn among rows of that id."""
    seen: dict[int | None, int] = {}
    turns = np.empty(len(ids), np.uint64)
    for at, i in enumerate(ids):
        turns[at] = seen.get(i, 0)
        seen[i] = int(turns[at]) + 1
    return keys_of(ids, turns)


def keys_of(ids: list[int | None], turns: np.ndarray) -> np.ndarray:
    plain = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
    null = np.array([i is None for i in ids], bool)
    extra = turns + (null.astype(np.uint64) << np.uint64(63))
    return np.where(extra == 0, plain, mixed(plain ^ mixed(extra, 77), 78))


def pack(ids: list[int | None], tokens: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """A shard's payload and index."""
    keys = document_keys(ids)
    mph = MinimalPerfectHash.build(keys)
    slots = mph.slots(keys)
    prints, ordinals = np.empty(len(ids), "<u2"), np.empty(len(ids), "<u4")
    prints[slots], ordinals[slots] = fingerprint(keys), np.arange(len(ids))
    starts = np.cumsum(counts) - counts
    table = prints.tobytes() + ordinals.tobytes() + starts.astype("<u4").tobytes() + counts.astype("<u4").tobytes()
    return tokens.astype("<u4").tobytes(), len(ids).to_bytes(4, "little") + table + mph.to_bytes()


class Shard:
    """Keyed access to a shard's ids."""

    def __init__(self, payload: bytes, index: bytes):
        n = int.from_bytes(index[:4], "little")
        at = 4
        self.prints, at = np.frombuffer(index, "<u2", n, at), at + 2 * n
        self.ordinals, at = np.frombuffer(index, "<u4", n, at), at + 4 * n
        self.starts, at = np.frombuffer(index, "<u4", n, at), at + 4 * n
        self.counts, at = np.frombuffer(index, "<u4", n, at), at + 4 * n
        self.mph, self.payload = MinimalPerfectHash.from_bytes(index[at:]), payload

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's ordinal, or -1 if no document has it."""
        slots = self.mph.slots(keys)
        hit = slots >= 0
        hit[hit] = self.prints[slots[hit]] == fingerprint(keys[hit])
        out = np.full(len(keys), -1, np.int64)
        out[hit] = self.ordinals[slots[hit]]
        return out

    def raw(self, ordinal: int) -> memoryview:
        lo = 4 * int(self.starts[ordinal])
        return memoryview(self.payload)[lo : lo + 4 * int(self.counts[ordinal])]

    def ids(self, ordinal: int) -> np.ndarray:
        return np.frombuffer(self.raw(ordinal), "<u4")


def write(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> str:
    """Writes docs (doc_id, text) as shards; returns the path. tokenizer: a tokenizers file that all executors have."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    tie = F.xxhash64("text").alias("tie")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie).repartitionByRange(shuffle_buckets(spark), "doc_id", "tie")
    rows = rows.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, shard, before = kept_encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        tokens: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, before, keys, tokens, counts, held
            payload, index = pack(keys, np.concatenate(tokens), np.concatenate(counts))
            real = [k for k in keys if k is not None]
            row = [part, shard, min(real, default=None), max(real, default=None), before, len(keys), held, len(keys) - len(real), np.array(real, "<i8").tobytes(), payload, index]
            shard, before, keys, tokens, counts, held = shard + 1, before + held, [], [], [], 0
            pa.default_memory_pool().release_unused()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        names = [c.split()[0] for c in SHARD.split(", ")]
        for ids, texts in _slices(batches):
            out, n = coder.encode(texts)
            ends = np.cumsum(n)
            lo = 0
            while lo < len(ids):
                room = shard_ids - held + (ends[lo - 1] if lo else 0)
                hi = max(int(np.searchsorted(ends, room, side="right")), lo + (not held))
                if hi > lo:
                    start = int(ends[lo - 1]) if lo else 0
                    keys += ids[lo:hi]
                    tokens.append(out[start : ends[hi - 1]])
                    counts.append(n[lo:hi])
                    held += int(ends[hi - 1]) - start
                if hi < len(ids):
                    yield close()
                lo = hi
        if keys:
            yield close()

    shards = rows.mapInArrow(encode, SHARD)
    shards.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return path


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """ids and texts of at most BATCH_BYTES of text, or one document, at a time."""
    for b in batches:
        sizes = np.diff(np.frombuffer(b.column("text").buffers()[1], np.int32, len(b) + 1, 4 * b.column("text").offset)) if len(b) else []
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(b)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = b.slice(int(lo), int(hi - lo))
            yield part.column("doc_id").to_pylist(), part.column("text").to_pylist()


def part_starts(shards: DataFrame) -> DataFrame:
    """part, base: ids in all earlier parts. One row for each range partition, which bounds its size."""
    per = shards.groupBy("part").agg(F.sum("ids").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))


def listed(nulls: int, keys: bytes) -> list[int | None]:
    """The ids of a shard's documents, in order."""
    return [None] * nulls + np.frombuffer(keys, "<i8").tolist()


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32: a row for each document, each found in the
    shards at `path` by its key."""
    shards = spark.read.parquet(path)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(len(b)):
                part, before, nulls, keys, payload, index = (c[row].as_py() for c in b.columns)
                ids, shard = listed(nulls, keys), Shard(payload, index)
                found = shard.find(document_keys(ids))
                if (found < 0).any():
                    raise ValueError(f"part {part} has documents that its index doesn't find")
                crcs = [zlib.crc32(shard.raw(i)) for i in found]
                columns = [np.full(len(ids), part, np.int32), ids, before + shard.starts[found].astype(np.int64), shard.counts[found].astype(np.int64), crcs]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "doc_id", "own", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "before", "nulls", "keys", "payload", "index").mapInArrow(look_up, "part int, doc_id long, own long, n_tokens long, ids_crc32 long")
    starts = materialise(part_starts(shards), "parts")
    joined = rows.join(sized_broadcast(starts), "part")
    return joined.select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """doc_id, tokens (array of ids) of those of some ids that have a document: only shards whose range holds one are
    read, and each document by a few probes; its own id is compared then, as a fingerprint alone would let one absent id
    in 65,536 through. The first of rows with one id is returned."""
    wanted = sorted(set(ids))
    near = F.exists(F.array(*[F.lit(i).cast("long") for i in wanted]), lambda i: (F.col("first") <= i) & (F.col("last") >= i))
    shards = spark.read.parquet(path).filter((F.col("first") <= wanted[-1]) & (F.col("last") >= wanted[0]) & near)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(len(b)):
                first, last, nulls, keys, payload, index = (c[row].as_py() for c in b.columns)
                here = [i for i in wanted if first <= i <= last]
                shard, own = Shard(payload, index), listed(nulls, keys)
                found = shard.find(keys_of(here, np.zeros(len(here), np.uint64)))
                hits = [(i, shard.ids(int(o))) for i, o in zip(here, found, strict=True) if o >= 0 and own[o] == i]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in hits], pa.int64()), pa.array([t.tolist() for _, t in hits], pa.list_(pa.int64()))], ["doc_id", "tokens"])

    return shards.select("first", "last", "nulls", "keys", "payload", "index").mapInArrow(find, "doc_id long, tokens array<long>")
