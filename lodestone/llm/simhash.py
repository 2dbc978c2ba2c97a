r"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming verification and connected components.

Fingerprints of 64 bits are taken over XXH64 hashes of word shingles in Arrow batches. Equal fingerprints are first
collapsed to one node each, so that groups of copies of any size cost one row. Nodes are cut into `blocks` bit blocks;
two that differ in at most `distance` bits agree on blocks - distance of them at least (pigeonhole), so every choice
of that many blocks is a join key. Pairs that meet are verified by the Hamming distance of the whole fingerprint.

A key that many nodes share (a group of near copies) isn't joined with itself. There the rest of the bits is split
further: each node is sent to every value within distance / 2 flips of its own, and nodes that meet in a value are at
most `distance` apart, so linking each to the smallest of them is exact, and its size is linear in the group's.

Components come from alternating large-star and small-star rounds, whose tables are written to the shared folder each
round; no link, component or fingerprint is collected.

Edge cases: a null text is empty; texts without words have fingerprint zero and are linked like any other; a null id
never becomes a component's id unless all its ids are null; repeated rows each get a row (`keep_one` keeps one of them);
an empty table gives an empty result; extra columns are ignored (`keep_one` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from lodestone.llm.common import materialise

SEED, SHINGLE, DISTANCE, BLOCKS = 42, 3, 2, 4
#: A block key of more nodes than this is split by bit flips instead of being paired.
MOST_PAIRED = 32


def shingles(text: str | None, k: int = SHINGLE) -> list[bytes]:
    """Space-joined k-word shingles, repeats included; of fewer words the whole sequence; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(k)), strict=False)]


def fingerprints(texts: list[str | None], k: int = SHINGLE) -> np.ndarray:
    """An unsigned 64 bit fingerprint for each text: a bit is set if it is in over half the shingles' hashes."""
    out = np.zeros(len(texts), np.uint64)
    for at, text in enumerate(texts):
        bits, n = np.zeros(64, np.int64), 0
        grams = shingles(text, k)
        for lo in range(0, len(grams), 16384):
            part = grams[lo : lo + 16384]
            raw = np.frombuffer(b"".join([xxh64_digest(g, SEED) for g in part]), np.uint8).reshape(-1, 8)
            bits += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
            n += len(part)
        if n:
            out[at] = np.packbits(bits * 2 > n).view(">u8")[0]
    return out


def fingerprint_table(docs: DataFrame, k: int = SHINGLE, *others: Column) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long), and other columns of longs, a row for each document; map-only."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array(fingerprints(b.column("text").to_pylist(), k).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fps, *b.columns[2:]], names)

    rows = docs.select("doc_id", "text", *others)
    names = ["doc_id", "fp", *rows.columns[2:]]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, ", ".join([f"doc_id {kind}", *[f"{n} long" for n in names[1:]]]))


def _bounds(blocks: int) -> list[tuple[int, int]]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _mask(bounds: list[tuple[int, int]]) -> int:
    value = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in bounds)
    return value - (1 << 64) if value >= 1 << 63 else value


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, most_paired: int = MOST_PAIRED) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) whose components are those of all pairs at most
    `distance` bits apart; each link is itself such a pair."""
    if not 0 < distance < blocks:
        raise ValueError("blocks must be more than distance, and distance more than 0")
    choices = list(combinations(_bounds(blocks), blocks - distance))
    masks = [_mask(list(c)) for c in choices]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)])
    sent = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.key")
    sizes = sent.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low")).filter("n > 1")
    sizes = materialise(sizes, "block_sizes")
    met = materialise(sent.join(sizes, ["choice", "key"]), "blocks")

    few = met.filter(F.col("n") <= most_paired)
    apart = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    paired = few.alias("x").join(few.alias("y"), (F.col("x.choice") == F.col("y.choice")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (apart <= distance))
    paired = paired.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    many = met.filter(F.col("n") > most_paired)
    starred = many.select("choice", "key", "fp", F.explode(_flips(masks, distance)).alias("value"))
    least_of = starred.groupBy("choice", "key", "value").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    star = starred.join(least_of, ["choice", "key", "value"]).filter(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return paired.unionByName(star).distinct()


def _flips(masks: list[int], distance: int):
    """All values within distance / 2 flips of fp outside the choice's key. Two nodes at most `distance` apart meet in
    one of them, and two that meet are no further apart; for an odd distance both can't hold, so it is refused."""
    if distance % 2:
        raise ValueError("an even distance is needed to split keys that many fingerprints share")
    cases = None
    for i, m in enumerate(masks):
        rest = [b for b in range(64) if not (m >> b) & 1]
        flips = [0]
        for r in range(1, distance // 2 + 1):
            flips += [reduce(lambda x, y: x | (1 << y), c, 0) for c in combinations(rest, r)]
        signed = [v - (1 << 64) if v >= 1 << 63 else v for v in flips]
        values = F.transform(F.array(*[F.lit(v).cast("long") for v in signed]), lambda v: F.col("fp").bitwiseXOR(v))
        cases = F.when(F.col("choice") == i, values) if cases is None else cases.when(F.col("choice") == i, values)
    return cases


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links -> node, label: the least node that each node with a link can reach.

    Large-star links every larger neighbour of a node to the least node around it, small-star the node's smaller
    neighbours; both keep connectivity, and rounds end when a round changes nothing. Each is two aggregations by node.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        near = large.join(low, "hi")
        small = near.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo")))
        now = materialise(small.filter("hi <> lo").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label"))


def _grouped(fps: DataFrame, distance: int, blocks: int) -> DataFrame:
    """fp, label (its component, by the least node): a row for each distinct fp."""
    nodes = materialise(fps.select("fp").distinct(), "nodes")
    found = components(links(nodes, distance, blocks))
    return nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id that can be reached): a row for each document."""
    fps = materialise(fingerprint_table(docs, k), "fingerprints")
    labelled = _grouped(fps, distance, blocks).join(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp")
    ids = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = materialise(labelled.join(ids, "label").select("fp", "component_id"), "labels")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """docs without all but one row of each component: the one of the smallest id stays; a null id comes last, and rows of
    one id are taken by fingerprint, then by a hash of the text. Of equal rows of this id and text, which may differ in
    other columns, the one of the least hash stays. So every component keeps a row, and reruns keep the same.

    The list of kept rows grows with the corpus, so it is never broadcast: a merge join has the same plan at every size.
    """
    mark = F.xxhash64("text").alias("mark")
    fps = materialise(fingerprint_table(docs, k, mark), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "fp", "mark"))
    best = fps.groupBy("fp").agg(first.alias("r")).join(_grouped(fps, distance, blocks), "fp").groupBy("label").agg(F.min("r").alias("r"))
    kept = materialise(best.select("r.doc_id", "r.mark"), "kept")
    repeated = fps.groupBy("doc_id", "mark").count().filter("count > 1").select("doc_id", "mark")
    repeated = materialise(repeated.alias("x").join(kept.hint("merge").alias("y"), _same("x", "y"), "left_semi"), "repeated")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    one = docs.select("doc_id", F.xxhash64("text").alias("mark"), row).alias("d").join(kept.hint("merge").alias("k"), _same("d", "k"), "left_semi")
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    if repeated.isEmpty():
        return one.select(*own)
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = F.xxhash64(*[F.col("row").getField(c) for c in plain])
    several = one.alias("o").join(repeated.alias("r"), _same("o", "r"), "left_semi").groupBy("doc_id", "mark").agg(F.min_by("row", order).alias("row"))
    return one.alias("o").join(repeated.alias("r"), _same("o", "r"), "left_anti").select(*own).unionByName(several.select(*own))


def _same(x: str, y: str) -> Column:
    return F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.mark") == F.col(f"{y}.mark"))
