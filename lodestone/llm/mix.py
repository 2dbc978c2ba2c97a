r"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every document has a 60 bit hash of its id. A mix takes k whole copies of each document of a source and one more of
those whose hash lies below the source's threshold, so that a larger target always takes a superset (nested
thresholds) and nothing is sorted. The thresholds come from histograms: words are summed by source and the top 10
bits of the hash, a running sum finds the bucket in which the target falls, and only that bucket is summed again by
the next 10 bits, until it has one document at most. That document is taken if this comes nearer to the target.

Only (id, source, size, hash) is read more than once; it is written to the shared folder once. What is kept for each
source is a few numbers; it is broadcast after being counted, and joined by a shuffle if there are very many sources.

Edge cases: null or empty texts have size 0 and are never copied; a null source is a source of its own, ordered last;
rows with one id share a hash and are taken together; a source without words has target 0; an empty table gives an
empty result; extra columns are ignored by `mix` and kept by `mixed_rows`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, materialise, sized_broadcast

HASH_BITS, LEVEL_BITS = 60, 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(column: Column) -> Column:
    """The first 60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (the source, never null), size, hash: materialised, as the only pass over the texts."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return materialise(docs.select("doc_id", "source", key.alias("key"), word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash")), "sized")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """key, source_size, target: all words shared by weight, no source above most_copies of its size.

    Weights repeat over the sources in code point order. Capped targets free words for the others: ordered by cap per
    unit of weight, the common level is the first that no later source's cap undercuts. Windows here run over one row
    for each source, not over documents.
    """
    per = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(rank) - 1) % len(weights) + 1).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * most_copies)
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    free = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    per = per.withColumn("level", free / F.sum("weight").over(after))
    per = per.withColumn("common", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    return per.select("key", "source_size", F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """key, source_size, target, copies, prefix, bits, last: copies of each document; one more of those whose hash's
    top `bits` bits are below prefix, and of those equal to prefix if last."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = materialise(
        targets.withColumn("copies", whole.cast("long")).select(
            "*",
            F.lit(0).cast("long").alias("prefix"),
            (F.col("target") - F.col("copies") * F.col("source_size")).alias("need"),
            F.lit(0).cast("long").alias("n"),
            F.lit(0).cast("long").alias("words"),
        ),
        "targets",
    )
    sources = state.count()
    for done in range(0, HASH_BITS, LEVEL_BITS):
        open_ = sized_broadcast(state.filter("need > 0").select("key", "prefix"), sources)
        inside = sizes.join(open_, "key").filter(F.shiftright("hash", HASH_BITS - done) == F.col("prefix"))
        bucket = F.shiftright("hash", HASH_BITS - done - LEVEL_BITS).alias("bucket")
        sums = inside.groupBy("key", bucket).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(upto))
        sums = sums.join(sized_broadcast(state.select("key", "need"), sources), "key").filter(F.col("upto") > F.col("need"))
        found = sums.groupBy("key").agg(F.min_by(F.struct("bucket", "words", "n", "upto"), "bucket").alias("b"))
        state = materialise(
            state.join(found, "key", "left").select(
                "key", "source_size", "target", "copies",
                F.coalesce(F.col("b.bucket"), F.shiftleft("prefix", LEVEL_BITS)).alias("prefix"),
                F.coalesce(F.col("need") - (F.col("b.upto") - F.col("b.words")), F.lit(0.0)).alias("need"),
                F.coalesce(F.col("b.n"), F.lit(0)).alias("n"),
                F.coalesce(F.col("b.words"), F.lit(0)).alias("words"),
            ),
            f"level{done}",
        )
        if state.filter("n > 1").isEmpty():
            break
    return state.select("key", "source_size", "target", "copies", "prefix", F.lit(done + LEVEL_BITS).alias("bits"), (F.col("words") - F.col("need") < F.col("need")).alias("last"))


def allot(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: what the mix takes of each document."""
    top = F.call_function("shiftright", F.col("hash"), F.lit(HASH_BITS) - F.col("bits"))
    more = (top < F.col("prefix")) | ((top == F.col("prefix")) & F.col("last"))
    copies = F.when(F.col("size") > 0, F.col("l.copies") + more.cast("long")).otherwise(F.lit(0)).cast("long")
    joined = sizes.join(sized_broadcast(limits).alias("l"), "key")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """The mix of docs (doc_id, text, source): a row for each document with the copies taken."""
    sizes = sized(docs)
    return allot(sizes, thresholds(sizes, source_targets(sizes, weights, most_copies)))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """docs' own rows, each as often as the mix takes it. The texts are read in place and not shuffled: a row's
    copies follow from its own hash and its source's threshold."""
    sizes = sized(docs)
    limits = thresholds(sizes, source_targets(sizes, weights, most_copies)).select("key", "copies", "prefix", "bits", "last")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no column of docs meets one of limits
    own = {c: F.col("row").getField(c) for c in docs.columns}
    rows = docs.select(row).withColumn("key", F.coalesce(F.concat(F.lit("s"), own["source"]), F.lit("n")))
    top = F.call_function("shiftright", id_hash(own["doc_id"]), F.lit(HASH_BITS) - F.col("bits"))
    more = (top < F.col("prefix")) | ((top == F.col("prefix")) & F.col("last"))
    copies = F.when(own["text"].rlike(WORD), F.col("copies") + more.cast("long")).otherwise(F.lit(0)).cast("int")
    taken = rows.join(sized_broadcast(materialise(limits, "limits")), "key").select("row", copies.alias("n")).filter("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*[x.alias(c) for c, x in own.items()])
