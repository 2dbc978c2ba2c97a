"""Ranking: top-k, caps for each file, fusion, tie-breaks, tiers, budgets. All orders are total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import need_checkpoints

RRF_K, PER_FILE = 60, 2
TIE_GAP, TIE_WEIGHT, TIE_ROWS = 0.005, 0.005, 5
TIERS = {
    "filename": {"filename-lookup": 0, "candidate-recall": 1, "rg-shortcut": 1, "cascade": 2},
    "semantic": {"cascade": 0, "candidate-recall": 0, "rg-shortcut": 1, "filename-lookup": 2},
    "lexical": {"rg-shortcut": 0, "candidate-recall": 0, "cascade": 1, "filename-lookup": 2},
    "mixed": {"filename-lookup": 0, "candidate-recall": 0, "rg-shortcut": 0, "cascade": 0},
}


def top_k(rows: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows: each partition keeps k, then they meet."""
    return rows.orderBy(F.desc(score), F.col(tie)).limit(k)


def best_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def diversify(rows: DataFrame, k: int, per_file: int = PER_FILE, score: str = "score", file: str = "path", tie: str = "id") -> DataFrame:
    """At most per_file rows of a file first, then the others in order until k. Ranks are kept as `rank`."""
    w = Window.partitionBy(file).orderBy(F.desc(score), F.col(tie))
    near = rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k)  # k rows of a file are enough, and the limit goes below the shuffle
    late = near.withColumn("__late", (F.col("__rn") > per_file).cast("int")).drop("__rn")
    best = late.orderBy("__late", F.desc(score), F.col(tie)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("__late", F.desc(score), F.col(tie)))).drop("__late")


def file_rank(rows: DataFrame, k: int, score: str = "score", file: str = "path", tie: str = "id") -> DataFrame:
    return top_k(best_per_key(rows, [file], [F.desc(score), F.col(tie)]), k, score, tie)


def max_dedupe(rows: DataFrame, keys: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    """Of rows with one key, the best: combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))).alias("b"))
    return best.select(*keys, "b.*")


def reciprocal_rank_fusion(channels: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """channels of (key, rank): key, score (sum of 1 / (k + rank)), channels."""
    every = None
    for number, c in enumerate(channels):
        part = c.select(key, (1.0 / (F.lit(k) + F.col("rank"))).alias("part"), F.lit(number).alias("channel"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("channels"))


def penalised(score: Column, non_canonical: Column) -> Column:
    """Half of a score of a path off the beaten track; one less of a negative one."""
    return F.when(non_canonical, F.when(score >= 0, score * 0.5).otherwise(score - 1.0)).otherwise(score)


def graph_tiebreak(rows: DataFrame, pagerank: DataFrame, score: str = "score", tie: str = "id", gap: float = TIE_GAP, weight: float = TIE_WEIGHT, head: int = TIE_ROWS) -> DataFrame:
    """Adds up to `weight`, by scaled PageRank, to the first rows' scores if the first two are closer than `gap`.
    rows (path, score) should be a result set; a window over its first rows decides for all of them."""
    w = Window.orderBy(F.desc(score), F.col(tie))
    ranked = rows.withColumn("__rn", F.row_number().over(w)).join(pagerank.select(F.col("file").alias("path"), "pagerank"), "path", "left")
    first = lambda n: F.max(F.when(F.col("__rn") == n, F.col(score))).over(Window.partitionBy())
    inside = F.col("__rn") <= head
    pr = F.coalesce("pagerank", F.lit(0.0))
    lo, hi = (f(F.when(inside, pr)).over(Window.partitionBy()) for f in (F.min, F.max))
    known = F.max(F.when(inside, F.col("pagerank"))).over(Window.partitionBy()).isNotNull()
    fires = known & (first(1) - first(2) < gap)
    bump = F.when(F.coalesce(fires, F.lit(False)) & inside, weight * (pr - lo) / (hi - lo + 1e-9)).otherwise(0.0)
    return ranked.withColumn("bump", bump).withColumn(score, F.col(score) + F.col("bump")).drop("__rn", "pagerank")


def tier_merge(rows: DataFrame, intent: str, k: int, tie: str = "id") -> DataFrame:
    """rows (path, score, fallback): a path's best tier, then score; ordered the same way."""
    order = TIERS.get(intent, TIERS["mixed"])
    tier = F.coalesce(*[F.when(F.coalesce("fallback", F.lit("cascade")) == name, F.lit(n)) for name, n in order.items()], F.lit(99))
    by = [F.col("tier"), F.desc(F.coalesce("score", F.lit(0.0))), F.col(tie)]
    best = best_per_key(rows.filter(F.coalesce("path", F.lit("")) != "").withColumn("tier", tier), ["path"], by)
    return best.orderBy(*by).limit(k)


def metadata_rerank(rows: DataFrame, value: str, weight: float = 0.04, score: str = "score", tie: str = "id") -> DataFrame:
    """Adds up to `weight` by a value scaled over the result set (half if all are equal)."""
    w = Window.partitionBy()
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    scaled = F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.5)
    return rows.withColumn(score, F.col(score) + weight * F.coalesce(scaled, F.lit(0.0)))


def family_key(path: Column) -> Column:
    """What a numbered file, or one of six equal first letters, shares with its like in a folder."""
    name = F.element_at(F.split(path, "/"), -1)
    parent = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")
    stem, ext = F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")), F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))
    return F.when(stem.rlike(r"^\d{2,8}[_-]"), F.concat(parent, F.lit("::numeric:"), ext)).when(F.char_length(stem) >= 6, F.concat(parent, F.lit("::"), F.substring(stem, 1, 6), F.lit(":"), ext)).otherwise(path)


def family_dedupe(files: DataFrame, least: int = 3, path: str = "path") -> DataFrame:
    """Of families of `least` members or more, the first by name."""
    keyed = files.withColumn("__family", family_key(F.col(path)))
    sizes = keyed.groupBy("__family").agg(F.count(F.lit(1)).alias("__n"), F.min(path).alias("__first"))
    kept = keyed.join(sizes, "__family").filter((F.col("__n") < least) | (F.col(path) == F.col("__first")))
    return kept.drop("__family", "__n", "__first")


def group_budget(rows: DataFrame, group: str, group_rank: str, order: list[Column], budgets: tuple[int, ...] = (8, 4, 2, 2, 2), rest: int = 1, cap: int = 25) -> DataFrame:
    """Of the n-th group its n-th budget of rows, at most `cap` in all."""
    allowed = F.coalesce(F.try_element_at(F.array(*map(F.lit, budgets)), F.col(group_rank).cast("int")), F.lit(rest))
    w = Window.partitionBy(group).orderBy(*order)
    inside = rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= allowed).drop("__rn")
    return inside.orderBy(group_rank, *order).limit(cap)


def prefix_budget(rows: DataFrame, key: str, size: str, order: list[Column], most: int) -> DataFrame:
    """Of each key its first rows as long as their sizes sum to at most `most`.

    Rows are laid out by key and order, so that a key of many rows lies in many partitions; each of these sums its sizes, the
    sums before a partition are few (a row for each key in each partition), and rows are summed up inside their partition. The
    layout is a checkpoint, which two readers share. A null size adds nothing; a row before which no size is known is left
    out; rows of one key and order are in any order; null keys are a key; an empty table gives an empty result.
    """
    need_checkpoints(rows.sparkSession)
    laid = rows.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    sums = laid.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__in")).agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy("__key").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__key", "__in", F.sum("__sum").over(before).alias("__before"))
    inside = Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = laid.withColumn("__upto", F.sum(size).over(inside)).join(sums, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__in")))
    upto = F.coalesce(F.col("__before") + F.col("__upto"), F.col("__upto"), F.col("__before"))
    return summed.filter(upto <= most).select(rows.columns)
