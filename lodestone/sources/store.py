"""Index tables as Parquet: append, replace by file, delete vanished files, key and value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vector as V


def stamped(chunks: DataFrame) -> DataFrame:
    """Chunks whose vector is zero get the time 0, so that any later look at the file finds them stale."""
    return chunks.withColumn("file_mtime", F.when(V.is_zero(F.col("embedding")), 0.0).otherwise(F.col("file_mtime")))


def replace_files(stored: DataFrame, fresh: DataFrame, key: str = "file") -> DataFrame:
    """stored with all rows of fresh's files replaced by fresh's."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def without_missing(stored: DataFrame, listing: DataFrame, key: str = "file") -> DataFrame:
    return stored.join(listing.select(key).distinct(), key, "left_semi")


def changed(listing: DataFrame, stored: DataFrame, key: str = "file") -> DataFrame:
    """Files that aren't stored, or are newer than the oldest of their stored chunks."""
    known = stored.groupBy(key).agg(F.min("file_mtime").alias("__at"))
    return listing.join(known, key, "left").filter(F.col("__at").isNull() | (F.col("mtime") > F.col("__at"))).drop("__at")


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """Key and value upsert: the row of the last version of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(version))
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def file_vectors(chunks: DataFrame, file: str = "file") -> DataFrame:
    """file, chunk_count, embedding: the mean of a file's scaled vectors, scaled; files of several dimensions have none.

    Elements are summed by file and place before they are shuffled. A file's vectors are of one dimension if and only if all
    its places have the same number of elements. Null vectors and those of length zero aren't counted.
    """
    v = chunks.select(file, F.col("embedding").cast("array<double>").alias("v")).withColumn("len", V.norm(F.col("v"))).filter("len > 0")
    parts = v.select(file, F.posexplode(F.transform("v", lambda x: x / F.col("len"))).alias("i", "x")).groupBy(file, "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    places = F.array_sort(F.collect_list(F.struct("i", "m")))
    means = parts.groupBy(file).agg(F.transform(places, lambda p: p["m"]).alias("mean"), F.min("n").alias("chunk_count"), F.max("n").alias("most"))
    out = means.filter("chunk_count = most").withColumn("len", V.norm(F.col("mean"))).filter("len > 0")
    return out.select(file, "chunk_count", F.transform("mean", lambda x: x / F.col("len")).alias("embedding"))
