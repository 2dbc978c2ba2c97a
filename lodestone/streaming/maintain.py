"""An index that follows a stream of file versions: micro-batches are appended, readers take each file's last version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from lodestone.sources import store

BUCKETS = 16


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index as it is now: each file's last version over all that was appended."""
    return store.latest(spark.read.parquet(path), ["file"], "version").drop("bucket")


def upsert(spark: SparkSession, path: str, buckets: int = BUCKETS):
    """A foreachBatch function: a micro-batch appends its files' last versions in a folder of its own number, so that a batch
    run twice writes the same, and nothing that is served is overwritten. `compact` merges what has gathered."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        fresh = store.latest(batch, ["file"], "version").withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(buckets)).cast("int"))
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return apply


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Writes the index at path to target as one batch, a file's last version each; readers then move to target."""
    read(spark, path).drop("batch").write.mode("overwrite").parquet(f"{target}/batch=-1")


def follow(spark: SparkSession, source: str, schema: TY.StructType, index: str, checkpoint: str, files_per_batch: int = 100):
    """Starts a query that takes what is at `source` now (Parquet of file, version and more) into the index, then ends."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(upsert(spark, index)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
