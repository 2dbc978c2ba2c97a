"""What the training-data operators share: table access, the shared scratch folder, folds and word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, in local mode where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lodestone-')}")
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in a new folder of the shared one, which is deleted when the driver's JVM ends."""
    home = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{home}/{name}"


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors,
    and is read with column pruning any number of times."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows; else as it is, for a shuffled join that
    adaptive execution can split where it is skewed. df should be materialised: it is counted."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def id_mod(column: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo divisor; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor, F.lit(-1)).cast("int")


def shuffle_buckets(spark: SparkSession) -> int:
    """How many parts a repartitioned corpus gets. spark.sql.shuffle.partitions is what a cluster sizes to its
    input, so it is the only source of this number: aim at some 16 MB of text a part."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
