"""Tables of rows by file, kept as deltas: a change writes the rows of the files that changed, and readers merge.

Below one folder a step `n` writes, for each table it changes, `rows/<table>/seq=n` (rows of the changed files, in buckets by file) and
`gone/<table>/seq=n` (the files whose earlier rows are dead: changed and vanished ones). A step becomes visible, for all tables at
once, by one line that is appended to `manifest`: each table's live steps, and the number of the last batch that was taken in. What a
failed step left is written over by the next. `compact` merges all live steps into one, `vacuum` deletes what no longer lives.

Edge cases: a table that was never written is empty; columns that stored rows lack are null; equal rows stay; a null file is a file of its own; steps
have one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

BUCKETS = 16
MANIFEST = "seq long, live map<string, array<long>>, batch long"


class Deltas:
    """Tables (name: schema, all with a column `file`) below `path`."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, TY.StructType], buckets: int = BUCKETS):
        self.spark, self.path, self.schemas, self.buckets = spark, path.rstrip("/"), schemas, buckets

    def manifest(self) -> tuple[int, dict[str, list[int]], int | None]:
        """The last step's number, each table's live steps, and the last batch."""
        try:
            lines = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
            last = lines.agg(F.max_by(F.struct("seq", "live"), "seq").alias("m"), F.max("batch").alias("b")).first()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0, {}, None
        return (0, {}, None) if last["m"] is None else (last["m"]["seq"], {k: list(v) for k, v in last["m"]["live"].items()}, last["b"])

    def _dead(self, table: str, live: list[int]) -> DataFrame:
        """file, before: rows of the file from steps before that one are dead."""
        read = self.spark.read.schema("file string, seq long").option("basePath", f"{self.path}/gone/{table}")
        return read.parquet(*[f"{self.path}/gone/{table}/seq={n}" for n in live[1:]]).groupBy(F.col("file").alias("__file")).agg(F.max("seq").alias("__before"))

    def read(self, table: str, files: DataFrame | None = None) -> DataFrame:
        """A table as it is now; of `files` (file) only, if given."""
        live, kind = self.manifest()[1].get(table, []), self.schemas[table]
        if not live:
            return self.spark.createDataFrame([], kind)
        stored = TY.StructType([*kind.fields, TY.StructField("seq", TY.LongType()), TY.StructField("bucket", TY.IntegerType())])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.path}/rows/{table}").parquet(*[f"{self.path}/rows/{table}/seq={n}" for n in live])
        if files is not None:
            rows = rows.join(files.select(F.col("file").alias("__wanted")).distinct(), F.col("file").eqNullSafe(F.col("__wanted")), "left_semi")
        if len(live) > 1:
            rows = rows.join(self._dead(table, live), F.col("file").eqNullSafe(F.col("__file")) & (F.col("seq") < F.col("__before")), "left_anti")
        return rows.select(*kind.names)

    def _write(self, n: int, table: str, rows: DataFrame) -> None:
        full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schemas[table]])
        bucket = F.pmod(F.xxhash64("file"), F.lit(self.buckets)).cast("int")
        full.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/{table}/seq={n}")

    def _publish(self, n: int, live: dict[str, list[int]], batch: int | None) -> None:
        self.spark.createDataFrame([(n, live, batch)], MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def commit(self, changes: dict[str, tuple[DataFrame, DataFrame]], batch: int | None = None) -> int:
        """One step: of each changed table its new rows, and the files (file) whose rows of steps before are dead."""
        last, live, _ = self.manifest()
        n = last + 1
        for table, (rows, gone) in changes.items():
            self._write(n, table, rows)
            gone.select("file").distinct().write.mode("overwrite").parquet(f"{self.path}/gone/{table}/seq={n}")
        self._publish(n, {**live, **{t: [*live.get(t, []), n] for t in changes}}, batch)
        return n

    def compact(self) -> int:
        """All live rows as one step."""
        last, live, _ = self.manifest()
        n = last + 1
        for table in live:
            self._write(n, table, self.read(table))
        self._publish(n, {t: [n] for t in live}, None)
        return n

    def vacuum(self) -> list[int]:
        """Deletes the steps that no longer live; nobody should read them any more. Returns their numbers."""
        last, live, _ = self.manifest()
        dead = set()
        for table in live:
            for n in {*range(1, last + 1)} - {*live[table]}:
                for kind in ("rows", "gone"):
                    old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{table}/seq={n}")
                    if old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True):
                        dead.add(n)
        return sorted(dead)
