"""An index as Parquet tables: its schemas, building it whole or by steps, enrichment, and recovery after a change of model.

Tables of rows by file (`DELTA`) are deltas: a refresh writes the rows of the files that changed, for all tables in one step, and costs
what changed. The others are small or made whole: a version each, which the pointer `current` names once it is written. Readers see
a table as it was before a step or after it, and a failed step changes nothing. Edge cases: a table that was never
written is empty; columns that a stored version lacks are null; an embedder or answerer that fails for a row gives null,
and the row stays pending; ties go by file and id.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import graph
from lodestone.sources import corpus as C
from lodestone.sources import edges as E
from lodestone.sources import store
from lodestone.sources import structure as X
from lodestone.sources.delta import Deltas

SCHEMAS = {
    "chunks": "id long, file string, chunk_index int, chunk string, language string, start_line int, end_line int, start_byte long, end_byte long, file_mtime double, description string, enriched_at double",
    "vectors": "id long, file string, embedding array<float>",
    "symbols": "file string, name string, name_lower string, kind string, start_line int, end_line int, file_mtime double",
    "files": "file string, chunk_count long, embedding array<float>",
    "edges": "file string, dst string",
    "degrees": "file string, in_degree long, out_degree long",
    "file_graph": "file string, in_degree long, out_degree long, pagerank double",
    "metadata": "key string, value string",
    "meta": "key string, value string",
    "router_cache": "key string, value string, at double",
}
#: Tables that are kept as deltas.
DELTA = ("chunks", "vectors", "symbols", "files", "edges", "degrees")
#: Files with these names stand for their folder; references may name only the folder, or the crate.
FOLDER_FILES, CRATE_WORDS = ("__init__", "mod", "lib", "main", "index"), ("crate::", "super::", "self::")
#: Beyond so many names of new and vanished files, all files' references are read anew. Beyond so many steps, they are merged.
MOST_NAMES, MOST_STEPS = 400, 20
MODEL_CHARS = 7500
DEFER, THROTTLE_SECONDS, BATCH = 25, 30.0, 64
CONTENT_TYPES = {"code": ("py", "rs", "ts", "tsx", "js", "jsx", "mjs", "cjs"), "markdown": ("md", "mdx", "markdown"), "document": ("pdf", "docx"), "text": ("txt", "rst", "html")}

Embedder = Callable[[Column], Column]
Answerer = Callable[[Column, Column, Column], Column]


class Index:
    """Tables of one corpus below `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def named(cls, spark: SparkSession, home: str, root: str) -> Index:
        """The index of a root: its name and the first eight digits of its SHA-256."""
        import hashlib

        root = root.rstrip("/") or "/"
        return cls(spark, f"{home.rstrip('/')}/{root.rsplit('/', 1)[-1] or 'root'}-{hashlib.sha256(root.encode()).hexdigest()[:8]}")

    def schema(self, table: str) -> TY.StructType:
        return TY.StructType.fromDDL(SCHEMAS[table])

    def version(self, table: str) -> int | None:
        try:
            return self.spark.read.schema("v long").json(f"{self.path}/{table}/current").agg(F.max("v")).first()[0]
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    @property
    def deltas(self) -> Deltas:
        return Deltas(self.spark, f"{self.path}/deltas", {t: self.schema(t) for t in DELTA})

    def read(self, table: str, files: DataFrame | None = None) -> DataFrame:
        """A table as it is now; of `files` (file) only, if given, where the table has files. Vectors come by id."""
        if table in DELTA:
            rows = self.deltas.read(table, files)
            return rows.drop("file") if table == "vectors" else rows
        v = self.version(table)
        if v is None:
            return self.spark.createDataFrame([], self.schema(table))
        return self.spark.read.schema(self.schema(table)).parquet(f"{self.path}/{table}/v{v}")

    def work(self, name: str, rows: DataFrame) -> DataFrame:
        """rows, written once below the index and read back: what a step uses more than once is computed once."""
        path = f"{self.path}/work/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        home = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        home.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(home)
        return self.spark.read.schema(rows.schema).parquet(path)

    def write(self, table: str, rows: DataFrame) -> None:
        """rows as the table's next version. Columns that rows lacks are null."""
        v, kind = (self.version(table) or 0) + 1, self.schema(table)
        full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
        full.write.mode("overwrite").parquet(f"{self.path}/{table}/v{v}")
        self.spark.range(1).select(F.lit(v).alias("v")).coalesce(1).write.mode("append").json(f"{self.path}/{table}/current")

    def put(self, table: str, values: dict[str, str]) -> None:
        new = self.spark.createDataFrame(list(values.items()), "key string, value string")
        self.write(table, self.read(table).join(new.select("key"), "key", "left_anti").unionByName(new, allowMissingColumns=True))


def embed_text(text: Column, embed: Embedder, prefix: str = "") -> Column:
    """The vector of a text's first characters behind a role's prefix; a zero vector if the embedder gives none."""
    found = embed(F.concat(F.lit(prefix), F.substring(F.coalesce(text, F.lit("")), 1, MODEL_CHARS)))
    return F.coalesce(found, F.transform(embed(F.lit("")), lambda _: F.lit(0.0).cast("float")))


def content_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*[F.when(ext.isin(*known), k) for k, known in CONTENT_TYPES.items()], F.lit("other"))


def build_chunks(files: DataFrame, embed: Embedder) -> DataFrame:
    """Chunks with headers and vectors of files (file, text, language, mtime); a file's chunks are one row group of the plan, so
    that none is half indexed. Zero vectors are stamped as stale."""
    code = content_type(F.col("file")) == "code"
    limits = [(code, C.CODE_LINES, C.CODE_CHARS), (~code, C.MAX_LINES, C.MAX_CHARS)]
    every = None
    for which, lines, chars in limits:
        part = C.chunks(files.filter(which).select("file", "language", F.col("mtime").alias("file_mtime"), F.coalesce("text", F.lit("")).alias("text")), max_lines=lines, max_chars=chars)
        every = part if every is None else every.unionByName(part)
    full = F.concat(C.header(F.col("file"), F.col("language"), C.first_symbol(F.col("chunk"))), F.col("chunk"))
    rows = every.withColumn("chunk", full).withColumn("embedding", embed_text(F.col("chunk"), embed))
    return store.stamped(rows.withColumn("id", F.xxhash64("file", "chunk_index")))


def _names(files: DataFrame) -> Column:
    """What a reference to a file says: the stem of its name; of a file that stands for its folder, names of folders and a crate's."""
    parts = F.split("file", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    folders = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.least(F.size(parts) - 1, F.lit(2)))
    said = F.when(stem.isin(*FOLDER_FILES), F.concat(folders, F.array(stem, *map(F.lit, CRATE_WORDS)))).otherwise(F.array(stem))
    return F.concat(said, F.transform(said, lambda x: F.replace(x, F.lit("-"), F.lit("_"))))


def _mentioning(files: DataFrame, named: DataFrame) -> DataFrame:
    """file of the files whose text may refer to one of the named ones, or of all, if too many are named."""
    words = [r[0] for r in named.select(F.explode(_names(named)).alias("w")).filter("w <> ''").distinct().limit(MOST_NAMES + 1).collect()]
    if len(words) > MOST_NAMES:
        return files.select("file")
    return files.filter(F.coalesce(T.any_of(F.contains("text", F.lit(w)) for w in words), F.lit(False))).select("file") if words else files.select("file").limit(0)


def _graph_step(index: Index, files: DataFrame, pending: DataFrame, added: DataFrame, gone: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The changes of `edges` and `degrees`: edges of the files that may have other edges than before (changed ones, and those that may
    refer to new or vanished files), and the degrees these change. Other files' texts are only searched for the names. Files that no
    extractor takes have no part in this."""
    taken = E.suffix(F.col("file")).isin(*{s for suffixes, _ in E.EXTRACTORS.values() for s in suffixes})
    files, pending, added, gone = (rows.filter(taken) for rows in (files, pending, added, gone))
    if pending.isEmpty() and gone.isEmpty():
        return {}
    around = _mentioning(files, added.unionByName(gone)) if not index.read("edges").isEmpty() else files.select("file").limit(0)
    sources = index.work("sources", pending.select("file").unionByName(around).distinct())
    marked = files.select("file", "text").join(sources.withColumn("__own", F.lit(True)), "file", "left")
    found = E.file_edges(marked.select("file", F.when(F.col("__own"), F.col("text")).alias("text")))
    new = index.work("edges", found.join(sources.withColumnRenamed("file", "src"), "src", "left_semi").select(F.col("src").alias("file"), "dst"))
    touched = sources.unionByName(gone.select("file"))
    old = index.read("edges", touched)
    count = lambda rows, file, i, o: rows.select(F.col(file).alias("file"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    moves = count(new, "file", 0, 1).unionByName(count(new, "dst", 1, 0)).unionByName(count(old, "file", 0, -1)).unionByName(count(old, "dst", -1, 0))
    moved = index.work("moves", moves.groupBy("file").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).filter("i <> 0 OR o <> 0"))
    before = index.read("degrees", moved).select("file", F.col("in_degree").alias("a"), F.col("out_degree").alias("b"))
    after = moved.join(before, "file", "left").select("file", (F.col("i") + F.coalesce("a", F.lit(0))).alias("in_degree"), (F.col("o") + F.coalesce("b", F.lit(0))).alias("out_degree"))
    touched, after = index.work("touched", touched), index.work("degrees", after)
    return {"edges": (new, touched), "degrees": (after.filter("in_degree > 0 OR out_degree > 0"), after)}


def refresh(index: Index, files: DataFrame, embed: Embedder, defer: int | None = DEFER, now: float | None = None, full: bool = False, batch: int | None = None, rank: bool | None = None, gone: DataFrame | None = None) -> dict[str, int]:
    """Takes new and changed files (file, text, language, mtime) into the index and forgets vanished ones; counts of what
    happened. A refresh within the throttle does nothing; beyond `defer` pending files it leaves them (deferred) unless
    full. Run twice, it changes nothing the second time; with `batch`, a batch that was taken in is skipped. What is written are the rows
    of changed files: chunks and vectors (each text goes to the embedder once), symbols, file vectors, edges and degrees. `file_graph` with PageRank,
    which is of the whole graph, is made anew if `rank`, by default by full refreshes. Where `files` are only some of the
    corpus, `gone` (file) says what vanished; else it is what isn't listed."""
    now = time.time() if now is None else now
    nothing = {"throttled": 0, "indexed": 0, "deferred": 0, "forgotten": 0}
    _, steps, last_batch = index.deltas.manifest()
    if batch is not None and last_batch is not None and batch <= last_batch:
        return {**nothing, "skipped": 1}
    last = {r["key"]: r["value"] for r in index.read("metadata").filter("key = 'refreshed_at'").collect()}.get("refreshed_at")
    if not full and batch is None and last is not None and now - float(last) < THROTTLE_SECONDS:
        return {**nothing, "throttled": 1}
    old = index.work("known", index.read("chunks").groupBy("file").agg(F.min("file_mtime").alias("file_mtime")))
    listed = files.select("file", "mtime")
    pending_names = index.work("pending", (listed.select("file") if full else store.changed(listed, old).select("file")).distinct())
    missing = index.work("gone", old.join(files if gone is None else gone, "file", "left_anti" if gone is None else "left_semi").select("file"))
    counts = {**nothing, "indexed": pending_names.count(), "forgotten": missing.count()}
    if defer is not None and not full and counts["indexed"] > defer:
        return {**nothing, "deferred": counts["indexed"]}
    if counts["indexed"] or counts["forgotten"]:
        pending = files.join(pending_names, "file", "left_semi")
        fresh = index.work("fresh", build_chunks(pending, embed))
        added = pending_names.join(old, "file", "left_anti")
        whole = files if gone is None else files.select("file", "text").unionByName(old.join(files, "file", "left_anti").join(missing, "file", "left_anti").select("file", F.lit(None).cast("string").alias("text")))
        stale = index.work("stale", pending_names.unionByName(missing))
        changes = {
            "chunks": (fresh.drop("embedding"), stale),
            "vectors": (fresh.select("id", "file", "embedding"), stale),
            "symbols": (definitions(pending.select("file", "text")), stale),
            "files": (store.file_vectors(fresh.select("file", "embedding")), stale),
            **_graph_step(index, whole, pending_names, added, missing),
        }
        index.deltas.commit(changes, batch)
        if len(steps.get("chunks", ())) + 1 > MOST_STEPS:
            index.deltas.compact()
        if full if rank is None else rank:
            rank_graph(index)
    index.put("metadata", {"refreshed_at": repr(now)})
    return counts


def rank_graph(index: Index, **settings) -> None:
    """Makes `file_graph` of the stored edges."""
    index.write("file_graph", graph.pagerank(index.read("edges").select(F.col("file").alias("src"), "dst"), **settings))


def definitions(files: DataFrame) -> DataFrame:
    """Symbols of files (file, text): by structure where the language has rules, else line by line."""
    known = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).isin("py", *X.BRACES)
    return X.definitions(files.filter(known)).unionByName(C.symbols(files.filter(~known)), allowMissingColumns=True)


def _told(pending: DataFrame, answer: Answerer, embed: Embedder) -> DataFrame:
    """id, __d, __v of the pending chunks that got a description."""
    told = pending.select("id", F.nullif(answer(F.col("file"), F.coalesce("language", F.lit("")), F.coalesce("chunk", F.lit(""))), F.lit("")).alias("__d"), "chunk").filter("__d IS NOT NULL")
    return told.withColumn("__v", embed_text(F.concat("chunk", F.lit("\n\n"), F.col("__d")), embed)).drop("chunk")


def _pending(chunks: DataFrame, most: int | None) -> DataFrame:
    pending = chunks.filter("enriched_at IS NULL").select("id", "file", "language", "chunk")
    return pending if most is None else pending.orderBy("id").limit(most)


def _described(chunks: DataFrame, told: DataFrame, now: float) -> DataFrame:
    new = chunks.join(told.select("id", "__d"), "id", "left")
    new = new.withColumn("description", F.coalesce("__d", "description")).withColumn("enriched_at", F.when(F.col("__d").isNotNull(), F.lit(now)).otherwise(F.col("enriched_at")))
    return new.drop("__d")


def _moved(vectors: DataFrame, told: DataFrame) -> DataFrame:
    return vectors.join(told.select("id", "__v"), "id", "left").withColumn("embedding", F.coalesce(F.col("__v"), "embedding")).drop("__v")


def enrich(chunks: DataFrame, vectors: DataFrame, answer: Answerer, embed: Embedder, now: float, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """chunks and vectors with a description of pending chunks (no enriched_at): answer(file, language, chunk), or null if it
    fails, which leaves a chunk pending. At most `most` are taken, by id. Answers and their vectors are made once, now, and kept in the
    checkpoint folder, so that both results have the same."""
    graph.need_checkpoints(chunks.sparkSession)
    told = _told(_pending(chunks, most), answer, embed).checkpoint()
    return _described(chunks, told, now), _moved(vectors, told).select("id", "embedding")


def enrich_index(index: Index, answer: Answerer, embed: Embedder, now: float, step: int = 500, most_steps: int | None = None) -> Iterator[dict]:
    """Enriches pending chunks of an index step by step and tells the progress after each. A step is committed as a delta of the files it
    touched: a run that is killed is resumed by another call, which takes what is still pending. Chunks whose answer failed are
    tried once a run. A step's numbers: told, failed, and those of `progress`."""
    began, done, failed, taken = time.time(), 0, 0, 0
    tried = None
    while most_steps is None or taken < most_steps:
        chunks = index.read("chunks")
        left = chunks if tried is None else chunks.filter(F.col("id") > tried)
        pending = index.work("asked", _pending(left, step))
        n, last = pending.agg(F.count(F.lit(1)), F.max("id")).first()
        if not n:
            return
        told = index.work("told", _told(pending, answer, embed))
        right = told.count()
        if right:
            files = index.work("enriched", pending.join(told.select("id"), "id", "left_semi").select("file").distinct())
            described, moved = _described(index.read("chunks", files), told, now), _moved(index.deltas.read("vectors", files), told)
            index.deltas.commit({"chunks": (described, files), "vectors": (moved, files)})
        done, failed, taken, tried = done + right, failed + n - right, taken + 1, last
        total = done + index.read("chunks").filter("enriched_at IS NULL").count()
        yield {"told": done, "failed": failed, **progress(done, total, time.time() - began)}


def recovery_batch(chunks: DataFrame, vectors: DataFrame, dimension: int, batch: int = 20) -> DataFrame:
    """id, chunk of the next stale chunks (no vector, or one of another dimension), those of the newest files first."""
    stale = vectors.filter(F.col("embedding").isNull() | ~V.has_dimension(F.col("embedding"), dimension))
    return chunks.join(stale.select("id"), "id").orderBy(F.desc_nulls_last("file_mtime"), "id").limit(batch).select("id", "chunk")


def recover(chunks: DataFrame, vectors: DataFrame, dimension: int, embed: Embedder) -> DataFrame:
    """vectors with those of stale chunks made anew: all at once, as a job that fails is run again."""
    texts = chunks.select("id", F.col("chunk").alias("__t"))
    fine = F.coalesce(V.has_dimension(F.col("embedding"), dimension), F.lit(False))
    return vectors.join(texts, "id", "left").select("id", F.when(fine | F.col("__t").isNull(), F.col("embedding")).otherwise(embed_text(F.col("__t"), embed)).alias("embedding"))


def coverage(vectors: DataFrame, dimension: int) -> DataFrame:
    """One row: total, stale, coverage_pct."""
    fine = F.coalesce(V.has_dimension(F.col("embedding"), dimension), F.lit(False))
    one = vectors.agg(F.count(F.lit(1)).alias("total"), F.count_if(~fine).alias("stale"))
    return one.withColumn("coverage_pct", F.when(F.col("total") > 0, F.floor(100 * (F.col("total") - F.col("stale")) / F.col("total"))).otherwise(0).cast("int"))


def progress(done: int, total: int, elapsed: float) -> dict[str, float | str | None]:
    """How far a resumable pass is, and the seconds that are left at its pace."""
    return {"progress": f"{done}/{total}", "coverage_pct": int(100 * done / total) if total else 0, "eta_seconds": round(elapsed / done * (total - done)) if done else None}


def batches(files: DataFrame, size: int = BATCH) -> DataFrame:
    """files with `batch`: files in order, each batch closed by the file with which its chunks (column chunks) reach the size,
    1 to 512. Numbering restarts in each partition, so that none is counted over the whole corpus."""
    size = max(1, min(size, 512))
    w = Window.partitionBy(F.spark_partition_id()).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("batch", F.floor(F.coalesce(F.sum("chunks").over(w), F.lit(0)) / size))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks (id, repo, query, expected_paths, evidence_terms) of JSON files; raises if an id is missing or repeated, or a task
    has no query."""
    schema = "id string, repo string, query string, expected_paths array<string>, evidence_terms array<string>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    bad = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.trim("query"), F.lit("")) == "").alias("blank")).filter("id IS NULL OR n > 1 OR blank > 0")
    found = bad.limit(3).collect()
    if found:
        raise ValueError(f"tasks need an id of their own and a query: {[r['id'] for r in found]}")
    return rows


def latest_files(files: DataFrame, k: int) -> DataFrame:
    """The newest files, ids in order among equals."""
    return files.orderBy(F.desc("mtime"), "id").limit(k)


def first_chunks(chunks: DataFrame) -> DataFrame:
    """file, id, chunk of each file's first chunk."""
    return chunks.groupBy("file").agg(F.min_by(F.struct("id", "chunk"), F.struct("chunk_index", "id")).alias("c")).select("file", "c.*")


def stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, files, model characters and tokens, oldest and newest file."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("file").alias("files"), F.sum(F.least(F.char_length("chunk"), F.lit(MODEL_CHARS))).alias("model_chars"),
        F.sum(T.token_estimate(F.col("chunk"))).alias("tokens"), F.min("file_mtime").alias("oldest"), F.max("file_mtime").alias("newest"), F.count("enriched_at").alias("enriched"),
    )


def stale_by_file(chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """file, chunks, stale, oldest: how many of a file's chunks need a new vector."""
    fine = F.coalesce(V.has_dimension(F.col("embedding"), dimension) & ~V.is_zero(F.col("embedding")), F.lit(False))
    rows = chunks.join(vectors, "id", "left")
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(~fine).alias("stale"), F.min("file_mtime").alias("oldest"))
