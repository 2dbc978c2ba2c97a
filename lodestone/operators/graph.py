"""Reference graphs: degrees and PageRank over an edge list whose repeated edges count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """file, in_degree, out_degree."""
    ends = edges.select(F.col("src").alias("file"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("file", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("file").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def need_checkpoints(spark: SparkSession) -> None:
    """Sees to it that there is a checkpoint folder: the cluster's, or, in local mode where none is set, a temporary one."""
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or f"file://{tempfile.mkdtemp(prefix='lodestone-')}")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, iterations: int = 50) -> DataFrame:
    """file, in_degree, out_degree, pagerank. Edges are first summed by pair, so a step shuffles each pair once; dangling
    nodes give to all. A step reads the last one's ranks three times, so each is cut by a checkpoint, which executors share."""
    spark = edges.sparkSession
    need_checkpoints(spark)
    stats = degrees(edges, nodes).checkpoint()
    n = stats.count()
    if not n:
        return stats.withColumn("pagerank", F.lit(None).cast("double"))
    weighted = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).join(stats.select(F.col("file").alias("src"), "out_degree"), "src")
    weighted = weighted.select("src", "dst", (F.col("n") / F.col("out_degree")).alias("share")).repartition("src").checkpoint()
    ranks = stats.select("file", (F.col("out_degree") == 0).alias("dangling"), F.lit(1.0 / n).alias("pagerank"))
    for _ in range(iterations):
        inflow = weighted.join(ranks, F.col("src") == F.col("file")).groupBy("dst").agg(F.sum(F.col("share") * F.col("pagerank")).alias("inflow"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("pagerank"))), F.lit(0.0)).alias("lost"))
        moved = ranks.join(inflow, ranks["file"] == inflow["dst"], "left").crossJoin(F.broadcast(lost))
        new = (1 - damping) / n + damping * F.col("lost") / n + damping * F.coalesce("inflow", F.lit(0.0))
        ranks = moved.select("file", "dangling", new.alias("pagerank")).checkpoint()
    return stats.join(ranks.select("file", "pagerank"), "file")


def small_pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 50, most_nodes: int = 2000) -> DataFrame:
    """file, pagerank, in one job: nodes are numbered and the steps folded over one array. Only for graphs of at most
    most_nodes nodes (counted first); larger ones go to `pagerank`."""
    ends = edges.select(F.col("src").alias("file")).union(edges.select("dst")).distinct()
    if ends.limit(most_nodes + 1).count() > most_nodes:
        return pagerank(edges, None, damping, iterations).select("file", "pagerank")
    names = ends.agg(F.array_sort(F.collect_list("file")).alias("names"))
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(names))
    numbered = pairs.select(F.array_position("names", F.col("src")).alias("s"), F.array_position("names", F.col("dst")).alias("d"), "n")
    out = numbered.groupBy("s").agg(F.sum("n").alias("out"))
    links = numbered.join(out, "s").groupBy("d").agg(F.array_sort(F.collect_list(F.struct("s", (F.col("n") / F.col("out")).alias("share")))).alias("ins"))
    sent = out.agg(F.collect_set("s").alias("senders"))
    one = links.agg(F.map_from_entries(F.collect_list(F.struct("d", "ins"))).alias("ins")).crossJoin(names).crossJoin(sent)
    rows = F.transform(F.sequence(F.lit(1), F.size("names")), lambda i: F.struct(F.coalesce(F.try_element_at("ins", i.cast("long")), F.array().cast("array<struct<s:bigint,share:double>>")).alias("ins"), (~F.array_contains("senders", i.cast("long"))).alias("dangling")))
    one = one.select("names", rows.alias("rows"), F.size("names").alias("n"))
    start = F.transform("rows", lambda r: F.lit(1.0) / F.col("n"))

    def step(pr, _):
        lost = F.aggregate(F.zip_with(pr, F.col("rows"), lambda p, r: F.when(r["dangling"], p).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
        return F.transform("rows", lambda r: (1 - damping) / F.col("n") + damping * lost / F.col("n") + damping * F.aggregate(r["ins"], F.lit(0.0), lambda s, x: s + x["share"] * F.element_at(pr, x["s"].cast("int"))))

    final = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step)
    ranked = one.select("names", final.alias("pr"))
    return ranked.select(F.explode(F.arrays_zip("names", "pr")).alias("x")).select(F.col("x.names").alias("file"), F.col("x.pr").alias("pagerank"))
