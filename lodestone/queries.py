"""Queries over the driver's tables, one or more for each kind of operator. The corpus is `documents` (a file each, its
path from source, language and id), with vectors from `embeddings` by id; tasks are `benchmark`; trials are `events`."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import evalstats as S
from lodestone.operators import evidence as E
from lodestone.operators import graph as G
from lodestone.operators import grams
from lodestone.operators import likeness
from lodestone.operators import rank as R
from lodestone.plans import planner as P
from lodestone.plans import recall as A
from lodestone.plans import search as Q
from lodestone.sources import corpus as C
from lodestone.sources import store
from lodestone.streaming import maintain

QUERY = "the and attion to thanedble"
TERMS = ["attion", "thanedble", "hand"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(rows: DataFrame, per: int = 10_000) -> DataFrame:
    """rows, dealt to a task for each `per` of them. A column file of short rows is a few splits however many rows it has, and what is
    made of a row may be long."""
    return rows.repartition(max(1, -(-rows.count() // per)))


def path():
    return F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))


def files(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), path().alias("path"), F.col("lang").alias("language"), F.col("text").alias("chunk"), "n_chars")


def embedded(spark, d) -> DataFrame:
    return files(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


def query_vector(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))


def scored(spark, d) -> DataFrame:
    """id, path, chunk, semantic, lexical, score against vector 0: the query is one broadcast row."""
    rows = embedded(spark, d).crossJoin(F.broadcast(query_vector(spark, d)))
    rows = rows.withColumn("semantic", V.cosine(F.col("embedding"), F.col("q"))).withColumn("lexical", T.lexical_score(QUERY, F.col("path"), F.col("chunk")))
    return rows.withColumn("score", F.col("semantic") * 0.8 + F.col("lexical") * 0.2).drop("embedding", "q")


def hybrid_search_topk(spark, d):
    return R.diversify(scored(spark, d).withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")), 20, 2, file="folder").select("rank", "id", "path", F.round("score", 9).alias("score"))


def cosine_topk(spark, d):
    rows = table(spark, d, "embeddings").crossJoin(F.broadcast(query_vector(spark, d))).select("vec_id", V.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return R.top_k(rows, 20, tie="vec_id").select("vec_id", F.round("score", 9).alias("score"))


def file_mean_vectors(spark, d):
    means = store.file_vectors(table(spark, d, "embeddings").select(F.col("label").alias("file"), "embedding"))
    return means.select("file", "chunk_count", F.posexplode("embedding").alias("i", "x")).select("file", "chunk_count", "i", F.round("x", 6).alias("x"))


def cosine_file_topk(spark, d):
    means = store.file_vectors(table(spark, d, "embeddings").select(F.col("label").alias("file"), "embedding"))
    rows = means.crossJoin(F.broadcast(query_vector(spark, d))).select("file", V.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return R.top_k(rows, 5, tie="file").select("file", F.round("score", 7).alias("score"))


def cascade_gate(spark, d):
    means = store.file_vectors(table(spark, d, "embeddings").select(F.col("label").alias("file"), "embedding"))
    gate = Q.cascade_gate(means, F.array(*[F.lit(float(x)) for x in query_vector(spark, d).first()["q"]]))
    return gate.select(F.round("gap", 6).alias("gap"), F.round("sigma", 6).alias("sigma"), "n", F.round("threshold", 6).alias("threshold"), "early_exit")


def multi_resolution_search(spark, d):
    e = table(spark, d, "embeddings")
    q = query_vector(spark, d)
    means = store.file_vectors(e.select(F.col("label").alias("file"), "embedding")).crossJoin(F.broadcast(q))
    near = R.top_k(means.select("file", V.cosine(F.col("embedding"), F.col("q")).alias("score")), 30, tie="file")
    rows = e.join(F.broadcast(near.select(F.col("file").alias("label"))), "label", "left_semi").crossJoin(F.broadcast(q))
    rows = rows.select("vec_id", "label", V.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return R.top_k(rows, 10, tie="vec_id").select("vec_id", "label", F.round("score", 9).alias("score"))


def lexical_score_all(spark, d):
    return files(spark, d).select("id", F.round(T.lexical_score(QUERY, F.col("path"), F.col("chunk")), 9).alias("score"))


def document_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.term_columns(F.col("text")), " ").alias("terms"), F.size(T.tokens(F.col("text"))).alias("n_tokens"))


def term_coverage(spark, d):
    return files(spark, d).select("id", F.array_join(T.covered(TERMS, F.col("chunk")), " ").alias("covered"), T.hit_count(TERMS, F.col("chunk")).alias("hits"))


def file_rank_best(spark, d):
    rows = scored(spark, d).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    return R.file_rank(rows, 15, file="folder").select("folder", "id", F.round("score", 9).alias("score"))


def dedupe_first(spark, d):
    rows = files(spark, d).withColumn("score", F.lit(1.0))
    return R.max_dedupe(rows.select("id", "chunk", "score"), ["chunk"]).select("id")


def rrf_fusion(spark, d):
    s = scored(spark, d)
    by = lambda c: R.top_k(s, 30, c).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(c), "id")))
    fused = R.reciprocal_rank_fusion([by("semantic"), by("lexical")], "id")
    return R.top_k(fused, 20).select("id", "channels", F.round("score", 9).alias("score"))


def max_dedupe_union(spark, d):
    s = scored(spark, d)
    both = R.top_k(s, 30, "semantic").select("id", F.col("semantic").alias("score")).unionByName(R.top_k(s, 30, "lexical").select("id", F.col("lexical").alias("score")))
    best = both.groupBy("id").agg(F.max("score").alias("score"))
    return best.select("id", F.round("score", 9).alias("score"))


def edges(spark, d) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.filter("src <> dst").select("src", "dst")


def degree_stats(spark, d):
    return G.degrees(edges(spark, d))


def pagerank_trade(spark, d):
    return G.small_pagerank(edges(spark, d)).select("file", F.round("pagerank", 9).alias("pagerank"))


def graph_tiebreak(spark, d):
    nodes = G.degrees(edges(spark, d)).select("file", (F.col("in_degree") / F.sum("in_degree").over(Window.partitionBy())).alias("pagerank"))
    rows = nodes.select(F.col("file").alias("id"), F.col("file").alias("path"), (0.5 - F.floor(F.col("file") / 4) * 0.004).alias("score"))
    return R.graph_tiebreak(rows, nodes).select("id", F.round("score", 9).alias("score"))


def page_links(spark, d):
    pages = table(spark, d, "pages").select(F.col("url").alias("file"), F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)).alias("links"))
    e = pages.select(F.col("file").alias("src"), F.explode("links").alias("dst"))
    return e.groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"), F.count_distinct("src").alias("pages"))


def bm25_rank(spark, d):
    f = files(spark, d)
    n = f.count()
    counts = f.select("path", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.regexp_count(F.lower("chunk"), F.lit(t)).alias("n")) for t in TERMS])).alias("x")).select("path", "x.term", "x.n")
    return S.bm25_rank(counts, n, F.contains("path", F.col("term"))).orderBy(F.desc("score"), "path").limit(250).select("path", F.round("score", 9).alias("score"))


def term_df_idf(spark, d):
    words = files(spark, d).select("id", F.explode(F.array_distinct(T.tokens(F.col("chunk")))).alias("term"))
    n = F.lit(files(spark, d).count())
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", F.round(F.ln(1 + n / (F.col("df") + 1)), 9).alias("idf"))


def chunk_lines(spark, d):
    rows = C.chunks(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "chunk_index", "start_line", "end_line", F.char_length("chunk").alias("chars"), "start_byte", "end_byte")


def glob_filter(spark, d):
    return files(spark, d).filter(T.glob_match(F.col("path"), ("src1*/*", "en/doc_*5.txt"), ("*/de/*",))).select("id", "path")


def unembedded_files(spark, d):
    return files(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti").select("id", "path")


def dim_filter(spark, d):
    return table(spark, d, "embeddings").select("label", (~V.has_dimension(F.col("embedding"), 64) | V.is_zero(F.col("embedding"))).alias("bad")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("stale"))


def missing_files(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("n_chars").cast("double").alias("file_mtime"))
    kept = store.without_missing(f, f.filter("file % 3 <> 0"))
    return store.changed(f.withColumn("mtime", F.col("file_mtime") + F.when(F.col("file") % 5 == 0, 2.0).otherwise(0.0)).drop("file_mtime"), kept).select("file")


def index_stats(spark, d):
    return C.chunks(table(spark, d, "documents").select("doc_id", "lang", "text")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("files"), F.sum(F.least(F.char_length("chunk"), F.lit(7500))).alias("model_chars"), F.sum(T.token_estimate(F.col("chunk"))).alias("tokens"), F.min("start_line").alias("first_line")
    )


def enrich_progress(spark, d):
    f = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return f.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality").isNotNull()).alias("done"), F.min("n_chars").alias("oldest"), F.max("n_chars").alias("newest"))


def tier_merge(spark, d):
    lanes = F.when(F.col("id") % 4 == 0, "filename-lookup").when(F.col("id") % 4 == 1, "rg-shortcut").when(F.col("id") % 4 == 2, "candidate-recall")
    rows = scored(spark, d).select("id", F.regexp_replace("path", "/[^/]*$", "").alias("path"), lanes.alias("fallback"), "score")
    return R.tier_merge(rows, "semantic", 40).select("id", "path", "tier", F.round("score", 9).alias("score"))


def synthetic(spark, d) -> DataFrame:
    """Paths with tests, builds, documents and numbered families."""
    n = F.col("p_partkey")
    word = F.lower(F.regexp_replace("p_name", "[^A-Za-z]", ""))
    p = (
        F.when(n % 7 == 0, F.concat(F.lit("pkg/tests/test_"), word, F.lit(".py"))).when(n % 7 == 1, F.concat(F.lit("pkg/migrations/"), F.lpad((n % 1000).cast("string"), 4, "0"), F.lit("_"), word, F.lit(".py")))
        .when(n % 7 == 2, F.concat(F.lit("docs/guide_"), word, F.lit(".md"))).when(n % 7 == 3, F.concat(F.lit("web/dist/"), word, n.cast("string"), F.lit(".min.js")))
        .when(n % 7 == 4, F.concat(F.lit("docs/RELEASE-v1."), (n % 9).cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("src/"), word, F.lit("/"), word, (n % 5).cast("string"), F.lit(".py")))
    )
    return table(spark, d, "part").select(n.alias("id"), p.alias("path"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"))


def source_type_prior(spark, d):
    kind = T.source_type(F.col("path"))
    rows = synthetic(spark, d).select("id", kind.alias("kind"), T.is_non_canonical(F.col("path")).alias("side"), E.intent_prior("test_location", F.col("path")).alias("tests"), E.intent_prior("file_location", F.col("path")).alias("files"))
    return rows


def non_canonical_penalty(spark, d):
    rows = synthetic(spark, d).withColumn("score", F.sin("id"))
    return rows.select("id", F.round(R.penalised(F.col("score"), T.is_non_canonical(F.col("path"))), 9).alias("score"))


def family_dedupe(spark, d):
    return R.family_dedupe(synthetic(spark, d).select("path").distinct()).select("path")


def folder_counts(spark, d):
    return C.folder_counts(synthetic(spark, d).select("path"))


def group_budget(spark, d):
    rows = files(spark, d).withColumn("folder", F.regexp_replace("path", "/.*$", ""))
    folders = rows.select("folder").distinct().withColumn("folder_rank", F.row_number().over(Window.orderBy("folder")))
    ranked = rows.join(folders, "folder")
    return R.group_budget(ranked, "folder", "folder_rank", [F.desc("n_chars"), F.col("id")]).select("folder", "folder_rank", "id")


def prefix_budget(spark, d):
    rows = files(spark, d).select(F.regexp_replace("path", "/.*$", "").alias("folder"), "id", "n_chars")
    return R.prefix_budget(rows, "folder", "n_chars", [F.col("id")], 12_000).select("folder", "id", "n_chars")


def metadata_topk(spark, d):
    return R.top_k(files(spark, d), 25, "n_chars").select("id", "n_chars", T.human_size(F.col("n_chars").cast("double")).alias("size"))


def metadata_rerank(spark, d):
    rows = R.top_k(scored(spark, d), 40)
    return R.metadata_rerank(rows, "n_chars").select("id", F.round("score", 9).alias("score"))


def living_authority_filter(spark, d):
    rows = synthetic(spark, d).select("id", F.when(F.col("id") == 0, "docs/SECURITY.md").otherwise(F.col("path")).alias("path"), (1.0 / (F.col("id") + 1)).alias("score"))
    return E.living_authority(rows, "how is release 1.4 secured").select("id", "path")


def low_evidence_gate(spark, d):
    rows = R.top_k(scored(spark, d), 10, "lexical").select("id", "path", F.col("chunk").alias("snippet"), (F.col("semantic") * 0.1).alias("score"))
    return E.low_evidence_gate(rows, TERMS).select("id")


def shortcut_gate(spark, d):
    hits = files(spark, d).select("path", T.hit_count(TERMS, F.col("chunk")).alias("overlap")).filter("overlap >= 3")
    return E.shortcut_gate(hits, len(TERMS))


def content_scan(spark, d):
    rows = files(spark, d).filter(T.any_of(F.lower("chunk").contains(v) for t in TERMS for v in T.surface_variants(t)))
    return rows.select("id", F.round(E.content_score(TERMS, " ".join(TERMS), F.col("path"), F.col("chunk")), 9).alias("score"))


def symbols(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("file"), F.explode(F.split("p_name", " ")).alias("name")).select("file", "name", T.camel_split(F.col("name")).alias("name_lower"))


def symbol_terms(spark, d) -> list[str]:
    return [r[0] for r in symbols(spark, d).select(F.lower("name").alias("n")).distinct().orderBy("n").limit(4).collect()]


def symbol_channel(spark, d):
    return Q.symbol_search(symbols(spark, d), symbol_terms(spark, d), 20).select("rank", "file", "hits", "exact", F.round("score", 9).alias("score"))


def symbol_boost(spark, d):
    terms = symbol_terms(spark, d)
    return E.symbol_hits(symbols(spark, d), terms).select("file", F.round(0.10 * F.col("hits") / len(terms), 9).alias("boost"))


def recall_lanes(spark, d):
    f = files(spark, d)
    lanes = [E.path_lane(f, ["doc", "en"]), E.content_lane(f, TERMS, "chunk", 0.55), E.content_lane(f, ["thanedble"], "rg", 0.9)]
    return E.recall(lanes).select("path", F.round("score", 9).alias("score"), F.array_join("lanes", ",").alias("lanes"))


def contexts(spark, d) -> tuple[DataFrame, DataFrame]:
    f = files(spark, d).select("id", "path", "chunk", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    return f, A.agent_context(f.select("path"), f, " ".join(TERMS), 20)


def agent_context(spark, d):
    return contexts(spark, d)[1].select("path", "id", F.round("score", 9).alias("score"), F.array_join("lanes", ",").alias("lanes"), F.array_join("evidence", ",").alias("evidence"))


def strict_verdict(spark, d):
    """Stored times are the files' sizes, and every third file is newer; the corpus-wide pass ranks by vector."""
    f, context = contexts(spark, d)
    semantic = R.top_k(embedded(spark, d).crossJoin(F.broadcast(query_vector(spark, d))).select("id", "path", V.cosine(F.col("embedding"), F.col("q")).alias("score")), 40)
    semantic = semantic.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    listing = files(spark, d)
    stored = listing.select("path", F.col("n_chars").cast("double").alias("file_mtime"))
    now = listing.select("path", (F.col("n_chars") + F.col("id") % 3).cast("double").alias("mtime"))
    one = A.strict_verdict(context, len(TERMS), semantic, stored, now, 20)
    return one.select(F.round("top_score", 9).alias("top_score"), F.round("gap", 9).alias("gap"), "covered", "lanes", F.round("confidence", 9).alias("confidence"), "quality", "path", "fresh", "semantic_rank", "passed")


def interval_overlap_anchor(spark, d):
    c = C.chunks(table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")).select("file", "chunk_index", "start_line", "end_line")
    a = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.lit(3).alias("start_line"), (F.col("doc_id") % 20 + 3).cast("int").alias("end_line"), (F.col("doc_id") % 10 / 10).alias("score"))
    return E.anchor_overlap(c, a)


def trials(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    day = F.dayofmonth("ts")
    one = e.groupBy(F.col("user_id"), day.alias("day"), F.col("event_type").alias("policy")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return one.select(
        (F.col("user_id") % 6).cast("string").alias("repo"), F.col("user_id").cast("string").alias("task_id"), F.lit("any").alias("effort"), F.col("day").cast("int").alias("trial"), "policy",
        F.round("v", 2).alias("context_tokens"), F.col("n").alias("tool_calls"), (F.col("v") / F.col("n")).alias("elapsed_seconds"), (1 - (F.col("user_id") + F.col("day")) % 10 / 32).alias("task_completion_quality"),
        ((F.col("user_id") + F.col("day")) % 11 > 0).alias("work_completed"),
    )


def policies(spark, d) -> list[str]:
    return [r[0] for r in table(spark, d, "events").select("event_type").distinct().orderBy("event_type").limit(2).collect()]


def paired_efficiency(spark, d):
    a, b = policies(spark, d)
    one = S.paired_efficiency(trials(spark, d), a, b)
    return one.select("pairs", "eligible", "quality_gate", "n", *[F.round(c, 6).alias(c) for c in ("p25", "median", "p75", "ratio_of_sums")], "claim_status")


def repo_rollup(spark, d):
    a, b = policies(spark, d)
    good = S.eligible(S.paired(trials(spark, d), a, b, ("context_tokens", "task_completion_quality", "work_completed")))
    return S.task_medians(good, "context_tokens").groupBy("repo").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.percentile("value", 0.5), 6).alias("median"))


def bootstrap_ci(spark, d):
    a, b = policies(spark, d)
    good = S.eligible(S.paired(trials(spark, d), a, b, ("context_tokens", "task_completion_quality", "work_completed")))
    draws = S.bootstrap_medians(S.task_medians(good, "context_tokens"))
    return draws.agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.count(F.lit(1)).alias("samples"))


def policy_totals(spark, d):
    return S.policy_totals(trials(spark, d)).select("policy", "trials", F.round("context_tokens", 2).alias("context_tokens"), "tool_calls", F.round("mean_elapsed", 6).alias("mean_elapsed"), F.round("completed", 6).alias("completed"), F.round("quality", 9).alias("quality"))


def trial_collapse(spark, d):
    rows = S.trial_collapse(trials(spark, d), F.col("task_completion_quality") >= 0.8)
    return rows.select("policy", "repo", "task_id", F.round("tokens", 4).alias("tokens"), "calls", F.round("elapsed", 6).alias("elapsed"), F.round("quality", 9).alias("quality"), "gate")


def capacity_projection(spark, d):
    c = C.chunks(table(spark, d, "documents").select(F.col("source").alias("repo"), "doc_id", "text"))
    work = c.groupBy("repo").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.least(F.char_length("chunk"), F.lit(7500))).alias("model_chars"))
    return S.capacity(work, "src1", 29.469, 40.0).select("repo", "chunks", "model_chars", F.round("load_ratio", 6).alias("load_ratio"), F.round("projected_seconds", 5).alias("projected_seconds"), "within_limit")


def mrr_hit_rate(spark, d):
    """Items searched by their first three words; expected is the first document that holds the item's text."""
    items = table(spark, d, "benchmark").select("item_id", "text", F.slice(T.term_columns(F.col("text")), 1, 3).alias("terms"))
    f = files(spark, d).select("id", "chunk", F.array_distinct(T.tokens(F.col("chunk"))).alias("words"))
    hits = items.select("item_id", F.explode("terms").alias("t")).join(f.select("id", F.explode("words").alias("t")), "t").groupBy("item_id", "id").agg(F.count(F.lit(1)).alias("n"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "id")))
    found = _expected(items, f).join(ranked, ["item_id", "id"], "left").select("item_id", "rank")
    one = S.rank_metrics(found)
    return one.select("queries", *[F.round(c, 9).alias(c) for c in ("mrr", "hit_1", "hit_5", "hit_10")])


def _expected(items: DataFrame, f: DataFrame) -> DataFrame:
    """item_id, id of the first file that holds an item's text: files meet an item by its rarest route, its first three
    words in a row, then the text is compared."""
    first = lambda w: F.xxhash64(F.get(w, 0), F.get(w, 1), F.get(w, 2))
    cut = lambda c: T.tokens(F.col(c))
    keyed = items.select("item_id", "text", cut("text").alias("w")).select("item_id", "text", first(F.slice("w", 2, 3)).alias("k"))
    grams = f.select("id", "chunk", cut("chunk").alias("w")).filter(F.size("w") >= 3)
    at = grams.select("id", "chunk", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))).alias("k"))
    return at.join(F.broadcast(keyed), "k").filter(F.contains("chunk", F.col("text"))).groupBy("item_id").agg(F.min("id").alias("id"))


def closest_part_names(spark, d):
    """Names of every fiftieth part, each without its second and its last letter, and the closest of all parts' names."""
    parts = table(spark, d, "part")
    name = F.col("p_name")
    typed = parts.filter("p_partkey % 50 = 0").select(F.concat(F.substring(name, 1, 1), F.substr(name, F.lit(3), F.greatest(F.lit(0), F.length(name) - 3))).alias("typed"))
    return likeness.closest_names(typed, parts.select(name))


def intent_classify(spark, d):
    """Intents of whole user turns."""
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", P.intent_column(F.col("text")).alias("intent"))


def turn_budget(spark, d):
    """Turns of a conversation with most terms, as long as they fit a budget."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", T.hit_count(["that", "the", "der"], F.col("text")).alias("hits")).filter("hits > 0")
    rows = rows.select("conv_id", "turn", "hits", F.char_length("text").alias("size"))
    return R.prefix_budget(rows, "conv_id", "size", [F.desc("hits"), F.col("turn")], 1500).select("conv_id", "turn", "hits")


def ngram_centroid(spark, d):
    """Language of every document by cosine with centroids of character trigrams of the other fold's whole texts (folds by
    id). A text without a known trigram has no language."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("name"), F.lower("text").alias("text"), F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0)).alias("fold"))
    c = stored(grams.counts(docs.filter("name IS NOT NULL").withColumn("fold", 1 - F.col("fold"))))
    size = c.groupBy("fold", "name").agg(F.sqrt(F.sum(F.col("w").cast("double") * F.col("w"))).alias("len"))
    best = grams.dots(docs, "doc_id", c).join(F.broadcast(size), ["fold", "name"]).select("doc_id", F.col("name").alias("lang"), (F.col("dot") / F.col("len")).alias("score"))
    best = R.best_per_key(best, ["doc_id"], [F.desc(F.round("score", 9)), F.col("lang")]).select(F.col("doc_id").alias("id"), F.col("lang").alias("predicted"))
    return docs.join(best, docs["doc_id"].eqNullSafe(best["id"]), "left").select("doc_id", "predicted")


def expiring_index(spark, d):
    """Latest version of each key: events as writes, a user's last event by time and id."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("version"))
    return store.latest(e, ["user_id"], "version").select("user_id", "event_id", "event_type")


def scratch(spark) -> str:
    """A new folder that all executors share: below the checkpoint folder, or, in local mode where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lodestone-')}")
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """rows, written once to the scratch folder by the tasks that make them and read back. Conditions on what is made of rows are moved
    before an exchange that deals them out, into the few splits; from a stored table they aren't."""
    path = f"{scratch(rows.sparkSession)}/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stream_index_upsert(spark, d):
    """documents, streamed in micro-batches into an index of its own in the scratch folder, then read back."""
    home = scratch(spark)
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file"), F.col("doc_id").alias("version"), "lang", "n_chars")
    docs.write.parquet(f"{home}/in")
    docs.filter("version % 10 = 0").withColumn("version", F.col("version") + 1_000_000).withColumn("n_chars", F.lit(0).cast("long")).write.mode("append").parquet(f"{home}/in")
    maintain.follow(spark, f"{home}/in", docs.schema, f"{home}/index", f"{home}/state", 1).awaitTermination()
    return maintain.read(spark, f"{home}/index").select("file", "version", "n_chars")


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search_topk, cosine_topk, file_mean_vectors, cosine_file_topk, cascade_gate, multi_resolution_search, lexical_score_all, document_terms, term_coverage,
        file_rank_best, dedupe_first, rrf_fusion, max_dedupe_union, degree_stats, pagerank_trade, graph_tiebreak, page_links, bm25_rank, term_df_idf, chunk_lines, glob_filter,
        unembedded_files, dim_filter, missing_files, index_stats, enrich_progress, tier_merge, source_type_prior, non_canonical_penalty, family_dedupe, folder_counts, group_budget,
        prefix_budget, metadata_topk, metadata_rerank, living_authority_filter, low_evidence_gate, shortcut_gate, content_scan, symbol_channel, symbol_boost, recall_lanes,
        agent_context, strict_verdict, interval_overlap_anchor, paired_efficiency, repo_rollup, bootstrap_ci, policy_totals, trial_collapse, capacity_projection, mrr_hit_rate,
        intent_classify, turn_budget, ngram_centroid, expiring_index, stream_index_upsert, closest_part_names,
    )
}
