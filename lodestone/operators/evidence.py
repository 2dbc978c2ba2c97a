"""Recall lanes, candidate scores, confidence, and gates that decide over a whole result set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

LANE_WEIGHTS = {"include": 0.35, "chunk": 0.55, "symbol": 1.0, "rg": 0.9}


def path_lane(files: DataFrame, terms: list[str]) -> DataFrame:
    """path, lane, score: 0.75 and 0.15 for each term in the path."""
    low = F.lower("path")
    plain = F.regexp_replace(low, r"[^\p{L}\p{N}]", "")
    n = sum(((low.contains(t) | plain.contains("".join(c for c in t if c.isalnum()))).cast("int") for t in terms), F.lit(0))
    return files.select("path", n.alias("n")).filter("n > 0").select("path", F.lit("path").alias("lane"), (0.75 + 0.15 * F.col("n")).alias("score"))


def term_lane(chunks: DataFrame, terms: list[str], lane: str, weight: float) -> DataFrame:
    """path, lane, score: the weight for each term that a chunk of the file has in some form."""
    low = F.lower("chunk")
    hit = F.array_compact(F.array(*[F.when(T.any_of(low.contains(v) for v in T.synonym_variants(t)), F.lit(i)) for i, t in enumerate(terms)]))
    found = chunks.select("path", F.explode(hit).alias("term")).groupBy("path").agg(F.count_distinct("term").alias("n"))
    return found.select("path", F.lit(lane).alias("lane"), (weight * F.col("n")).alias("score"))


def symbol_lane(symbols: DataFrame, terms: list[str]) -> DataFrame:
    """path, lane, score: 1 for each term that lies in a name of the file in some form."""
    name, words = F.lower("name"), F.concat(F.lit(" "), F.col("name_lower"), F.lit(" "))
    hit = F.array_compact(F.array(*[F.when(T.any_of(name.contains(v) | words.contains(f" {v} ") for v in T.synonym_variants(t)), F.lit(i)) for i, t in enumerate(terms)]))
    found = symbols.select(F.col("file").alias("path"), F.explode(hit).alias("term")).groupBy("path").agg(F.count_distinct("term").alias("n"))
    return found.select("path", F.lit("symbol").alias("lane"), (LANE_WEIGHTS["symbol"] * F.col("n")).alias("score"))


def content_lane(chunks: DataFrame, terms: list[str], lane: str, weight: float) -> DataFrame:
    """path, lane, score of the files of which a chunk has a term: one scan for all terms."""
    hit = T.any_of(F.lower("chunk").contains(v) for t in terms for v in T.synonym_variants(t))
    return chunks.filter(hit).select("path").distinct().select("path", F.lit(lane).alias("lane"), F.lit(weight).alias("score"))


def source_type_lane(files: DataFrame, terms: list[str], wanted: str) -> DataFrame:
    """path, lane, score: 1.10 and 0.20 for each term in the path of files of a type."""
    low = F.lower("path")
    n = sum((low.contains(t).cast("int") for t in terms), F.lit(0))
    found = files.filter(T.source_type(F.col("path")) == wanted).select("path", n.alias("n"))
    return found.select("path", F.lit("source-type").alias("lane"), (1.10 + 0.20 * F.col("n")).alias("score"))


def votes(lanes: list[DataFrame]) -> DataFrame:
    """path, score (summed over lanes), lanes. Scores are added as decimals: the sum doesn't depend on the order in which lanes meet, so
    that equal votes are equal."""
    every = lanes[0]
    for x in lanes[1:]:
        every = every.unionByName(x)
    return every.groupBy("path").agg(F.sum(F.col("score").cast("decimal(38,12)")).cast("double").alias("score"), F.array_sort(F.collect_set("lane")).alias("lanes"))


def recall(lanes: list[DataFrame], most_paths: int = 120) -> DataFrame:
    """The best paths of votes."""
    return votes(lanes).orderBy(F.desc("score"), "path").limit(most_paths)


def candidate_score(lexical: Column, identity: Column, anchor: Column, terms: Column, path_score: Column, prior: Column) -> Column:
    return lexical + 0.05 * identity + anchor + 0.18 * terms + 0.12 * path_score + 0.35 * prior


# What a kind of question adds for a kind of file (source, test, doc, any other), and for names that it favours.
# A name is given as (how it is compared, the value, what it adds); "dir" compares a part of the path.
PRIORS = {
    "test_location": ((0.15, 2.5, -1.5, -1.0), ()),
    "config_location": ((0.1, -0.8, -0.45, 0.1), (("starts", "config.", 2.4), ("dir", "config", 1.3))),
    "indexing_rules": ((0.1, -1.2, -0.4, 0.1), (("is", "indexer.py", 1.9), ("is", "indexer.rs", 1.9), ("ends", "_indexer.py", 1.9), ("has", "ignore", 1.0))),
    "search_result_logic": ((0.1, -5.0, -0.4, 0.1), (("is", "storage.py", 1.6), ("is", "search.rs", 1.6), ("has", "search", 1.0), ("has", "storage", 1.0))),
    "file_location": ((0.35, -0.9, -0.35, -0.8), ()),
    "implementation": ((0.35, -0.9, -0.35, -0.8), ()),
}
OTHERWISE = {"lockfile": -0.8, "generated": -0.8}
#: Questions whose prior for tests holds whatever a test is called.
TESTS_FIRST = ("search_result_logic",)
SNAPSHOT_PRIOR = -1.0


def intent_prior(intent: str, path: Column) -> Column:
    """What a kind of question adds for a kind of file, by PRIORS."""
    kind, low = T.source_type(path), F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    if intent not in PRIORS:
        return F.coalesce(*[F.when(kind == k, v) for k, v in OTHERWISE.items()], F.lit(0.0))
    (source, test, doc, rest), names = PRIORS[intent]
    name = T.basename(low)
    compared = {"is": lambda v: name == v, "starts": name.startswith, "ends": name.endswith, "has": name.contains, "dir": lambda v: low.contains(f"/{v}/") | low.endswith(f"/{v}")}
    by_kind = F.when(kind == "source", source).when(kind == "test", test).when(kind == "doc", doc).otherwise(rest)
    first = [F.when(kind == "test", test)] if intent in TESTS_FIRST else []
    return F.coalesce(*first, *[F.when(compared[how](value), worth) for how, value, worth in names], by_kind)


def version_prior(query: str, path: Column) -> Column:
    """What a document of a version adds if the query doesn't name the version."""
    versions = T.version_tokens(T.basename(path))
    named = F.arrays_overlap(versions, T.version_tokens(F.lit(query)))
    return F.when(T.is_document(path) & (F.size(versions) > 0) & ~named, SNAPSHOT_PRIOR).otherwise(0.0)


def confidence(top: Column, gap: Column, covered: Column, terms: Column, lanes: Column) -> Column:
    """0 to 1 from the best score, its lead, the terms it covers and how many lanes agree; by retrieval alone without terms."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    agree = F.least(F.lit(1.0), lanes / 4.0)
    share = covered / F.greatest(F.lit(1), F.least(terms, F.lit(8)))
    by_terms = F.least(F.lit(1.0), 0.18 * unit(top) + 0.42 * share + 0.18 * agree + 0.22 * F.least(F.lit(1.0), gap))
    alone = F.least(F.lit(1.0), 0.62 * unit(top * 2) + 0.20 * agree + 0.18 * F.least(F.lit(1.0), gap * 5))
    alone = F.when((lanes < 2) & (gap < 0.05), F.least(alone, F.lit(0.67))).otherwise(alone)
    return F.when(terms > 0, by_terms).otherwise(alone)


def quality(score: Column) -> Column:
    return F.when(score >= 0.68, "best").when(score >= 0.45, "degraded").otherwise("uncertain")


def strict_passed(kind: Column, fresh: Column, evidence: Column, lanes: Column, semantic_rank: Column, k: int) -> Column:
    return (kind == "best") & fresh & evidence & (lanes >= 2) & F.coalesce(semantic_rank <= max(k, 3), F.lit(False))


def content_score(terms: list[str], query: str, path: Column, snippet: Column) -> Column:
    """Of a content scan: 0.60 of the share of terms, 0.25 of the lexical score, 0.15 of the share of terms in the path."""
    n = max(1, len(terms))
    both = T.hit_count(terms, F.concat(path, F.lit("\n"), snippet)) / n
    return F.least(F.lit(1.0), 0.60 * both + 0.25 * T.lexical_score(query, path, snippet) + 0.15 * T.hit_count(terms, path) / n)


def low_evidence_gate(results: DataFrame, terms: list[str], floor: float = 0.5) -> DataFrame:
    """results (path, snippet, score) if the best score reaches floor or enough terms occur among them; else none."""
    if not terms:
        return results
    need = 1 if len(terms) <= 2 else max(2, min(3, (len(terms) + 1) // 2))
    low = F.lower(F.concat_ws("\n", "path", "snippet"))
    w = Window.partitionBy()
    hits = sum((F.max(T.any_of(low.contains(v) for v in T.surface_variants(t)).cast("int")).over(w) for t in terms), F.lit(0))
    return results.withColumn("__keep", (F.max("score").over(w) >= floor) | (hits >= need)).filter("__keep").drop("__keep")


def living_authority(results: DataFrame, query: str, score: str = "score", tie: str = "id") -> DataFrame:
    """If an unversioned policy document leads, only other authorities, files that aren't documents, and documents or
    versions that the query names stay."""
    leader = results.agg(F.max_by("path", F.struct(F.col(score), -F.col(tie))).alias("__leader"))
    versions = T.version_tokens(T.basename(F.col("path")))
    words = [x for x in T.re.findall(r"[A-Za-z0-9]+", query.lower()) if len(x) >= 4]
    stem = F.filter(F.split(F.lower(F.regexp_replace(T.basename(F.col("path")), r"\.[^.]*$", "")), "[^a-z0-9]+"), lambda t: F.char_length(t) >= 4)
    named = F.arrays_overlap(stem, F.array(*map(F.lit, words))) if words else F.lit(False)
    known = F.arrays_overlap(versions, T.version_tokens(F.lit(query)))
    keep = ~T.is_document(F.col("path")) | T.is_authority(F.col("path")) | F.when(F.size(versions) > 0, known).otherwise(named)
    marked = results.crossJoin(F.broadcast(leader)).withColumn("__on", T.is_authority(F.col("__leader"))).withColumn("__keep", keep)
    return marked.filter(~F.col("__on") | F.col("__keep")).drop("__leader", "__on", "__keep")


def shortcut_gate(hits: DataFrame, terms: int, most_terms: int = 6, most_files: int = 10, least_overlap: int = 2, most_folders: int = 2) -> DataFrame:
    """One row: files, overlap, folders, passed. hits (path, overlap)."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    one = hits.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.max("overlap"), F.lit(0)).alias("overlap"), F.count_distinct(parent).alias("folders"))
    passed = F.lit(terms <= most_terms) & (F.col("files") > 0) & (F.col("files") <= most_files) & (F.col("overlap") >= least_overlap) & (F.col("folders") <= most_folders)
    return one.withColumn("passed", passed)


def symbol_hits(symbols: DataFrame, terms: list[str]) -> DataFrame:
    """file, hits (distinct terms), exact: files with a symbol that is a term, or has it as a token."""
    words = F.split("name_lower", " ")
    found = F.array_compact(F.array(*[F.when(F.array_contains(words, t) | (F.lower("name") == t), F.struct(F.lit(t).alias("term"), (F.lower("name") == t).alias("exact"))) for t in terms]))
    rows = symbols.select("file", F.explode(found).alias("x"))
    return rows.groupBy("file").agg(F.count_distinct("x.term").alias("hits"), F.bool_or("x.exact").alias("exact"))


def symbol_score(hits: Column, exact: Column, terms: int) -> Column:
    return hits / max(1, terms) + F.when(exact, 0.05).otherwise(0.0)


def anchor_overlap(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """chunks with `anchor`: the best score of an anchor in the same file whose lines overlap the chunk's (0 if none)."""
    a = anchors.select(F.col("file").alias("__f"), F.col("start_line").alias("__a"), F.col("end_line").alias("__b"), F.col("score").alias("__s"))
    hit = (F.col("file") == F.col("__f")) & (F.col("start_line") <= F.col("__b")) & (F.col("end_line") >= F.col("__a"))
    return chunks.join(a, hit, "left").groupBy(*chunks.columns).agg(F.coalesce(F.max("__s"), F.lit(0.0)).alias("anchor"))
