"""Candidate recall and agent context: lanes vote for files, chunks of the best files are scored by evidence, and a verdict
says how sure the first one is.

files (path), chunks (id, path, chunk, start_line, end_line and more), symbols (file, name, name_lower, start_line,
end_line). Edge cases: a query without terms has no lanes but `include`; null chunks and paths have no terms; ties go by
path, then id; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evidence as E
from lodestone.operators import rank as R
from lodestone.plans import planner as P
from lodestone.plans.search import verdict

MOST_PATHS = 120
#: An identity score from which a chunk can anchor a support pack, and a lexical score from which it can join one.
ANCHOR_IDENTITY, SUPPORT_LEXICAL = 0.35, 0.25


def recall_paths(files: DataFrame, chunks: DataFrame, query: str, symbols: DataFrame | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), most: int = MOST_PATHS, intent: str | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """path, score, lanes of the files that most speaks for: each lane's votes are added, then what the kind of question
    adds for the kind of file. One pass over the chunks serves all terms."""
    terms, intent = T.query_terms(query, 12), intent or P.agent_intent(query)
    allowed = files.filter(T.glob_match(F.col("path"), include, exclude)) if include or exclude else files
    lanes = [E.path_lane(allowed, terms), E.term_lane(chunks, terms, "chunk", E.LANE_WEIGHTS["chunk"]), E.content_lane(chunks, terms, "rg", E.LANE_WEIGHTS["rg"])] if terms else []
    if include:
        first = allowed.select("path").distinct().orderBy("path").limit(most)
        lanes.append(first.select("path", F.lit("include").alias("lane"), F.lit(E.LANE_WEIGHTS["include"]).alias("score")))
    if symbols is not None and terms:
        lanes.append(E.symbol_lane(symbols, terms))
    if intent == "test_location":
        lanes.append(E.source_type_lane(allowed, terms, "test"))
    if not lanes:
        return allowed.select("path", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("lanes")).limit(0)
    votes = E.votes(lanes)
    if aliases is not None:
        votes = coalesce_aliases(votes, aliases)
    if include or exclude:
        votes = votes.filter(T.glob_match(F.col("path"), include, exclude))
    prior = E.intent_prior(intent, F.col("path")) + E.version_prior(query, F.col("path"))
    known = F.when(prior != 0, F.array(F.concat(F.lit("prior:"), T.source_type(F.col("path"))))).otherwise(F.array().cast("array<string>"))
    return votes.select("path", (F.col("score") + prior).alias("score"), F.array_sort(F.concat("lanes", known)).alias("lanes")).orderBy(F.desc("score"), "path").limit(most)


def coalesce_aliases(votes: DataFrame, aliases: DataFrame) -> DataFrame:
    """votes (path, score, lanes) by the paths that aliases (alias, path) stand for: the stored spelling's own score and the
    best of the others', all lanes."""
    named = votes.withColumnRenamed("path", "alias").join(aliases.select("alias", "path"), "alias", "left")
    named = named.withColumn("path", F.coalesce("path", "alias")).withColumn("own", F.col("path") == F.col("alias"))
    own = F.max(F.when(F.col("own"), F.col("score")))
    other = F.max(F.when(~F.col("own"), F.col("score")))
    merged = named.groupBy("path").agg((F.coalesce(own, F.lit(0.0)) + F.coalesce(other, F.lit(0.0))).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lanes")))).alias("lanes"))
    return merged


def identifier_names(chunk: Column) -> Column:
    """Names that a chunk defines: of its header, and definitions and constants in its first twelve lines."""
    head = F.array_join(F.slice(T.lines(chunk), 1, 12), "\n")
    listed = F.transform(F.regexp_extract_all(chunk, F.lit(r"\[symbol:\s*([^\]]+)\]"), F.lit(1)), lambda n: F.trim(n))
    defined = F.regexp_extract_all(head, F.lit(r"(?m)^\s*(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    constant = F.regexp_extract_all(head, F.lit(r"(?m)^\s*([A-Z][A-Z0-9_]{2,})\s*="), F.lit(1))
    return F.filter(F.concat(listed, defined, constant), lambda n: n != "")


def is_constant(name: Column) -> Column:
    return (name == F.upper(name)) & (name != F.lower(name))


def identity_score(terms: list[str], names: Column) -> Column:
    """How much a chunk's names are the query's terms, 1.5 at most."""
    forms = [f for t in terms if len(t) > 2 and (f := T.normal_forms(t))]

    def one(name: Column) -> Column:
        plain = T.plain_token(name)
        bonus = F.when(is_constant(name), 0.35).when(~name.startswith("_"), 0.2).otherwise(0.0)
        worth = [F.when(plain.isin(*f), 0.7 + bonus).when(T.any_of(plain.contains(x) for x in f), 0.45 + bonus).otherwise(0.0) for f in forms]
        return F.when(plain == "", 0.0).otherwise(sum(worth, F.lit(0.0)))

    return F.least(F.lit(1.5), F.aggregate(names, F.lit(0.0), lambda s, n: s + one(n)))


def name_hits(terms: list[str], names: Column) -> Column:
    """Indices of the terms of which a form lies in a name."""
    plain = F.transform(names, lambda n: T.plain_token(n))
    within = lambda forms: F.exists(plain, lambda n: T.any_of(n.contains(x) for x in forms))
    hit = [F.when(within(f), F.lit(i)) for i, t in enumerate(terms) if len(t) > 2 and (f := T.normal_forms(t))]
    return F.array_compact(F.array(*hit)) if hit else F.array().cast("array<int>")


def symbol_anchors(symbols: DataFrame, terms: list[str]) -> DataFrame:
    """file, start_line, end_line, name, score of symbols whose name has a term: 0.45, and 0.15 for each form in it."""
    forms = sorted({p for t in terms if len(t) > 2 for v in T.synonym_variants(t) if (p := "".join(c for c in v.lower() if c.isalnum()))})
    plain = T.plain_token(F.col("name"))
    n = sum((plain.contains(f).cast("int") for f in forms), F.lit(0))
    rows = symbols.select("file", "name", "start_line", F.coalesce("end_line", "start_line").alias("end_line"), n.alias("n")).filter("n > 0")
    return rows.select("file", "start_line", "end_line", "name", (0.45 + 0.15 * F.col("n")).alias("score"))


def scored_chunks(chunks: DataFrame, votes: DataFrame, query: str, symbols: DataFrame | None = None, intent: str | None = None, keep_all: bool = False) -> DataFrame:
    """Chunks of recalled files with their evidence and score."""
    terms, intent = T.query_terms(query, 16), intent or P.agent_intent(query)
    rows = chunks.join(F.broadcast(votes.select("path", F.col("score").alias("path_score"), "lanes")), "path")
    rows = rows.withColumn("chunk_lexical", T.lexical_score(query, F.lit(""), F.col("chunk"))).withColumn("lexical", F.col("chunk_lexical") + 0.5 * T.lexical_score(query, F.col("path"), F.lit("")))
    if not keep_all:
        rows = rows.filter("lexical > 0")
    rows = rows.withColumn("names", identifier_names(F.col("chunk"))).withColumn("identity", identity_score(terms, F.col("names")))
    rows = rows.withColumn("evidence", T.covered(T.query_terms(query, 12), F.concat("path", F.lit("\n"), F.col("chunk"))))
    rows = rows.withColumn("forms", T.covered_forms(terms, F.col("chunk"))).withColumn("hits", name_hits(terms, F.col("names")))
    if symbols is None or not terms:
        rows = rows.withColumn("anchor", F.lit(0.0))
    else:
        a = symbol_anchors(symbols, terms)
        a = a.select(F.col("file").alias("__f"), F.col("start_line").alias("__a"), F.col("end_line").alias("__b"), F.col("score").alias("__s"))
        met = rows.select("path", "id", "start_line", "end_line").join(a, (F.col("path") == F.col("__f")) & (F.col("start_line") <= F.col("__b")) & (F.col("end_line") >= F.col("__a")))
        best = met.groupBy("path", "id").agg(F.max("__s").alias("anchor"))
        rows = rows.join(best, ["path", "id"], "left").withColumn("lanes", F.when(F.col("anchor").isNotNull(), F.array_union("lanes", F.array(F.lit("symbol-anchor")))).otherwise(F.col("lanes")))
        rows = rows.withColumn("anchor", F.coalesce("anchor", F.lit(0.0)))
    prior = E.intent_prior(intent, F.col("path")) + E.version_prior(query, F.col("path"))
    return rows.withColumn("score", E.candidate_score(F.col("lexical"), F.col("identity"), F.col("anchor"), F.size("evidence"), F.col("path_score"), prior))


def candidate_chunks(chunks: DataFrame, votes: DataFrame, query: str, k: int = 10, symbols: DataFrame | None = None, intent: str | None = None, keep_all: bool = False) -> DataFrame:
    """The best chunk of each of the k best files."""
    best = R.best_per_key(scored_chunks(chunks, votes, query, symbols, intent, keep_all), ["path"], [F.desc("score"), F.col("id")])
    return R.top_k(best, k, tie="path")


def support_pack(scored: DataFrame, best: DataFrame, per_path: int = 2) -> DataFrame:
    """path, position, id of the chunks that support each file's best chunk: a constant's definition, a public name's, then
    those that add most; per_path at most. scored: of scored_chunks; best (path, id): the chosen ones. All is decided by
    windows over a file's chunks."""
    rows = scored.join(best.select("path", F.col("id").alias("__best")), "path").withColumn("__first", F.col("id") == F.col("__best"))
    named = ~F.col("__first") & (F.col("identity") >= ANCHOR_IDENTITY)
    joined = F.lower(F.array_join("names", " "))
    by_anchor = [F.desc(F.size("hits")), F.desc("identity"), F.coalesce(F.array_min("hits"), F.lit(999)), (joined.contains("test") | joined.contains("fixture")).cast("int"), F.coalesce("start_line", F.lit(0)), F.desc("score"), F.col("id")]
    constant = named & F.exists("names", is_constant)
    public = named & F.exists("names", lambda n: ~n.startswith("_") & ~is_constant(n))
    pick = lambda flag: F.row_number().over(Window.partitionBy("path", flag).orderBy(*by_anchor)) == 1
    rows = rows.withColumn("__c", constant).withColumn("__c", F.col("__c") & pick("__c"))
    rows = rows.withColumn("__p", public & ~F.col("__c")).withColumn("__p", F.col("__p") & pick("__p"))
    if per_path < 2:
        some = F.max("__c").over(Window.partitionBy("path"))
        rows = rows.withColumn("__p", F.col("__p") & ~some & F.lit(per_path > 0)).withColumn("__c", F.col("__c") & F.lit(per_path > 0))
    whole = Window.partitionBy("path")
    chosen = F.col("__first") | F.col("__c") | F.col("__p")
    rows = rows.withColumn("__known", F.flatten(F.collect_list(F.when(chosen, F.col("forms"))).over(whole))).withColumn("__taken", F.sum((F.col("__c") | F.col("__p")).cast("int")).over(whole))
    adds = F.size(F.array_except("forms", "__known")) > 0
    useful = ~chosen & (adds | (F.col("identity") >= ANCHOR_IDENTITY) | (F.col("chunk_lexical") >= SUPPORT_LEXICAL))
    worth = 2.0 * F.col("identity") + F.col("chunk_lexical") + 0.2 * F.size("forms")
    rows = rows.withColumn("__u", useful).withColumn("__w", worth).withColumn("__adds", adds)
    turn = F.row_number().over(Window.partitionBy("path", "__u").orderBy(F.desc("__w"), F.desc("__adds"), F.desc("score"), "id"))
    rows = rows.withColumn("__turn", turn)
    position = F.when(F.col("__c"), 0).when(F.col("__p"), F.col("__taken") - 1).when(F.col("__u") & (F.col("__turn") <= per_path - F.col("__taken")), F.col("__taken") + F.col("__turn") - 1)
    return rows.select("path", position.alias("position"), "id").filter("position IS NOT NULL")


def agent_context(files: DataFrame, chunks: DataFrame, query: str, k: int = 8, symbols: DataFrame | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), aliases: DataFrame | None = None) -> DataFrame:
    """path, id, score, lanes, evidence and more of the k best files' best chunks."""
    intent = P.agent_intent(query)
    votes = recall_paths(files, chunks, query, symbols, include, exclude, max(k * (8 if intent == "test_location" else 5), k), intent, aliases)
    return candidate_chunks(chunks, votes, query, k, symbols, intent, bool(include))


def merge_contexts(groups: list[DataFrame], k: int) -> DataFrame:
    """path, id, score, lanes, evidence: the better row of each path, with the lanes of all."""
    every = groups[0].select("path", "id", "score", "lanes", "evidence")
    for g in groups[1:]:
        every = every.unionByName(g.select("path", "id", "score", "lanes", "evidence"))
    lanes = F.array_sort(F.array_distinct(F.flatten(F.collect_list("lanes"))))
    best = F.max_by(F.struct("id", "score", "evidence"), F.struct("score", F.size("lanes")))
    merged = every.groupBy("path").agg(best.alias("b"), lanes.alias("lanes")).select("path", "b.id", "b.score", "lanes", "b.evidence")
    return merged.orderBy(F.desc("score"), "path").limit(k)


def strict_verdict(context: DataFrame, terms: int, semantic: DataFrame, stored: DataFrame, listing: DataFrame, k: int = 8) -> DataFrame:
    """verdict's row, path, fresh, semantic_rank, passed: whether a context's first file is best by confidence, has evidence,
    two lanes, stored chunks as new as the file (within a second), and is among the k best by meaning.
    semantic (path, rank), stored (path, file_mtime: a row for each chunk), listing (path, mtime)."""
    first = context.orderBy(F.desc("score"), "path").limit(1).select("path", F.size("evidence").alias("n"))
    indexed = stored.join(F.broadcast(first.select("path")), "path", "left_semi").groupBy("path").agg(F.max("file_mtime").alias("indexed"))
    one = first.join(indexed, "path", "left").join(listing.select("path", "mtime"), "path", "left").join(semantic.select("path", F.col("rank").alias("semantic_rank")), "path", "left")
    one = one.withColumn("fresh", F.coalesce(F.abs(F.col("mtime") - F.col("indexed")) <= 1.0, F.lit(False)))
    both = verdict(context, terms).crossJoin(F.broadcast(one.select("path", "fresh", "semantic_rank", "n")))
    passed = E.strict_passed(F.col("quality"), F.col("fresh"), (F.col("n") > 0) | F.lit(terms == 0), F.col("lanes"), F.col("semantic_rank"), k)
    return both.withColumn("passed", passed).drop("n")
