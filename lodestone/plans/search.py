"""Composite searches over chunks (id, path, language, chunk, embedding).

Texts stay where they are read: scores are computed beside them, rows without text are ranked, and the texts of the ranked rows are
fetched last, by a join to which those few rows are sent. Tokens are cut only from chunks whose vectors can still win: `lexical` is
between 0 and 1, so a first pass over vectors alone gives a score that enough chunks of enough files are sure to reach, and a chunk whose
score with a lexical part of 1 is below it is left out. The scores of the chunks found that way, exactly, make that bound sharper.

Edge cases: ids are unique; ties go by id; null vectors and those of another dimension are left out; null texts and paths have no tokens;
an empty table gives an empty result. Results carry `rank`; they come in no order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import evidence as E
from lodestone.operators import rank as R
from lodestone.plans.planner import QuerySpec

LEXICAL_WEIGHT, SYMBOL_WEIGHT = 0.2, 0.10


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def cosine_rows(rows: DataFrame, query: Column) -> DataFrame:
    return rows.withColumn("semantic_score", V.cosine(F.col("embedding"), query))


def file_cosine(files: DataFrame, query: Column, top: int) -> DataFrame:
    """file, score: the files whose mean vectors are nearest."""
    scored = files.select("file", V.cosine(F.col("embedding"), query).alias("score"))
    return scored.orderBy(F.desc("score"), "file").limit(top)


def _eligible(chunks: DataFrame, spec: QuerySpec, files: DataFrame | None) -> DataFrame:
    """Chunks that pass a question's filters, with the semantic score in place of the vector."""
    rows = chunks
    if spec.languages:
        rows = rows.filter(F.col("language").isin(*spec.languages))
    if spec.include or spec.exclude:
        rows = rows.filter(T.glob_match(F.col("path"), spec.include, spec.exclude))
    if spec.vector is None:
        raise ValueError("a QuerySpec needs a vector for hybrid_search; symbol_search and the recall module work without one")
    query = vector_literal(spec.vector)
    rows = rows.filter(V.has_dimension(F.col("embedding"), len(spec.vector)))
    if spec.multi_resolution and files is not None:
        short = file_cosine(files, query, spec.file_top).select(F.col("file").alias("path"))
        near = rows.join(F.broadcast(short), "path", "left_semi")
        rows = near if not spec.include or not near.isEmpty() else rows
    return cosine_rows(rows, query).drop("embedding")


def _blend(semantic: Column, lexical: Column | float, semantic_only: bool) -> Column:
    return semantic if semantic_only else semantic * (1 - LEXICAL_WEIGHT) + lexical * LEXICAL_WEIGHT


def _place(rows: DataFrame) -> list[str]:
    return [c for c in ("start_line", "end_line") if c in rows.columns]


def sure_score(rows: DataFrame, lower: Column, need: int, per_file: int, exact: Column | None = None, first: int = 4, again: int = 8, passes: int = 3) -> float | None:
    """A score that `need` rows, at most per_file of a path, are sure to reach, as their lower bounds do; None if there aren't so many. Reads
    ids, paths, lines and what `lower` needs. With `exact`, the rows found that way are read once more, by id, and their exact
    scores raise the bound. Each pass brings a fixed number of rows, without texts, to the driver. Rows of one path and lines may be
    copies, so they count once."""
    place, most = _place(rows), first * need

    def reached(best: list) -> float | None:
        seen, of_path, found = set(), Counter(), 0
        for r in best:
            key = (r["path"], *(r[c] for c in place))
            if key not in seen and of_path[r["path"]] < per_file:
                seen.add(key)
                of_path[r["path"]] += 1
                found += 1
                if found == need:
                    return r["__bound"]
        return None

    for _ in range(passes):
        best = rows.select("id", "path", *place, lower.alias("__bound")).filter("__bound IS NOT NULL").orderBy(F.desc("__bound"), "id").limit(most).collect()
        sure = reached(best)
        if sure is not None and exact is not None:
            some = rows.filter(F.col("id").isin([r["id"] for r in best])).select("id", "path", *place, exact.alias("__bound"))
            raised = reached(sorted(some.filter("__bound IS NOT NULL").collect(), key=lambda r: -r["__bound"]))
            sure = max(sure, raised) if raised is not None else sure
        if sure is not None or len(best) < most:
            return sure
        most *= again
    return None


def _needed(spec: QuerySpec, tiebreak: bool, reranked: bool) -> tuple[int, int]:
    """How many ranked rows decide the result, and how many of a path."""
    if reranked:
        return spec.rerank_pool, spec.rerank_pool
    if tiebreak:
        return max(spec.top_k * 4, 50), spec.top_k
    return spec.top_k, 1 if spec.rank_by == "file" else R.PER_FILE


def fetch(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked (a result set: some rows, without text) with the texts of its chunks, which are read once more and not moved."""
    return chunks.select("id", "chunk").join(F.broadcast(ranked), "id").select(*ranked.columns, "chunk")


def ranked_chunks(chunks: DataFrame, spec: QuerySpec, files: DataFrame | None = None, symbols: DataFrame | None = None, pagerank: DataFrame | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`hybrid_search` without texts."""
    rows = _eligible(chunks, spec, files)
    terms = T.query_terms(spec.query)
    boosted = bool(spec.use_symbol_boost and symbols is not None and terms)
    tiebreak = spec.use_graph_tiebreak and pagerank is not None
    adjusted = lambda score: R.penalised(score, T.is_non_canonical(F.col("path"))) if reranker is None else score
    need, per_file = _needed(spec, tiebreak, reranker is not None)
    lexical = F.lit(0.0) if spec.semantic_only else T.lexical_score(spec.query, F.col("path"), F.col("chunk"))
    low, exact, high = (adjusted(_blend(F.col("semantic_score"), x, spec.semantic_only)) for x in (0.0, lexical, 1.0))
    sure = sure_score(rows, low, need, per_file, None if spec.semantic_only else exact)
    if sure is not None:
        most_boost = SYMBOL_WEIGHT if boosted and reranker is None else 0.0
        rows = rows.filter(high + most_boost >= sure)
    rows = rows.withColumn("lexical_score", lexical).withColumn("score", _blend(F.col("semantic_score"), F.col("lexical_score"), spec.semantic_only))
    rows = rows.withColumn("__h", F.xxhash64("chunk")).drop("chunk")
    rows = R.max_dedupe(rows, ["path", *_place(rows), "__h"]).drop("__h")
    if reranker is not None:
        rows = reranker(fetch(R.top_k(rows, spec.rerank_pool), chunks)).drop("chunk")
    rows = rows.withColumn("score", R.penalised(F.col("score"), T.is_non_canonical(F.col("path"))))
    if boosted:
        hits = E.symbol_hits(symbols, terms).select(F.col("file").alias("path"), (SYMBOL_WEIGHT * F.col("hits") / len(terms)).alias("boost"))
        rows = rows.join(hits, "path", "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")
    if tiebreak:
        rows = R.graph_tiebreak(R.diversify(rows, max(spec.top_k * 4, 50), spec.top_k).drop("rank"), pagerank).drop("bump")
    if spec.rank_by == "file":
        return R.file_rank(rows, spec.top_k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return R.diversify(rows, spec.top_k)


def hybrid_search(chunks: DataFrame, spec: QuerySpec, files: DataFrame | None = None, symbols: DataFrame | None = None, pagerank: DataFrame | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Filters, cosine and lexical blend, dedupe, optional reranking, penalty, symbol boost, tie-break, then a cap for
    each file or the best of each, as `rank`; with texts."""
    return fetch(ranked_chunks(chunks, spec, files, symbols, pagerank, reranker), chunks)


def cascade_gate(files: DataFrame, query: Column, top_k: int = 10) -> DataFrame:
    """One row: gap, sigma, threshold, early_exit, over the best files."""
    pool = file_cosine(files, query, max(top_k, 10))
    w = Window.orderBy(F.desc("score"), "file")
    ranked = pool.withColumn("rn", F.row_number().over(w))
    one = ranked.agg(
        (F.max(F.when(F.col("rn") == 1, F.col("score"))) - F.max(F.when(F.col("rn") == 2, F.col("score")))).alias("gap"),
        F.stddev_pop("score").alias("sigma"), F.count(F.lit(1)).alias("n"),
    )
    one = one.withColumn("threshold", V.gate_threshold(F.col("sigma"), F.col("n")))
    return one.withColumn("early_exit", F.coalesce((F.col("n") >= 2) & (F.col("gap") >= F.col("threshold")), F.lit(False)))


def cascade_search(chunks: DataFrame, files: DataFrame, spec: QuerySpec, second_vector: tuple[float, ...] | None = None) -> DataFrame:
    """If the best file leads clearly, its neighbours' chunks only; else all chunks by the query and by a second vector,
    the better score of each. The gate is the one action, on ten rows at most."""
    gate = cascade_gate(files, vector_literal(spec.vector), spec.top_k).first()
    near = file_cosine(files, vector_literal(spec.vector), max(spec.top_k, 10)).select(F.col("file").alias("path"))
    if gate["early_exit"]:
        return hybrid_search(chunks.join(F.broadcast(near), "path", "left_semi"), spec)
    first = ranked_chunks(chunks, spec)
    if second_vector is None:
        return fetch(first, chunks)
    again = ranked_chunks(chunks, QuerySpec(**{**spec.__dict__, "vector": second_vector}))
    both = R.best_per_key(first.drop("rank").unionByName(again.drop("rank")), ["path", "id"], [F.desc("score")])
    ranked = R.top_k(both, spec.top_k)
    return fetch(ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))), chunks)


def multi_channel_search(chunks: DataFrame, spec: QuerySpec, symbols: DataFrame, pool: int = 30) -> DataFrame:
    """path, id, score, cosine_rank, symbol_rank: chunks of the hybrid search and the first chunks of the files whose symbols
    match, fused by rank. A file's chunk that both channels return counts for both."""
    first = ranked_chunks(chunks, QuerySpec(**{**spec.__dict__, "top_k": pool}), symbols=symbols).select("path", "id", F.col("rank").alias("cosine_rank"))
    terms = [t for t in T.query_terms(spec.query) if len(t) >= 4]
    if not terms:
        both = first.withColumn("symbol_rank", F.lit(None).cast("int"))
    else:
        second = symbol_chunks(symbols, chunks, terms, pool).select(F.col("file").alias("path"), "id", F.col("rank").alias("symbol_rank"))
        both = first.join(second, ["path", "id"], "full")
    part = lambda c: F.coalesce(1.0 / (R.RRF_K + F.col(c)), F.lit(0.0))
    return R.top_k(both.withColumn("score", part("cosine_rank") + part("symbol_rank")), spec.top_k)


def symbol_chunks(symbols: DataFrame, chunks: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """symbol_search with the id of each file's first chunk; files without a chunk are left out before the limit."""
    order = F.struct("chunk_index", "id") if "chunk_index" in chunks.columns else F.struct("id")
    first = chunks.groupBy(F.col("path").alias("file")).agg(F.min_by("id", order).alias("id"))
    found = E.symbol_hits(symbols, terms).join(first, "file")
    w = Window.orderBy(F.desc("hits"), F.desc("exact"), "file")
    best = found.orderBy(F.desc("hits"), F.desc("exact"), "file").limit(k)
    return best.withColumn("score", E.symbol_score(F.col("hits"), F.col("exact"), len(terms))).withColumn("rank", F.row_number().over(w))


def symbol_search(symbols: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """file, hits, exact, score, rank of the files whose definitions match most terms."""
    hits = E.symbol_hits(symbols, terms)
    best = hits.orderBy(F.desc("hits"), F.desc("exact"), "file").limit(k)
    w = Window.orderBy(F.desc("hits"), F.desc("exact"), "file")
    return best.withColumn("score", E.symbol_score(F.col("hits"), F.col("exact"), len(terms))).withColumn("rank", F.row_number().over(w))


def verdict(results: DataFrame, terms: int) -> DataFrame:
    """One row: top_score, gap, confidence, quality of a context (path, score, lanes, evidence)."""
    w = Window.orderBy(F.desc("score"), "path")
    ranked = results.withColumn("rn", F.row_number().over(w))
    pick = lambda n, c: F.max(F.when(F.col("rn") == n, c))
    one = ranked.agg(pick(1, F.col("score")).alias("top_score"), F.coalesce(pick(2, F.col("score")), F.lit(0.0)).alias("second"), pick(1, F.size("evidence")).alias("covered"), pick(1, F.size("lanes")).alias("lanes"))
    one = one.withColumn("gap", F.greatest(F.lit(0.0), F.col("top_score") - F.col("second")))
    sure = E.confidence(F.col("top_score"), F.col("gap"), F.col("covered"), F.lit(terms), F.col("lanes"))
    return one.withColumn("confidence", F.coalesce(sure, F.lit(0.0))).withColumn("quality", E.quality(F.col("confidence"))).drop("second")
