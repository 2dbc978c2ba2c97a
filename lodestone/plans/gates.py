"""Decisions over result sets: output boundaries, when evidence is enough, merging by depth, optional enhancers.

Results are (path, snippet, score, fallback and more) with `rank`. Edge cases: an empty result set is never enough; null
snippets have no evidence; ties go by rank.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import rank as R
from lodestone.plans import intents as I
from lodestone.plans import metadata as M

RECOVERY_FLOOR = 0.5


def output_boundary(results: DataFrame, root: str | None = None, scoped: bool = False, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Results inside a scope whose path, absolute or relative to the root, is included in a form and excluded in none."""
    path = F.col("path")
    rows = results.filter(F.coalesce(path, F.lit("")) != "")
    if scoped and root:
        base = root.rstrip("/")
        rows = rows.filter(F.when(path.startswith("/"), (path == base) | path.startswith(base + "/")).otherwise(~path.startswith("..")))
    forms = [path, T.display_path(path, root)] if root else [path]
    if include:
        rows = rows.filter(T.any_of(T.glob_match(f, include) for f in forms))
    if exclude:
        rows = rows.filter(~T.any_of(~T.glob_match(f, (), exclude) for f in forms))
    return rows


def filename_enough(query: str, decision: I.Decision, full: bool = False, answer: bool = False) -> bool:
    """Whether files found by name can end a search."""
    if answer or decision.intent != "filename":
        return False
    found = I.fast_intent(query)
    if full or found is None:
        return full
    return found.intent == "filename" or found.intent.startswith("metadata_") and decision.metadata is not None and not decision.terminal


def descriptor_enough(results: Column, decision: I.Decision, answer: bool = False) -> Column:
    ok = not answer and not decision.terminal and decision.metadata is not None and decision.intent in ("filename", "mixed")
    return (results > 0) & F.lit(ok)


def lexical_enough(results: DataFrame, query: str, decision: I.Decision | None = None, full: bool = False, answer: bool = False) -> DataFrame:
    """One row, enough: whether the first result's text has two of the query's terms and a strong lexical score."""
    plain = M.strip_scope(query) or query
    terms = [t.lower() for t in T.query_terms(plain)]
    able = not (full or answer or (decision is not None and decision.intent == "filename")) and len(terms) >= 2
    least = 0.18 if plain != query else 0.4
    first = results.orderBy("rank").limit(1).select((F.col("lexical_score") >= least).alias("strong"), T.hit_count(terms, F.coalesce("snippet", F.lit(""))).alias("hits"))
    return first.agg((F.lit(able) & F.coalesce(F.bool_or(F.col("strong") & (F.col("hits") >= 2)), F.lit(False))).alias("enough"))


def scan_strong(results: DataFrame, query: str) -> DataFrame:
    """One row, strong: three results at least, and two words of the query, or parts of names, in their paths."""
    words = [w for w in query.split() if len(w) >= 3]
    terms = dict.fromkeys([w.lower() for w in words] + [p.lower() for w in words for p in re.findall(r"[A-Z][a-z]+|[a-z]{3,}|\d+", w) if len(p) >= 3])
    low = F.lower("path")
    plain = F.regexp_replace(low, "[_-]", "")
    hits = sum((F.coalesce(F.max((low.contains(t) | plain.contains(t)).cast("int")), F.lit(0)) for t in terms), F.lit(0))
    return results.agg(((F.count(F.lit(1)) >= 3) & (hits >= 2)).alias("strong"))


def depth_merge(sources: list[DataFrame], k: int) -> DataFrame:
    """path, rank, snippet, fallback: the first k paths of sources in order; a path that was only found by name takes the
    first deeper text for it, and keeps its place."""
    every = None
    for number, s in enumerate(sources):
        part = s.select("path", "rank", "snippet", "fallback").withColumn("source", F.lit(number))
        every = part if every is None else every.unionByName(part)
    named = F.coalesce(F.col("fallback") == "filename-lookup", F.lit(False))
    deep = ~named & F.coalesce(F.col("snippet").rlike(r"\S"), F.lit(False))
    at, body = F.struct("source", "rank"), F.struct("snippet", "fallback")
    merged = every.filter(F.coalesce("path", F.lit("")) != "").groupBy("path").agg(
        F.min(at).alias("at"), F.min_by(body, at).alias("first"), F.min_by(F.when(deep, body), F.when(deep, at)).alias("deep"),
    )
    best = F.when(F.col("first.fallback") == "filename-lookup", F.coalesce("deep", "first")).otherwise(F.col("first"))
    kept = merged.orderBy("at", "path").limit(k).withColumn("b", best).withColumn("rank", F.row_number().over(Window.orderBy("at", "path")))
    return kept.select("path", "rank", "b.snippet", "b.fallback")


def anchor_leads(names: int, decision: I.Decision | None) -> bool:
    """Whether files found by name come first for a question about content."""
    return names > 0 and decision is not None and decision.intent == "semantic"


def looks_like_name(token: str) -> bool:
    han = bool(re.fullmatch(r"[㐀-鿿]+", token or ""))
    shaped = any(c.isdigit() or c in "._-" for c in token) or token not in (token.lower(), token.upper())
    return len(token) >= 2 and (han or len(token) >= 3 and shaped)


def extend_names(results: DataFrame, query: str, decision: I.Decision | None, scoped: bool = False) -> DataFrame:
    """One row, fire: whether to look for a file's name outside the root, as no result's name has it."""
    tokens = [t.lower() for t in M.name_candidates(query, decision.token if decision else "")]
    able = decision is not None and decision.intent == "filename" and not scoped
    found = F.coalesce(F.bool_or(T.any_of(F.lower(T.basename(F.col("path"))).contains(t) for t in tokens)), F.lit(False))
    return results.agg((F.lit(able) & ((F.count(F.lit(1)) == 0) | (F.lit(bool(tokens)) & ~found))).alias("fire"))


def recovery_hint(results: DataFrame, decision: I.Decision | None, recovering: bool) -> DataFrame:
    """One row, fire: whether to say that vectors are still being made again."""
    able = decision is not None and decision.intent == "semantic" and recovering
    return results.agg((F.lit(able) & (F.coalesce(F.max_by("score", -F.col("rank")), F.lit(0.0)) < RECOVERY_FLOOR)).alias("fire"))


@dataclass(frozen=True)
class Enhancer:
    """An optional branch: fires(query, decision, results) -> bool, run(query, decision, k) -> DataFrame (path, snippet, score)."""

    name: str
    fires: Callable[[str, I.Decision | None, DataFrame], bool]
    run: Callable[[str, I.Decision | None, int], DataFrame]


ENHANCERS: dict[str, Enhancer] = {}


def register_enhancer(enhancer: Enhancer) -> None:
    ENHANCERS[enhancer.name] = enhancer


def enhanced(results: DataFrame, query: str, decision: I.Decision | None, k: int = 10) -> DataFrame:
    """path, snippet, score, source: what the enhancers that fire add, results' own paths left out. One plan for all."""
    every = results.select("path", "snippet", "score").withColumn("source", F.lit("search")).limit(0)
    for e in ENHANCERS.values():
        if e.fires(query, decision, results):
            every = every.unionByName(e.run(query, decision, k).select("path", "snippet", "score").withColumn("source", F.lit(f"proactive:{e.name}")))
    new = every.join(results.select("path"), "path", "left_anti")
    return R.best_per_key(new, ["path"], [F.desc("score"), F.col("source")])


def union_queries(searches: list[DataFrame], k: int) -> DataFrame:
    """Results of several questions cut from one: each row's best score, then the k best."""
    every = searches[0]
    for s in searches[1:]:
        every = every.unionByName(s)
    return R.top_k(R.best_per_key(every, ["path", "id"], [F.desc("score")]), k)


def explain(rows: DataFrame) -> Column:
    """Why a row is there: its lane or channels and their ranks, matched symbols, scores. Columns that rows lacks aren't told."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    lane, cosine, symbol = F.coalesce(has("fallback"), F.lit("")), has("cosine_rank"), has("symbol_rank")
    number = lambda c, form: F.when(c.isNotNull(), F.format_string(form, c.cast("double")))
    channels = (
        F.when(cosine.isNotNull() & symbol.isNotNull(), F.concat(F.lit("cosine #"), cosine.cast("string"), F.lit(" ⊕ symbol #"), symbol.cast("string"), F.lit(" (RRF)")))
        .when(cosine.isNotNull(), F.concat(F.lit("cosine #"), cosine.cast("string"))).when(symbol.isNotNull(), F.concat(F.lit("symbol #"), symbol.cast("string"))).otherwise("cosine cascade")
    )
    token = F.when(has("token").isNotNull() & (lane == "filename-lookup"), F.concat(F.lit('token "'), has("token").cast("string"), F.lit('"')))
    lexical = F.when(lane.isin("ripgrep", "rg-shortcut"), number(has("lexical_score"), "lex=%.2f"))
    first = F.when(lane.isin("filename-lookup", "ripgrep", "rg-shortcut"), lane).otherwise(channels)
    return F.concat_ws(" · ", first, token, lexical, number(has("score"), "score=%.3f"), number(has("fused_score"), "rrf=%.3f"))
