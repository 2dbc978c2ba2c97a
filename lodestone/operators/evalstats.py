"""Evaluation statistics: pairing, gates, percentiles, bootstrap, rollups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("repo", "task_id", "effort", "trial")


def distribution(value: str) -> list[Column]:
    v = F.col(value)
    return [F.count(v).alias("n"), F.percentile(v, 0.25).alias("p25"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.75).alias("p75"), F.min(v).alias("min"), F.max(v).alias("max")]


def ratio(baseline: Column, treatment: Column) -> Column:
    return F.when((treatment > 0) & (baseline >= 0), baseline / treatment)


def paired(trials: DataFrame, treatment: str, baseline: str, fields: tuple[str, ...]) -> DataFrame:
    """A row for each key that both policies have: t_<field> and b_<field>. One aggregation, no self-join."""
    pick = lambda p, f: F.max(F.when(F.col("policy") == p, F.col(f)))
    both = trials.filter(F.col("policy").isin(treatment, baseline)).groupBy(*KEY).agg(
        *[pick(p, f).alias(f"{s}_{f}") for s, p in (("t", treatment), ("b", baseline)) for f in fields], F.count_distinct("policy").alias("__n")
    )
    return both.filter("__n = 2").drop("__n")


def eligible(pairs: DataFrame, floor: float = 0.85) -> DataFrame:
    return pairs.filter("t_work_completed AND b_work_completed").filter((F.col("t_task_completion_quality") >= floor) & (F.col("b_task_completion_quality") >= floor))


def task_medians(pairs: DataFrame, field: str) -> DataFrame:
    """repo, task_id, value: the median over trials of baseline / treatment."""
    r = pairs.select("repo", "task_id", ratio(F.col(f"b_{field}"), F.col(f"t_{field}")).alias("value")).filter("value IS NOT NULL")
    return r.groupBy("repo", "task_id").agg(F.percentile("value", 0.5).alias("value"))


def paired_efficiency(trials: DataFrame, treatment: str, baseline: str, field: str = "context_tokens", floor: float = 0.85, margin: float = 0.02, least_tasks: int = 30, least_repos: int = 3) -> DataFrame:
    """One row: pairs, eligible pairs, quality gate, distribution of task medians, ratio of sums, claim status."""
    fields = (field, "task_completion_quality", "work_completed")
    pairs = paired(trials, treatment, baseline, fields)
    good = eligible(pairs, floor)
    all_ = pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        (F.avg("t_task_completion_quality") + margin >= F.avg("b_task_completion_quality")).alias("quality_ok"),
        (F.avg(F.col("t_work_completed").cast("double")) + margin >= F.avg(F.col("b_work_completed").cast("double"))).alias("completion_ok"),
    )
    some = good.agg(F.count(F.lit(1)).alias("eligible"), F.sum(f"t_{field}").alias("t_sum"), F.sum(f"b_{field}").alias("b_sum"))
    tasks = task_medians(good, field)
    spread = tasks.agg(*distribution("value"), F.count_distinct("repo").alias("repos"))
    one = all_.crossJoin(F.broadcast(some)).crossJoin(F.broadcast(spread))
    gate = F.coalesce(F.col("quality_ok") & F.col("completion_ok"), F.lit(False)) & (F.col("pairs") > 0)
    enough = (F.col("n") >= least_tasks) & (F.col("repos") >= least_repos) & (F.col("eligible") / F.greatest("pairs", F.lit(1)) >= 0.8)
    return one.select(
        "pairs", "eligible", gate.alias("quality_gate"), "n", "p25", "median", "p75", "min", "max",
        F.when(F.col("t_sum") > 0, F.col("b_sum") / F.col("t_sum")).alias("ratio_of_sums"), F.when(gate & enough, "reportable").otherwise("insufficient").alias("claim_status"),
    )


#: Up to so many tasks, their values are sent to where the draws are made, 12 bytes a task.
BOOTSTRAP_TASKS = 4_000_000


def bootstrap_medians(tasks: DataFrame, samples: int = 2000, seed: int = 20260814, most: int = BOOTSTRAP_TASKS) -> DataFrame:
    """sample, value: medians of tasks (repo, task_id, value) drawn repo by repo, then task by task, with replacement.
    Draws are hashes of (seed, sample, place), so they don't depend on partitions. Input is one row a task; tasks and repositories are
    numbered, and a draw is a row with a number. Up to `most` tasks, the values are one bounded broadcast and draws stay where they are made:
    no draw is shuffled, and a task holds one sample's draws. Beyond, a join gives a draw its value, so that no row or broadcast
    holds all tasks, and equal values of a sample are counted before its median is found; the draws are the same. Null repositories are one; without tasks
    there are no samples."""
    draw = lambda *at: F.pmod(F.xxhash64(F.lit(seed), "sample", *at[:-1]), at[-1]).cast("int")
    numbered = tasks.select("repo", "value", (F.row_number().over(Window.partitionBy("repo").orderBy("task_id", "value")) - 1).alias("k"))
    repos = tasks.groupBy("repo").agg(F.count(F.lit(1)).cast("int").alias("n"))
    # Only repositories are numbered over all, and their number is a bound of what one task sees here.
    repos = repos.select("repo", "n", (F.row_number().over(Window.orderBy("repo")) - 1).alias("r"))
    total = repos.agg(F.count(F.lit(1)).cast("int").alias("repos"))
    here = tasks.count() <= most
    places = tasks.sparkSession.range(0, samples, 1, min(max(samples, 1), 256)).select(F.col("id").alias("sample")).crossJoin(F.broadcast(total)).filter("repos > 0")
    places = places.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("repos"))))
    picked = places.select("sample", "i", draw(F.col("i"), F.col("repos")).alias("r")).join(F.broadcast(repos) if here else repos, "r")
    if here:
        drawn = picked.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n")))).select("sample", "r", draw(F.col("i"), F.col("j"), F.col("n")).alias("k"))
        return _medians(drawn, numbered.join(F.broadcast(repos.select(F.col("repo").alias("__repo"), "r")), F.col("repo").eqNullSafe(F.col("__repo"))).select("r", "k", "value"))
    slots = picked.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n")))).select("sample", F.col("repo").alias("__repo"), draw(F.col("i"), F.col("j"), F.col("n")).alias("__k"))
    drawn = slots.join(numbered, F.col("__repo").eqNullSafe(F.col("repo")) & (F.col("__k") == F.col("k"))).groupBy("sample", "value").agg(F.count(F.lit(1)).alias("times"))
    return drawn.groupBy("sample").agg(F.percentile("value", 0.5, F.col("times")).alias("value"))


def _medians(drawn: DataFrame, values: DataFrame) -> DataFrame:
    """sample, value: the median of the values (r, k, value) that a sample drew (sample, r, k), nulls left out. A sample's draws lie one
    after another in one partition."""
    known = values.toArrow()
    r, k = (known.column(c).to_numpy() for c in ("r", "k"))
    order = np.lexsort((k, r))
    starts = np.searchsorted(r[order], np.arange((r.max() if len(r) else 0) + 2))
    x, null = known.column("value").to_numpy()[order].astype(np.float64), known.column("value").is_null().to_numpy()[order]
    levels, place = np.unique(x[~null], return_inverse=True)
    rank = np.full(len(x), len(levels), np.int32)
    rank[~null] = place
    sent = drawn.sparkSession.sparkContext.broadcast((starts, rank, levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, rank, levels = sent.value

        def told(sample: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            mine = np.concatenate(parts)
            mine = mine[mine < len(levels)]
            value = None
            if len(mine):
                at = ((len(mine) - 1) // 2, len(mine) // 2)
                low, high = levels[np.partition(mine, at)[list(at)]]
                value = low if low == high else 0.5 * low + 0.5 * high
            return pa.RecordBatch.from_arrays([pa.array([sample], pa.int64()), pa.array([value], pa.float64())], ["sample", "value"])

        now, parts = None, []
        for b in batches:
            sample, r, k = (c.to_numpy() for c in b.columns)
            ranks = rank[starts[r] + k]
            cuts = [0, *(np.flatnonzero(np.diff(sample)) + 1), len(sample)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if parts and sample[lo] != now:
                        yield told(int(now), parts)
                        parts = []
                    now = sample[lo]
                    parts.append(ranks[lo:hi])
        if parts:
            yield told(int(now), parts)

    return drawn.mapInArrow(run, "sample long, value double")


def policy_totals(trials: DataFrame) -> DataFrame:
    return trials.groupBy("policy").agg(
        F.count(F.lit(1)).alias("trials"), F.sum("context_tokens").alias("context_tokens"), F.sum("tool_calls").alias("tool_calls"),
        F.avg("elapsed_seconds").alias("mean_elapsed"), F.avg(F.col("work_completed").cast("double")).alias("completed"), F.avg("task_completion_quality").alias("quality"),
    )


def trial_collapse(trials: DataFrame, gate: Column) -> DataFrame:
    return trials.groupBy("policy", "repo", "task_id").agg(
        F.percentile("context_tokens", 0.5).alias("tokens"), F.percentile("tool_calls", 0.5).alias("calls"), F.percentile("elapsed_seconds", 0.5).alias("elapsed"),
        F.avg("task_completion_quality").alias("quality"), F.bool_and(gate).alias("gate"),
    )


def capacity(workloads: DataFrame, reference: str, elapsed: float, most_seconds: float) -> DataFrame:
    """workloads (repo, chunks, model_chars) with the elapsed time projected from a measured repository."""
    one = workloads.filter(F.col("repo") == reference).select(F.col("chunks").alias("__c"), F.col("model_chars").alias("__m"))
    load = F.greatest(F.col("chunks") / F.col("__c"), F.col("model_chars") / F.col("__m"))
    out = workloads.crossJoin(F.broadcast(one)).withColumn("load_ratio", load).withColumn("projected_seconds", load * elapsed)
    return out.drop("__c", "__m").withColumn("within_limit", F.col("projected_seconds") <= most_seconds)


def rank_metrics(ranks: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """ranks (task_id, rank or null): queries, mrr and hit rates."""
    hit = [F.avg((F.coalesce(F.col("rank") <= k, F.lit(False))).cast("double")).alias(f"hit_{k}") for k in cutoffs]
    return ranks.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), *hit)


def bm25_rank(counts: DataFrame, files: int, in_path: Column) -> DataFrame:
    """counts (path, term, n): path, score by rarer and more frequent terms, twice the weight again if in the path."""
    df = counts.filter("n > 0").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + F.lit(files) / (F.col("df") + 1))
    part = idf * (F.when(F.col("n") > 0, 1 + F.ln("n")).otherwise(0.0) + F.when(in_path, 2.0).otherwise(0.0))
    return counts.join(F.broadcast(df), "term").groupBy("path").agg(F.sum(part).alias("score")).filter("score > 0")


# How path, facts, breadth and precision make up each deliverable's score, and what makes up the final one.
DELIVERABLES = {
    "path_decision": (0.70, 0.20, 0.0, 0.10),
    "source_evidence": (0.40, 0.45, 0.0, 0.15),
    "multi_file_explanation": (0.35, 0.40, 0.15, 0.10),
    "generic": (0.35, 0.35, 0.20, 0.10),
}
FINAL = (0.55, 0.20, 0.15, 0.10)


def context_scores(expected: Column, terms: Column, paths: Column, payload: Column) -> Column:
    """struct(path_coverage, path_precision, evidence_coverage, sufficiency, found) of a retrieved context: expected paths that a
    path holds, distinct paths that hold one, terms in the payload."""
    real = F.array_distinct(F.filter(paths, lambda p: p != ""))
    share = lambda n, of, empty: F.when(F.size(of) > 0, n / F.size(of)).otherwise(empty)
    found = F.size(F.filter(expected, lambda e: F.exists(paths, lambda p: F.contains(p, e))))
    right = F.size(F.filter(real, lambda p: F.exists(expected, lambda e: F.contains(p, e))))
    low = F.lower(payload)
    told = F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t))))
    coverage, evidence = share(found, expected, 1.0), share(told, terms, 1.0)
    precision = F.when(F.size(real) == 0, F.when(F.size(expected) > 0, 0.0).otherwise(1.0)).when(F.size(expected) == 0, 1.0).otherwise(right / F.size(real))
    return F.struct(F.round(coverage, 3).alias("path_coverage"), F.round(precision, 3).alias("path_precision"), F.round(evidence, 3).alias("evidence_coverage"), F.round(0.6 * coverage + 0.4 * evidence, 3).alias("sufficiency"), right.alias("found"))


def completion_quality(deliverable: Column, path: Column, fact: Column, breadth: Column, precision: Column, sufficiency: Column, threshold: float = 0.85) -> Column:
    """How well a context can complete a task: the deliverable's own mix, retrieval, the lesser of path and facts, and
    whether a search would have stopped."""
    mix = lambda w: w[0] * path + w[1] * fact + w[2] * breadth + w[3] * precision
    own = F.coalesce(*[F.when(deliverable == k, mix(w)) for k, w in DELIVERABLES.items()], mix(DELIVERABLES["generic"]))
    stop = F.when(sufficiency >= threshold, 1.0).otherwise(F.least(F.lit(0.8), sufficiency))
    return FINAL[0] * own + FINAL[1] * sufficiency + FINAL[2] * F.least(path, fact) + FINAL[3] * stop


def reduction_ratios(rows: DataFrame, indexed_tokens: Column, source_tokens: Column) -> DataFrame:
    """One row of means over rows (retrieval_tokens, expected_hit, latency): how many times less than the index and the
    sources a retrieval is, each ratio rounded before it is averaged."""
    times = lambda total: F.round(total / F.col("retrieval_tokens"), 1)
    return rows.agg(
        F.round(F.avg("retrieval_tokens"), 1).alias("retrieval_tokens"), F.round(F.avg(times(indexed_tokens)), 1).alias("indexed_reduction"),
        F.round(F.avg(times(source_tokens)), 1).alias("source_reduction"), F.round(F.avg("latency"), 3).alias("latency"),
        F.concat(F.count_if(F.col("expected_hit")).cast("string"), F.lit("/"), F.count("expected_hit").cast("string")).alias("hit_rate"),
    )


def policy_ratios(totals: DataFrame, treatment: str, baseline: str, fields: tuple[str, ...]) -> DataFrame:
    """One row: baseline / treatment of each field of policy_totals."""
    pick = lambda p, f: F.max(F.when(F.col("policy") == p, F.col(f)))
    return totals.agg(*[ratio(pick(baseline, f), pick(treatment, f)).alias(f) for f in fields])


# Parts of a path that say little about an implementation.
LOW_VALUE_PARTS = ("/.git/", "/bench/", "/benchmark/", "/benchmarks/", "/docs/", "/doc/", "/examples/", "/fixtures/")


def probe_rank(path: Column, matched: Column, suffixes: tuple[str, ...]) -> list[Column]:
    """The order of paths found by matched terms: more terms, source files, no side folders, terms in the path, short ones."""
    low = F.concat(F.lit("/"), F.lower(path))
    side = sum((low.contains(p).cast("int") for p in LOW_VALUE_PARTS), F.lit(0)) + (low.contains("generated") | low.contains("snapshot")).cast("int")
    ext = F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1)
    return [F.desc(F.size(matched)), F.desc(ext.isin(*suffixes)), side, F.desc(F.size(F.filter(matched, lambda t: F.contains(low, t)))), F.char_length(path), path]


def word_match(term: Column, word: Column) -> Column:
    """How many letters of two words agree: all and one more if equal, the shorter's if one holds the other, a common start of
    four letters at least, else 0."""
    n = F.least(F.char_length(term), F.char_length(word))
    common = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substr(term, F.lit(1), k) == F.substr(word, F.lit(1), k))), F.lit(0))
    return (
        F.when((F.char_length(term) < 3) | (F.char_length(word) < 3), 0).when(term == word, F.char_length(term) + 1)
        .when(F.contains(word, term) | F.contains(term, word), n).when(common >= 4, common).otherwise(0)
    )


def merged_receipts(receipts: DataFrame, consistent: tuple[str, ...], rows: DataFrame) -> DataFrame:
    """rows (repo, task_id, policy, trial) of receipts (repo, commit, clean and the consistent columns), if they belong
    together: no repository twice, one value of each consistent column, full commits of clean trees, each task and trial once
    for each policy, and pairs complete. One aggregation decides; it raises with what is wrong."""
    r = receipts.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("repo").alias("repos"), F.count_if(~F.coalesce(F.col("commit").rlike("^[0-9a-fA-F]{40}$"), F.lit(False))).alias("commits"),
        F.count_if(~F.coalesce(F.col("clean"), F.lit(False))).alias("dirty"), *[F.count_distinct(c).alias(f"v_{c}") for c in consistent],
    ).first()
    wrong = [f"all receipts must use the same {c}" for c in consistent if r[f"v_{c}"] > 1]
    wrong += ["at least one receipt is required"] * (r["n"] == 0) + ["duplicate repository receipt"] * (r["repos"] < r["n"])
    wrong += ["a full source commit is required"] * (r["commits"] > 0) + ["receipts must come from a clean tree"] * (r["dirty"] > 0)
    policies = rows.select("policy").distinct().count()
    per = rows.groupBy("repo", "task_id", "trial").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("policy").alias("p"))
    bad = per.agg(F.count_if(F.col("n") > F.col("p")).alias("again"), F.count_if(F.col("p") < policies).alias("half")).first()
    wrong += ["duplicate observation"] * ((bad["again"] or 0) > 0) + ["incomplete pair"] * ((bad["half"] or 0) > 0)
    wrong += ["rows of a repository without a receipt"] * (not rows.join(receipts, "repo", "left_anti").isEmpty())
    if wrong:
        raise ValueError("; ".join(wrong))
    return rows
