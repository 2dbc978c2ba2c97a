r"""Quality rules as a learned decision list, with DataFrame functions only.

`measure` computes a document's statistics inside its row. `learn` grows a list of rules by sequential covering: each
rule is a conjunction of thresholds, grown one condition at a time by FOIL gain over histograms of labelled rows
(one aggregation a step, of which only features x bins rows reach the driver), then pruned from its end on rows held
back for that, and kept if it is precise there; the rows it covers are left out of the next rule's histograms. The
list becomes one ordered CASE expression. Learning reads all labelled rows of its folds; nothing is sampled.

Edge cases: null or empty texts have no words, and all ratios of them are 0; repeated rows each get a row; repeated
labels each count; null labels, and labels without a document, don't; without labels of both kinds the list is empty and keeps
every document; an empty table gives an empty result; extra columns are ignored. Five-word windows are compared by 64 bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, id_mod, materialise

SYMBOLS, SPACES, WINDOW = "#*$%&|<>", " \t\n\x0b\x0c\r", 5
BINS, MOST_RULES, MOST_CONDITIONS = 24, 8, 3
#: Steps in which values are counted for quantiles, and how much finer they are near 0 than at a feature's maximum.
GRID, FINE = 4096, 1000.0
#: A rule is kept if so large a share of what it covers among the rows held back has label 0. A condition covers so many rows of label 0
#: where it grows, and one among the rows held back, so that few labels suffice.
LEAST_PRECISION, LEAST_COVERED = 0.8, 3

FEATURES = ("n_words", "symbol_share", "repeat_share", "dup_line_share", "distinct_share", "word_length", "upper_share", "digit_share", "punct_share")


def _removed(text: Column, characters: str) -> Column:
    """How many of some characters a text has."""
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the FEATURES: map-only."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    cut = f"CASE WHEN size(w) > {WINDOW} THEN transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({', '.join(f'get(w, i + {k})' for k in range(WINDOW))})) ELSE array() END"
    df = df.withColumn("windows", F.expr(cut))
    ordered = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("ordered", ordered)
    again = F.expr("filter(ordered, (x, k) -> coalesce(get(ordered, k - 1).h = x.h, false) OR coalesce(get(ordered, k + 1).h = x.h, false))")
    spread = F.flatten(F.transform(again, lambda x: F.sequence(x["i"], x["i"] + WINDOW - 1)))
    df = df.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _removed(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(F.array_distinct(spread)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        _removed(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _removed(F.col("text"), "0123456789").alias("n_digits"),
        _removed(F.col("text"), ".,;:!?").alias("n_punct"),
    )
    c, n = F.col("word_chars"), F.col("n_words")
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.greatest("n_repeat_words", F.lit(0)).alias("n_repeat_words"),
        _share(F.col("n_symbols"), c).alias("symbol_share"),
        _share(F.greatest("n_repeat_words", F.lit(0)), n).alias("repeat_share"),
        _share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        _share(F.col("n_distinct"), n).alias("distinct_share"),
        _share(c, n).alias("word_length"),
        _share(F.col("n_upper"), c).alias("upper_share"),
        _share(F.col("n_digits"), c).alias("digit_share"),
        _share(F.col("n_punct"), c).alias("punct_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def matches(rule: Rule) -> Column:
    found = F.lit(True)
    for c in rule:
        found = found & c.column()
    return found


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered CASE: the first rule that matches rejects, the end keeps."""
    out = None
    for r in rules:
        out = F.when(matches(r), False) if out is None else out.when(matches(r), False)
    return F.lit(True) if out is None else out.otherwise(True)


def cut_points(labelled: DataFrame, bins: int = BINS) -> dict[str, list[float]]:
    """Candidate thresholds of each feature: quantiles of the rows of each label, from exact counts over GRID steps that are
    finer near 0. Counts don't depend on the order of rows, so reruns find the same."""
    most = labelled.agg(*[F.max(F.col(f).cast("double")).alias(f) for f in FEATURES]).first().asDict()
    span = math.log1p(FINE)
    step = lambda f: F.floor(F.log1p(F.col(f).cast("double") * (FINE / (most[f] or 1.0))) * (GRID / span)).cast("int")
    every = labelled.select("label", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), step(f).alias("b")) for f in FEATURES])).alias("x"))
    counts: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in every.groupBy("label", "x.f", "x.b").agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect():
        counts.setdefault((r["f"], r["label"]), []).append((r["b"], r["n"]))
    cuts: dict[str, set[float]] = {f: set() for f in FEATURES}
    for (f, _), found in counts.items():
        total, upto, wanted = sum(n for _, n in found), 0, 1
        for b, n in found:
            upto += n
            while wanted < bins and upto * bins >= wanted * total:
                cuts[f].add(math.expm1((b + 1) / GRID * span) * (most[f] or 1.0) / FINE)
                wanted += 1
    return {f: sorted(c) for f, c in cuts.items()}


def learn(labelled: DataFrame, hold: Column, bins: int = BINS, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS) -> list[Rule]:
    """Rules that find label 0 among labelled (FEATURES, label). hold: which rows prune rules instead of growing them."""
    cuts = cut_points(labelled, bins)
    bin_of = [F.struct(F.lit(k).alias("f"), sum([(F.col(f).cast("double") > c).cast("int") for c in cuts[f]], F.lit(0)).alias("b")) for k, f in enumerate(FEATURES)]
    rows = materialise(labelled.select("label", *FEATURES, hold.alias("hold"), F.array(*bin_of).alias("bins")), "labelled")
    rules: list[Rule] = []
    for _ in range(most_rules):
        left = rows.filter(verdict(rules))
        rule = _grown(left.filter(~F.col("hold")), cuts, most_conditions)
        rule = rule and _pruned(left.filter("hold"), rule)
        if not rule:
            break
        rules.append(_centred(left, rule))
    return rules


def _centred(rows: DataFrame, rule: Rule) -> Rule:
    """The same rule with each threshold in the middle of the gap between the rows on its two sides."""
    out: Rule = ()
    for c in rule:
        value = F.col(c.feature).cast("double")
        inside, outside = F.when(c.column(), value), F.when(~c.column(), value)
        ends = (F.max(outside), F.min(inside)) if c.above else (F.max(inside), F.min(outside))
        lo, hi = rows.filter(matches(out)).agg(*ends).first()
        out = (*out, c if lo is None or hi is None else Condition(c.feature, c.above, (lo + hi) / 2))
    return out


def _grown(rows: DataFrame, cuts: dict[str, list[float]], most_conditions: int) -> Rule:
    rule: Rule = ()
    for _ in range(most_conditions):
        inside = rows.filter(matches(rule))
        bad_good = inside.select(F.explode("bins").alias("x"), (F.col("label") == 0).cast("long").alias("bad"))
        stats = bad_good.groupBy("x.f", "x.b").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
        counts = {(r["f"], r["b"]): (r["bad"], r["good"]) for r in stats}
        bad = sum(n for (f, _), (n, _) in counts.items() if f == 0)
        good = sum(n for (f, _), (_, n) in counts.items() if f == 0)
        if bad < LEAST_COVERED or not good:
            break
        best, gain = None, 0.0
        for k, f in enumerate(FEATURES):
            low_bad = low_good = 0
            for b, cut in enumerate(cuts[f]):
                n, m = counts.get((k, b), (0, 0))
                low_bad, low_good = low_bad + n, low_good + m
                for above, p, q in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                    if p >= LEAST_COVERED and (worth := p * (math.log2((p + 0.5) / (p + q + 1)) - math.log2((bad + 0.5) / (bad + good + 1)))) > gain + 1e-9:
                        best, gain = Condition(f, above, cut), worth
        if best is None:
            break
        rule = (*rule, best)
    return rule


def _pruned(rows: DataFrame, rule: Rule) -> Rule:
    """The shortest start of a rule that is as precise as the best on rows held back, or no rule."""
    counts = [F.sum((matches(rule[:k]) & (F.col("label") == v)).cast("long")) for k in range(1, len(rule) + 1) for v in (0, 1)]
    got = [x or 0 for x in rows.agg(*counts).first()]
    worth = [(got[2 * k] - got[2 * k + 1]) / max(1, got[2 * k] + got[2 * k + 1]) for k in range(len(rule))]
    k = worth.index(max(worth))
    bad, good = got[2 * k], got[2 * k + 1]
    return rule[: k + 1] if bad and bad >= LEAST_PRECISION * (bad + good) else ()


def learn_from(measured: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learns from labels (doc_id, quality), rules held to rows whose crc32(doc_id) mod 4 is 1; those of 2 stay unseen. Rows that fail the
    base rules are left out, as the list never decides for them."""
    labelled = measured.filter(~base_failed()).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").filter(F.col("label").isin(0, 1))
    fold = id_mod("doc_id", 4)
    return learn(labelled.withColumn("fold", fold).filter("fold <> 2"), F.col("fold") == 1)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """measure's columns, base_failed and kept: a row for each document."""
    measured = materialise(measure(docs), "measured")
    rules = learn_from(measured, labels)
    failed = base_failed()
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
