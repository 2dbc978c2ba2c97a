"""Results as compact rows and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def explain(channels: dict[str, str]) -> Column:
    """Which channels put a row where it is: `cosine #1 · symbol #3`, from columns of ranks."""
    return F.concat_ws(" · ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name} #"), F.col(c).cast("string"))) for name, c in channels.items()])


def snippet(text: Column, terms: list[str], lines: int = 24, before: int = 3) -> Column:
    """Some lines of a text, from shortly before the first that has a term; from the top if none has."""
    rows = F.split(text, "\n")
    hit = F.transform(rows, lambda x: T.any_of(F.lower(x).contains(v) for t in terms for v in T.surface_variants(t)))
    at = F.array_position(hit, True)
    return F.array_join(F.slice(rows, F.greatest(at - before, F.lit(1)).cast("int"), lines), "\n")


def trimmed(text: Column, terms: list[str], around: int = 1, most: int = 1200) -> Column:
    """Lines with a term and their neighbours, gaps marked, cut to a number of characters."""
    rows = F.split(text, "\n")
    hit = lambda x: T.any_of(F.lower(x).contains(v) for t in terms for v in T.surface_variants(t))
    near = F.transform(rows, lambda x, i: F.exists(F.slice(rows, F.greatest(i + 1 - around, F.lit(1)), F.lit(2 * around) + F.least(i + 1 - around, F.lit(1))), hit))
    kept = F.transform(rows, lambda x, i: F.when(F.get(near, i), x).when((i == 0) | F.coalesce(F.get(near, i - 1), F.lit(False)), "⋯"))
    return T.truncated(F.array_join(F.array_compact(kept), "\n"), most)


def compact(results: DataFrame, supporting: str | None = None) -> DataFrame:
    """path, lines, score, snippet, and `also`, the line pairs of supporting chunks: no text twice."""
    also = F.transform(supporting, lambda s: F.array(s["start_line"], s["end_line"])) if supporting else F.array().cast("array<array<int>>")
    return results.select("path", F.array("start_line", "end_line").alias("lines"), F.round("score", 4).alias("score"), "snippet", also.alias("also"))


def json_lines(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*results.columns)).alias("value"))
