"""Vectors as arrays of floats, computed in doubles inside code that Spark runs itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPSILON)


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def has_dimension(v: Column, dimension: int) -> Column:
    return F.size(v) == dimension


def gate_threshold(sigma: Column, rows: Column, static: float = 0.015, floor: float = 0.005, k: float = 1.0) -> Column:
    """How far the best must lead: k standard deviations, a floor at least; a fixed lead below three rows."""
    return F.when(rows >= 3, F.greatest(F.lit(floor), sigma * k)).otherwise(F.lit(static))


def hashed_embedding(tokens: Column, dimension: int = 64) -> Column:
    """A deterministic stand-in for a model: signed hashed counts of tokens, scaled to length 1."""
    slots = F.transform(tokens, lambda t: F.xxhash64(t))
    sign = lambda h: F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0)
    at = lambda hs, i: F.aggregate(F.filter(hs, lambda h: F.pmod(h, F.lit(dimension)) == i), F.lit(0.0), lambda s, h: s + sign(h))
    # Bound by lambdas, so that tokens are hashed once and not for each place and for the length.
    sums = F.transform(F.array(slots), lambda hs: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: at(hs, i)))
    unit = lambda x: F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-12))
    whole = F.transform(sums, lambda x: F.struct(x.alias("x"), unit(x).alias("n")))
    return F.get(F.transform(whole, lambda w: F.transform(w["x"], lambda y: (y / w["n"]).cast("float"))), F.lit(0))
