"""Vector arithmetic on arrays of numbers, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it: what a lambda names from
    outside is worked out again for every element."""
    return F.transform(F.array(value), body)[0]


def l2(a: Column) -> Column:
    """``a`` at unit length; a zero vector stays near zero."""
    return let(a, lambda v: let(norm(v) + 1e-9, lambda size: F.transform(v, lambda x: x.cast("double") / size)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def recentre(a: Column, mean: Column) -> Column:
    """``a`` less the unit mean direction, at unit length."""
    return l2(subtract(a, l2(mean)))


def mean_vector(df: DataFrame, by: list[str], vector: str, out: str = "mean") -> DataFrame:
    """The mean of vectors of one length for each key. Elements are summed apart, so partial sums are
    combined before the shuffle and no group is gathered."""
    parts = df.select(*by, F.posexplode(vector).alias("_at", "_x"))
    means = parts.groupBy(*by, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    rows = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "_m"))).alias("_all"))
    return rows.select(*by, F.transform("_all", lambda s: s["_m"]).alias(out))


def clip(x: Column, low, high) -> Column:
    """``x`` within bounds (a null ``x`` counts as the lower)."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)
