"""Exact order statistics of groups of any size, without sorting or gathering them.

A wanted rank is in a range of values. The range is cut into bins, whose rows are counted (partial counts meet in
the shuffle), and the bin that holds the rank, from its least value to its greatest, is the next range; the rows
below it are known by number. Each round cuts a range by up to ``BINS``, and a bin of one value ends the search,
so repeated values cost nothing. What is left in the end is at most ``FEW`` rows for each rank, which are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources.shared import written

BINS, FEW = 4096, 4096


def order_statistics(rows: DataFrame, by: list[str], value: str, wanted: DataFrame, bins: int = BINS, few: int = FEW) -> DataFrame:
    """``wanted`` (by, rank) with ``value``, the number of that rank (from 0) among the group's values; ranks
    outside a group are left out, and so are nulls and what is not a number. ``rows`` are read once for each
    round (two or three for most data), so they had better be a table."""
    own = rows.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    spans = own.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_in"))
    key = [*by, "_lo", "_hi"]
    asked = wanted.select(*by, F.col("rank").cast("long").alias("rank")).distinct().join(spans, by).where("rank between 0 and _in - 1")
    asked = written(asked.withColumn("_below", F.lit(0).cast("long")), "ranks")
    while True:
        wide = asked.where((F.col("_lo") < F.col("_hi")) & (F.col("_in") > few))
        if not wide.limit(1).count():
            break
        width = F.col("_hi") / bins - F.col("_lo") / bins
        at = F.least(F.floor(F.when(width > 0, (F.col("_v") - F.col("_lo")) / width).otherwise(0.0)), F.lit(bins - 1))
        halves = F.when(width > 0, at).otherwise((F.col("_v") > F.col("_lo")).cast("long"))  # values too near each other to be divided
        inside = own.join(wide.select(*key).distinct(), by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counts = inside.groupBy(*key, halves.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        w = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        found = wide.join(counts, key).where((F.col("rank") >= F.col("_below") + F.col("_before")) & (F.col("rank") < F.col("_below") + F.col("_before") + F.col("_n")))
        narrowed = found.select(*by, "rank", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), F.col("_n").alias("_in"), (F.col("_below") + F.col("_before")).alias("_below"))
        asked = written(asked.where(~((F.col("_lo") < F.col("_hi")) & (F.col("_in") > few))).unionByName(narrowed), "ranks")
    single = asked.where("_lo = _hi").select(*by, "rank", F.col("_lo").alias("value"))
    left = asked.where("_lo < _hi")
    inside = own.join(left.select(*key, "_below").distinct(), by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    numbered = inside.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("_v")) - 1 + F.col("_below"))
    return single.unionByName(left.select(*by, "rank").join(numbered.select(*by, F.col("rank").cast("long").alias("rank"), F.col("_v").alias("value")), [*by, "rank"]))


def quantile(rows: DataFrame, by: list[str], value: str, share: float, **options) -> DataFrame:
    """(by, quantile): between the two nearest ranks, in proportion, as SQL's continuous percentile."""
    usable = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    place = (F.count(F.lit(1)) - 1) * F.lit(float(share))
    places = written(usable.groupBy(*by).agg(place.alias("_p")), "places")
    wanted = places.select(*by, F.explode(F.array_distinct(F.array(F.floor("_p"), F.ceil("_p")))).alias("rank"))
    found = order_statistics(usable, by, value, wanted, **options).groupBy(*by).agg(F.min_by("value", "rank").alias("_a"), F.max_by("value", "rank").alias("_b"))
    part = F.col("_p") - F.floor("_p")
    return found.join(places, by).select(*by, (F.col("_a") * (1 - part) + F.col("_b") * part).alias("quantile"))
