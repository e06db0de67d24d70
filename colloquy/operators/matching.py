"""Clusters against known persons by inner product: the best few of each exactly, without all pairs.

Persons are sorted into cells, each to the nearest of some of them (a bounded number, chosen by a hash). A cell
has a pivot, the direction of its mean, and the widest angle of a person to it. A person's angle to a cluster
is no less than the pivot's angle to it less that width, which bounds what any person of the cell can score.
So a cluster first meets the cell of the highest bound; only cells whose bound reaches the last of its best
few so far are met after that.

There are ``MAX_CELLS`` cells at most, so their pivots are one row of bounded size. A cell of many persons is
dealt in parts, and clusters meet each part by an equality join, so no task holds a cell that grows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import vectors as V
from colloquy.sources.shared import written

PART, MAX_CELLS = 2048, 1024


def _angle(a: Column, b: Column) -> Column:
    """Between vectors that are not zero."""
    return F.acos(V.clip(V.dot(a, b) / (V.norm(a) * V.norm(b)), -1.0, 1.0))


def _cells(persons: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
    """(person_id, _p, _cell, _part) of persons, and one row: the cells as an array of (cell, parts, pivot, width,
    shortest, longest)."""
    known = persons.select("person_id", F.col("centroid").cast("array<double>").alias("_p")).where(F.size("_p") > 0)
    known = known.withColumn("_n", V.norm(F.col("_p")))
    n = known.count()
    chosen = known.where("_n > 0").orderBy(F.xxhash64("person_id"), "person_id").limit(min(MAX_CELLS, math.ceil(n / part)))
    some = chosen.agg(F.collect_list("_p").alias("_some"))  # MAX_CELLS at most
    nearest = F.array_max(F.transform("_some", lambda s, i: F.struct((V.dot(F.col("_p"), s) / V.norm(s)).alias("d"), i.alias("i"))))["i"]
    placed = written(known.crossJoin(F.broadcast(some)).select("person_id", "_p", "_n", F.coalesce(nearest, F.lit(0)).alias("_cell")), "cells")
    counts = placed.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"), F.min("_n").alias("_low"), F.max("_n").alias("_high"))
    pivots = written(V.mean_vector(placed, ["_cell"], "_p", "_pivot").join(counts, "_cell"), "pivots")
    few = F.broadcast(pivots)  # MAX_CELLS rows at most
    # a zero person or pivot has no angle: then nothing is known of the cell
    angle = F.when((F.col("_n") > 0) & (V.norm(F.col("_pivot")) > 0), _angle(F.col("_p"), F.col("_pivot"))).otherwise(math.pi)
    widths = placed.join(few, "_cell").groupBy("_cell").agg(F.max(angle).alias("_width"))
    gathered = pivots.join(widths, "_cell").agg(F.collect_list(F.struct("_cell", "_parts", "_pivot", "_width", "_low", "_high")).alias("_cells"))
    dealt = placed.join(F.broadcast(pivots.select("_cell", "_parts")), "_cell").withColumn("_part", F.pmod(F.xxhash64("person_id"), F.col("_parts")).cast("int"))
    return dealt.select("person_id", "_p", "_cell", "_part"), gathered


def _bound(vector: Column, size: Column, cell: Column) -> Column:
    """No person of the cell has a greater product with the vector."""
    between = F.when((size > 0) & (V.norm(cell["_pivot"]) > 0), _angle(vector, cell["_pivot"])).otherwise(0.0)
    top = F.cos(F.greatest(between - cell["_width"], F.lit(0.0)))
    return size * top * F.when(top >= 0, cell["_high"]).otherwise(cell["_low"]) + 1e-9


def _met(asked: DataFrame, persons: DataFrame) -> DataFrame:
    """(recording_id, label, person_id, score) of clusters with the cells that they ask for (_cell, _parts)."""
    parts = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return parts.join(persons, ["_cell", "_part"]).select("recording_id", "label", "_k", "person_id", V.dot(F.col("centroid"), F.col("_p")).alias("score"))


def _best(pairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("recording_id", "label").orderBy(F.desc("score"), "person_id")
    return pairs.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= F.col("_k"))


def top_matches(clusters: DataFrame, persons: DataFrame, k: int | Column, part: int = PART) -> DataFrame:
    """(recording_id, label, person_id, score): the ``k`` persons of greatest cosine for each cluster (ties: the
    least person_id first), the same as of all pairs. ``k`` may differ by row of ``clusters``. Persons without
    a centroid are left out."""
    wanted = clusters.select("recording_id", "label", "centroid", (k if isinstance(k, Column) else F.lit(k)).cast("int").alias("_k"))
    known = persons.where(F.size("centroid") > 0)
    if known.count() <= part:  # one cell would hold them all
        asked = wanted.select("*", F.lit(0).alias("_cell"), F.lit(1).alias("_parts"))
        every = known.select("person_id", F.col("centroid").alias("_p"), F.lit(0).alias("_cell"), F.lit(0).alias("_part"))
        return _best(_met(asked, every)).select("recording_id", "label", "person_id", "score")
    dealt, cells = _cells(known, part)
    dealt = written(dealt, "dealt")
    bounds = wanted.crossJoin(F.broadcast(cells)).withColumn("_n", V.norm(F.col("centroid")))  # one row of bounded size
    ranked = F.transform("_cells", lambda c: F.struct(_bound(F.col("centroid"), F.col("_n"), c).alias("b"), c["_cell"].alias("_cell"), c["_parts"].alias("_parts")))
    bounds = bounds.withColumn("_cells", F.reverse(F.array_sort(ranked)))
    bounds = written(bounds.select("recording_id", "label", "centroid", "_k", "_cells"), "bounds")
    first = bounds.where(F.size("_cells") > 0).select("*", F.col("_cells")[0]["_cell"].alias("_cell"), F.col("_cells")[0]["_parts"].alias("_parts"))
    seeds = written(_best(_met(first, dealt)), "seeds")
    floor = seeds.where(F.col("_rank") == F.col("_k")).select("recording_id", "label", F.col("score").alias("_least"))
    rest = bounds.join(floor, ["recording_id", "label"], "left").withColumn("_c", F.explode(F.slice("_cells", F.lit(2), F.greatest(F.size("_cells") - 1, F.lit(0)))))
    rest = rest.where(F.col("_least").isNull() | (F.col("_c.b") >= F.col("_least"))).select("*", "_c._cell", "_c._parts")
    both = seeds.drop("_rank").unionByName(_met(rest, dealt))
    return _best(both).select("recording_id", "label", "person_id", "score")


def all_matches(clusters: DataFrame, persons: DataFrame, part: int = PART) -> DataFrame:
    """(recording_id, label, person_id, score) of every cluster with every person: as many rows as that is. Persons
    are dealt in parts, and each cluster asks for all of them."""
    parts = max(1, math.ceil(persons.count() / part))
    dealt = persons.select("person_id", F.col("centroid").alias("_p"), F.pmod(F.xxhash64("person_id"), F.lit(parts)).cast("int").alias("_part"), F.lit(0).alias("_cell"))
    asked = clusters.select("recording_id", "label", "centroid", F.lit(0).alias("_k"), F.lit(0).alias("_cell"), F.lit(parts).alias("_parts"))
    return _met(asked, dealt).drop("_k")
