"""Clustering of a recording's embeddings: average linkage on cosine distance, speaker count by silhouette.

A recording is clustered in one task, which holds the distance matrix of its segments; recordings are
spread. A merge looks at one row of the matrix and at rows whose nearest neighbour it has changed, so all
merges of n segments take about n * n steps. Silhouettes come from cluster sums, without pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import vectors as V

MIN_SPEAKERS, MAX_SPEAKERS = 2, 8


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def merges(distance: np.ndarray, stop: int = 1) -> list[tuple[int, int]]:
    """Pairs (i, j) of rows, i < j, that average linkage merges one after another until ``stop`` clusters are
    left: each time the first pair of least average distance; the merged cluster goes by i."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, nearest, least = np.ones(n), np.zeros(n, np.int64), np.full(n, np.inf)

    def look(r):
        """The nearest of the rows behind r."""
        if r + 1 < n:
            nearest[r] = r + 1 + int(np.argmin(d[r, r + 1 :]))
            least[r] = d[r, nearest[r]]

    for r in range(n):
        look(r)
    out = []
    for _ in range(n - stop):
        i = int(np.argmin(least))
        j = int(nearest[i])
        out.append((i, j))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        size[i] += size[j]
        d[i], d[:, i], d[j], d[:, j], least[j] = merged, merged, np.inf, np.inf, np.inf
        alive = least[:j] < np.inf
        lost = np.flatnonzero(alive & ((nearest[:j] == j) | (nearest[:j] == i)))
        closer = (merged[:i] < least[:i]) | ((merged[:i] == least[:i]) & (i < nearest[:i]))
        closer &= alive[:i]
        nearest[:i][closer], least[:i][closer] = i, merged[:i][closer]
        for r in {i, *lost.tolist()}:
            look(r)
    return out


def linkage(distance: np.ndarray, stop: int, most: int | None = None) -> dict[int, np.ndarray]:
    """Labels for every number of clusters from ``most`` (the rows' number) down to ``stop``."""
    n = len(distance)
    label, out = np.arange(n), {}
    most = n if most is None else min(most, n)
    steps = merges(distance, min(stop, n))
    for k in range(n, min(stop, n) - 1, -1):
        if k < n:
            i, j = steps[n - k - 1]
            label[label == j] = i
        if k <= most:
            out[k] = label.copy()
    return out


def silhouette(unit: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette of rows of unit length by cosine distance; a row alone in its cluster scores 0."""
    names, where = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return 0.0
    member = np.eye(len(names))[where]
    count = member.sum(0)
    near = unit @ (member.T @ unit).T  # cosines with all rows of each cluster, summed
    at = np.arange(len(label)), where
    own = count[where]
    within = (own - 1 - near[at] + (unit * unit).sum(1)) / np.maximum(own - 1, 1)
    other = 1 - near / count
    other[at] = np.inf
    between = other.min(1)
    worst = np.maximum(within, between)
    score = np.where((own > 1) & (worst > 0), (between - within) / np.where(worst > 0, worst, 1), 0.0)
    return float(score.mean())


def silhouettes(rows: DataFrame, by: str = "recording_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(by, silhouette, n) of labelled rows, as ``silhouette``; rows of labels below 0 are left out.

    The sum of a row's cosines with a cluster is its product with the cluster's sum, so each row meets the
    clusters of its recording, not the rows. A recording has few clusters, which are gathered."""
    usable = rows.where((F.col(label) >= 0) & (F.size(vector) > 0)).select(by, F.col(label).alias("_l"), V.l2(F.col(vector)).alias("_x"))
    counts = usable.groupBy(by, "_l").agg(F.count(F.lit(1)).alias("_n"))
    sums = V.mean_vector(usable, [by, "_l"], "_x", "_mean").join(counts, [by, "_l"])
    clusters = sums.groupBy(by).agg(F.collect_list(F.struct("_l", "_n", "_mean")).alias("_c"))
    near = F.transform("_c", lambda c: F.struct(c["_l"].alias("l"), c["_n"].alias("n"), V.dot(F.col("_x"), c["_mean"]).alias("m")))
    met = usable.join(clusters, by).withColumn("_m", near)
    own = F.filter("_m", lambda c: c["l"] == F.col("_l"))[0]
    within = (own["n"] - 1 - own["m"] * own["n"] + V.dot(F.col("_x"), F.col("_x"))) / F.greatest(own["n"] - 1, F.lit(1))
    between = F.array_min(F.transform(F.filter("_m", lambda c: c["l"] != F.col("_l")), lambda c: 1 - c["m"]))
    scored = met.select(by, own["n"].alias("_n"), within.alias("_in"), between.alias("_out"))
    worst = F.greatest("_in", "_out")
    score = F.when((F.col("_n") > 1) & F.col("_out").isNotNull() & (worst > 0), (F.col("_out") - F.col("_in")) / worst).otherwise(0.0)
    return scored.groupBy(by).agg(F.avg(score).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def centred(rows: DataFrame, by: str = "recording_id", vector: str = "embedding") -> DataFrame:
    """Vectors at unit length, less their recording's mean, at unit length again: the space of clustering."""
    unit = rows.withColumn(vector, V.l2(F.col(vector)))
    means = V.mean_vector(unit, [by], vector, "_mean")
    return unit.join(means, by).withColumn(vector, V.l2(V.subtract(F.col(vector), F.col("_mean")))).drop("_mean")


def cluster_order(labels: DataFrame, by: str = "recording_id", order: str = "idx", label: str = "label") -> DataFrame:
    """(by, label, first, n, place): the clusters of each recording as an ordered listing, by number; ``first`` is
    the row that a cluster begins with. Rows of labels below 0 are in none."""
    found = labels.where(F.col(label) >= 0).groupBy(by, label).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(label))).orderBy(by, label)


def first_seen(label: np.ndarray) -> np.ndarray:
    order: dict[int, int] = {}
    return np.array([order.setdefault(int(x), len(order)) for x in label], np.int64)


def cluster(x: np.ndarray, speakers: int | None = None, low: int = MIN_SPEAKERS, high: int = MAX_SPEAKERS) -> np.ndarray:
    """Labels 0, 1, 2.. by first appearance; ``speakers`` of None or 0 is estimated."""
    if len(x) < 2:
        return np.zeros(len(x), np.int64)
    own = unit_rows(unit_rows(x) - unit_rows(x).mean(0))
    distance = 1 - own @ own.T
    if speakers:
        k = min(speakers, len(x))
        return first_seen(linkage(distance, k, k)[k])
    counts = [k for k in range(low, min(high, len(x) - 1) + 1)]
    if not counts:
        k = min(low, len(x))
        return first_seen(linkage(distance, k, k)[k])
    steps = linkage(distance, low, counts[-1])
    scores = [silhouette(own, steps[k]) for k in counts]
    return first_seen(steps[counts[int(np.argmax(scores))]])


def cluster_recordings(rows: DataFrame, by: str = "recording_id", order: str = "idx", vector: str = "embedding", speakers: int | None = None) -> DataFrame:
    """(by, order, label); rows whose vector is null or zero are unusable and get -1."""

    def solve(table):
        import pyarrow as pa

        table = table.sort_by(order)
        vectors = table.column(vector).to_pylist()
        ok = np.array([v is not None and any(v) for v in vectors], bool)
        label = np.full(len(vectors), -1, np.int64)
        if ok.any():
            label[ok] = cluster(np.array([v for v, good in zip(vectors, ok) if good], float), speakers)
        return pa.table({by: table.column(by), order: table.column(order), "label": pa.array(label, pa.int32())})

    kinds = dict(rows.dtypes)
    return rows.select(by, order, vector).groupBy(by).applyInArrow(solve, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, label int")
