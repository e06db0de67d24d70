import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import assignment, clustering, identity, matching

from .conftest import rows


def store(spark, n, dim=16, seed=1, groups=12):
    """Persons around a few common directions, some equal; clusters near persons or near none."""
    draw = np.random.default_rng(seed)
    centre = draw.standard_normal((groups, dim)) * 2 + 1
    p = centre[draw.integers(groups, size=n)] + draw.standard_normal((n, dim)) * 0.6
    p[n // 2 : n // 2 + 5] = p[0]
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    q = np.concatenate([p[draw.integers(n, size=25)] + draw.standard_normal((25, dim)) * 0.1, draw.standard_normal((10, dim))])
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    persons = spark.createDataFrame([(f"p{i:05d}", f"P{i}", "", v.tolist(), 0) for i, v in enumerate(p)] + [("none", "N", "", [], 0)], "person_id string, name string, role string, centroid array<double>, n_exemplars long")
    clusters = spark.createDataFrame([(i // 7, i % 7, v.tolist()) for i, v in enumerate(q)], "recording_id long, label int, centroid array<double>")
    return p, q, persons, clusters


@pytest.mark.parametrize("k,part", [(1, 16), (3, 64), (40, 64), (3, 5000)])
def test_top_matches_equal_all_pairs(spark, k, part):
    p, q, persons, clusters = store(spark, 1500)
    got = rows(matching.top_matches(clusters, persons, k, part), "recording_id", "label", "person_id")
    want = []
    for i, v in enumerate(q):
        score = {f"p{j:05d}": s for j, s in enumerate((p @ v).round(12))}
        want += [(i // 7, i % 7, x) for x in sorted(score, key=lambda x: (-score[x], x))[:k]]
    assert got == sorted(want, key=repr)


def test_cells_leave_most_persons_out(spark):
    """What the bounds are for: clusters near persons meet a small share of all pairs."""
    p, q, persons, clusters = store(spark, 3000, dim=6)
    dealt, cells = matching._cells(persons, 32)
    own = {}
    for r in dealt.collect():
        own.setdefault(r["_cell"], []).append(r["_p"])
    bounds = {(r.recording_id, r.label, r["_cell"]): r.b for r in clusters.crossJoin(cells).select("recording_id", "label", "centroid", F.explode("_cells").alias("c")).select("recording_id", "label", "c._cell", matching._bound(F.col("centroid"), F.lit(1.0), F.col("c")).alias("b")).collect()}
    assert len(own) > 20 and len(bounds) == 35 * len(own)
    for i, v in enumerate(q):
        for c, x in own.items():
            assert (np.array(x) @ v).max() <= bounds[i // 7, i % 7, c] + 1e-12
    met = sum(len(x) for i, v in enumerate(q[:25]) for c, x in own.items() if bounds[i // 7, i % 7, c] >= np.sort(p @ v)[-3])
    assert met < 0.25 * 25 * 3000


@pytest.mark.parametrize("method", ["optimal", "greedy"])
def test_identify_on_best_few_equals_whole_matrix(spark, method):
    p, q, persons, clusters = store(spark, 300, seed=5)
    pairs = matching.all_matches(clusters, persons.where("size(centroid) > 0"), 32)
    assert pairs.count() == 35 * 300
    whole = assignment.assign(pairs, "recording_id", "label", "person_id", "score", method, 0.3)
    got = identity.identify(clusters, persons, 0.6, 0.3, method).where("confidence > 0")
    score = lambda df, c: {r[0]: round(r[1], 2) for r in df.groupBy("recording_id").agg(F.sum(c)).collect()}
    assert score(whole, "score") == pytest.approx(score(got, "confidence"), abs=0.02)
    if method == "greedy":
        assert rows(whole, "recording_id", "label", "person_id") == rows(got, "recording_id", "label", "person_id")


def test_identify_around_the_global_mean(spark):
    p, q, persons, clusters = store(spark, 200, seed=7)
    mean = identity.global_mean(persons.where("size(centroid) > 0").select(F.col("centroid").alias("embedding")))
    got = {(r.recording_id, r.label): r for r in identity.identify(clusters, persons, 0.9, 0.5, mean=mean).collect()}
    g = p.mean(0) / (np.linalg.norm(p.mean(0)) + 1e-9)
    a, b = q - g, p - g
    s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    for rec in range(5):
        best = assignment.optimal(s[rec * 7 : rec * 7 + 7])
        for i, j in best:
            assert abs(got[rec, i].confidence - s[rec * 7 + i, j]) < 6e-4 or abs(sum(s[rec * 7 + x, y] for x, y in best) - sum(got[rec, x].confidence for x in range(7))) < 7e-3


def test_pairs_twice_or_missing(spark):
    data = [(1, 0, "a", 0.5), (1, 0, "a", 0.9), (1, 1, "a", 0.8), (1, 1, "b", 0.1), (2, 0, "a", 0.2), (2, 1, "a", 0.3)]
    df = spark.createDataFrame(data, "g long, l int, r string, s double")
    assert rows(assignment.assign(df, "g", "l", "r", "s")) == [(1, 0, "a", 0.9), (1, 1, "b", 0.1), (2, 1, "a", 0.3)]
    assert rows(assignment.assign(df, "g", "l", "r", "s", "greedy", 0.25)) == [(1, 0, "a", 0.9), (2, 1, "a", 0.3)]


def slow_linkage(d, stop):
    """The definition: every step looks at the whole matrix."""
    n = len(d)
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    size, label, alive, out = np.ones(n), np.arange(n), np.ones(n, bool), {n: np.arange(n)}
    for k in range(n - 1, stop - 1, -1):
        i, j = divmod(int(np.argmin(np.where(alive[:, None] & alive, d, np.inf))), n)
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        size[i] += size[j]
        alive[j] = False
        label = np.where(label == j, i, label)
        out[k] = label
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 60, 300])
def test_linkage_equals_scans_of_the_matrix(n):
    for seed in range(3):
        x = np.random.default_rng(seed).standard_normal((n, 5))
        if seed == 2:
            x = x.round()  # ties and equal rows
        x = clustering.unit_rows(x)
        d = 1 - x @ x.T
        d = (d + d.T) / 2
        fast, slow = clustering.linkage(d, 1), slow_linkage(d, 1)
        assert all((fast[k] == slow[k]).all() for k in range(1, n + 1))


def test_many_segments_in_bounded_time():
    import time

    draw = np.random.default_rng(0)
    who = draw.standard_normal((5, 20))
    x = who[np.arange(5000) % 5] + draw.standard_normal((5000, 20)) * 0.4
    start = time.process_time()
    label = clustering.cluster(x)
    assert (label == np.arange(5000) % 5).mean() > 0.99 and time.process_time() - start < 120


def pairwise_silhouette(x, label):
    d = 1 - x @ x.T
    np.fill_diagonal(d, 0)
    out = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        others = [d[i, label == c].mean() for c in set(label.tolist()) - {label[i]}]
        if not own.any() or not others:
            out.append(0.0)
            continue
        a, b = d[i, own].mean(), min(others)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def test_silhouette_from_sums_equals_pairs(spark):
    draw, data, want = np.random.default_rng(3), [], {}
    for r, k in ((0, 3), (1, 1), (2, 6)):
        x = clustering.unit_rows(draw.standard_normal((40, 8)))
        label = draw.integers(k, size=40)
        label[7] = 50  # alone
        x[9], label[9] = x[8], label[8]
        want[r] = pairwise_silhouette(x, label)
        assert abs(clustering.silhouette(x, label) - want[r]) < 1e-8
        data += [(r, i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))] + [(r, 99, x[0].tolist(), -1)]
    found = clustering.silhouettes(spark.createDataFrame(data, "recording_id long, idx long, embedding array<double>, label int"))
    got = {x.recording_id: (x.silhouette, x.n) for x in found.collect()}
    assert all(abs(got[r][0] - want[r]) < 1e-8 and got[r][1] == 40 for r in want)


def test_clusters_in_order(spark):
    data = [("r", 0, 10), ("r", 1, 2), ("r", 2, 10), ("r", 3, -1), ("q", 5, 0)]
    found = clustering.cluster_order(spark.createDataFrame(data, "recording_id string, idx long, label int"))
    assert [tuple(x) for x in found.collect()] == [("q", 0, 5, 1, 1), ("r", 2, 1, 1, 1), ("r", 10, 0, 2, 2)]
