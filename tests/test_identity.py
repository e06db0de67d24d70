import itertools
import random

import numpy as np
import pytest

from colloquy.operators import assignment, clustering, identity

from .conftest import rows


def test_optimal_assignment_equals_brute_force():
    draw = np.random.default_rng(1)
    for _ in range(200):
        n, m = draw.integers(1, 6, 2)
        s = draw.random((n, m)).round(2)
        got = assignment.optimal(s)
        assert len(got) == min(n, m) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        small, wide = (s, m) if n <= m else (s.T, n)
        best = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(wide), len(small)))
        assert abs(sum(s[i, j] for i, j in got) - best) < 1e-9


def test_optimal_and_greedy_differ():
    s = np.array([[0.70, 0.60], [0.65, 0.10]])
    assert assignment.optimal(s) == [(0, 1), (1, 0)]
    assert assignment.greedy(s, 0.45) == [(0, 0)]


def speakers(seed, n, dim=32):
    draw = np.random.default_rng(seed)
    c = draw.normal(size=(n, dim))
    return c / np.linalg.norm(c, axis=1, keepdims=True)


def near(center, n, seed):
    x = center + 0.05 * np.random.default_rng(seed).normal(size=(n, len(center)))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


@pytest.fixture(scope="module")
def store(spark):
    who = speakers(42, 3)
    empty = spark.createDataFrame([], "person_id string, name string, role string, centroid array<double>, n_exemplars long")
    none = spark.createDataFrame([], "person_id string, seq long, ts double, embedding array<double>")
    cluster = lambda k: spark.createDataFrame([(i, v) for i, v in enumerate(near(who[k], 8, k))], "seq long, embedding array<double>")
    persons, exemplars = identity.enroll(empty, none, cluster(0), "Alice Martin", "chair")
    return who, *identity.enroll(persons, exemplars, cluster(1), "Alice Martin")


def observed(spark, who):
    data = [("r", k, v) for k in range(3) for v in near(who[k], 6, 7 + k)] + [("r", -1, who[0].tolist())]
    df = spark.createDataFrame(data, "recording_id string, label int, embedding array<double>")
    return identity.centroids(df, ["recording_id"])


def test_centroids_are_units_and_skip_noise(spark, store):
    got = observed(spark, store[0]).collect()
    assert sorted(r.label for r in got) == [0, 1, 2]
    assert all(abs(np.linalg.norm(r.centroid) - 1) < 1e-6 for r in got)


def test_enrolled_are_known_and_strangers_are_not(spark, store):
    who, persons, _ = store
    for method in ("optimal", "greedy"):
        got = {r.label: r for r in identity.identify(observed(spark, who), persons, method=method).collect()}
        assert [got[k].mode for k in range(3)] == ["auto", "auto", "unknown"]
        assert got[0].person_id == "alice-martin" and got[1].person_id == "alice-martin-2" and got[2].name == "S2" and got[2].person_id is None


def test_empty_store(spark, store):
    got = identity.identify(observed(spark, store[0]), store[1].limit(0)).collect()
    assert {(r.mode, r.confidence, r.name) for r in got} == {("unknown", 0.0, f"S{k}") for k in range(3)}
    low, high = identity.calibrate(store[1].limit(0), store[2].limit(0)).first()
    assert (low, high) == (identity.TAU_LOW, identity.TAU_HIGH)


def test_calibration(spark, store):
    who, persons, exemplars = store
    low, high = identity.calibrate(persons, exemplars).first()
    c = {r.person_id: np.array(r.centroid) for r in persons.collect()}
    inner = [float(np.array(r.embedding) @ c[r.person_id]) for r in exemplars.collect()]
    outer = float(np.dot(*c.values()))
    want = min(max(np.percentile(inner, 10), 0.4), 0.9)
    assert abs(high - round(want, 3)) < 1e-9 and abs(low - round(min(max((np.mean(inner) + outer) / 2, 0.3), want - 0.05), 3)) < 1e-9


def test_ring_and_forget(spark, store):
    who, persons, exemplars = store
    new = spark.createDataFrame([("alice-martin", 100 + i, 1.0, v) for i, v in enumerate(near(who[0], 70, 3))], "person_id string, seq long, ts double, embedding array<double>")
    p, e = identity.push(persons, exemplars, new)
    counts = {r.person_id: r.n_exemplars for r in p.collect()}
    assert counts == {"alice-martin": 64, "alice-martin-2": 8}
    assert {r.seq for r in e.where("person_id = 'alice-martin'").collect()} == set(range(100, 164))
    p, e = identity.forget(p, e, ["alice-martin"])
    assert rows(p, "person_id") == [("alice-martin-2",)] and e.count() == 8


def test_enrolling_nobody_is_an_error(spark, store):
    with pytest.raises(ValueError):
        identity.enroll(store[1], store[2], spark.createDataFrame([], "seq long, embedding array<double>"), "X")


def test_recentred_centroids(spark, store):
    who, persons, exemplars = store
    mean = identity.global_mean(exemplars)
    got = {r.person_id: np.array(r.centroid) for r in identity.recentred(persons, mean, "centroid").collect()}
    g = np.mean([r.embedding for r in exemplars.collect()], 0)
    for r in persons.collect():
        v = np.array(r.centroid) - g / (np.linalg.norm(g) + 1e-9)
        assert np.allclose(got[r.person_id], v / np.linalg.norm(v), atol=1e-6)


def average_linkage(d, k):
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: np.mean([[d[i][j] for j in groups[p[1]]] for i in groups[p[0]]]))
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_linkage_equals_brute_force():
    draw = np.random.default_rng(4)
    for _ in range(30):
        x = draw.random((9, 3))
        d = ((x[:, None] - x) ** 2).sum(2)
        for k in (2, 4):
            label = clustering.linkage(d, k)[k]
            assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist())} == average_linkage(d, k)


def test_speakers_are_told_apart(spark):
    who = speakers(9, 4)
    order = [0, 1, 0, 2, 3, 1, 2, 0, 3, 1, 2, 3] * 3
    data = [("r", i, near(who[k], 1, i)[0]) for i, k in enumerate(order)] + [("r", 99, None), ("lone", 0, who[0].tolist())]
    df = spark.createDataFrame(data, "recording_id string, idx long, embedding array<double>")
    got = {(r.recording_id, r.idx): r.label for r in clustering.cluster_recordings(df).collect()}
    assert [got["r", i] for i in range(len(order))] == order
    assert got["r", 99] == -1 and got["lone", 0] == 0


def test_random_ids_are_unique(spark):
    draw = random.Random(3)
    taken = ["ann", "ann-2", "bob-7", "ann-4"]
    names = [draw.choice(["Ann", "Bob", "bob 7", "Cy"]) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(names)), "ord long, name string")
    got = [r.person_id for r in identity.unique_ids(df, spark.createDataFrame([(t,) for t in taken], "person_id string")).collect()]
    assert len(set(got)) == len(got) and not set(got) & set(taken)


def one_by_one(names, taken):
    import re

    taken, out = set(taken), []
    for name in names:
        slug = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "person"
        n = 1
        while (found := slug if n == 1 else f"{slug}-{n}") in taken:
            n += 1
        taken.add(found)
        out.append(found)
    return out


def test_new_ids_clash_with_each_other(spark):
    cases = [(["Bob", "Bob", "Bob 2"], []), (["Bob 2", "Bob", "Bob"], []), (["Bob", "Bob 2", "Bob", "Bob", "Bob 2"], ["bob-3"]), (["Bob 2 2", "Bob", "Bob 2", "Bob", "Bob 2"], []), (["Bob 1", "Bob", "Bob", "Bob 02", "Bob 99999999999999999999"], ["bob"]), (["", "?", "Person 2"], [])]
    draw = random.Random(5)
    pool = ["Bob", "bob 2", "Bob 3", "Bob 2 2", "Bob-2-2-2", "Bob 4", "Bob 3 2", "Cy"]
    cases += [([draw.choice(pool[: draw.randrange(2, 9)]) for _ in range(40)], draw.sample(["bob", "bob-2", "bob-3", "bob-2-2", "bob-9", "cy-3"], draw.randrange(4))) for _ in range(6)]
    for names, taken in cases:
        df = spark.createDataFrame(list(enumerate(names)), "ord long, name string").repartition(3)
        got = identity.unique_ids(df, spark.createDataFrame([(t,) for t in taken], "person_id string")).orderBy("ord").collect()
        assert [r.person_id for r in got] == one_by_one(names, taken), (names, taken)
