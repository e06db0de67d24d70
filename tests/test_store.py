import threading

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import identity, store
from colloquy.sources.commits import Commits, Conflict

from .conftest import rows

NEW = "ord long, name string, role string, seq long, embedding array<double>"


def voices(spark, names, seed=0, each=3, first=0):
    draw = np.random.default_rng(seed)
    data = [(first + i, n, "", s, (draw.standard_normal(8) + 3 * np.eye(8)[i % 8]).tolist()) for i, n in enumerate(names) for s in range(each)]
    return spark.createDataFrame(data, NEW)


def test_an_empty_store(spark, tmp_path):
    s = store.VoiceStore(spark, str(tmp_path / "s"))
    assert s.version() == 0
    for df, schema in ((s.people(), store.PERSONS), (s.exemplars_of("x"), store.EXEMPLARS), (s.global_mean(), store.MEAN), (s.person("x"), store.PERSONS)):
        assert df.count() == 0 and df.schema == spark.createDataFrame([], schema).schema
    clusters = spark.createDataFrame([(1, 0, [1.0, 0.0])], "recording_id long, label int, centroid array<double>")
    assert rows(s.identify(clusters)) == [(1, 0, None, "S0", 0.0, "unknown")]


def test_enroll_look_up_and_forget(spark, tmp_path):
    s = store.VoiceStore(spark, str(tmp_path / "s"))
    new = voices(spark, ["Zoé", "Bob", "Bob", "Bob 2", "ann"])
    assert s.enroll(new.unionByName(spark.createDataFrame([(0, "Zoé", "", 9, None)], NEW)), ts=5.0) == 1
    assert [(r.person_id, r.name, r.n_exemplars) for r in s.people().collect()] == [("bob", "Bob", 3), ("bob-2", "Bob", 3), ("bob-2-2", "Bob 2", 3), ("zo", "Zoé", 3), ("ann", "ann", 3)]
    held = s.exemplars_of("bob-2").collect()
    assert [(r.seq, r.ts) for r in held] == [(0, 5.0), (1, 5.0), (2, 5.0)] and all(abs(np.linalg.norm(r.embedding) - 1) < 1e-6 for r in held)
    c = np.mean([r.embedding for r in held], 0)
    assert np.allclose(s.person("bob-2").first().centroid, c / np.linalg.norm(c), atol=1e-6)
    mean = np.mean([r.embedding for r in s.exemplars().collect()], 0)
    assert np.allclose(s.global_mean().first().global_mean, mean)
    s.reinforce(spark.createDataFrame([("ann", 3, 9.0, [1.0] * 8), ("nobody", 0, 9.0, [1.0] * 8)], store.EXEMPLARS), cap=2)
    assert [r.seq for r in s.exemplars_of("ann").collect()] == [3, 0] and s.person("nobody").count() == 0
    assert s.forget(["bob", "zo"]) == 3
    assert rows(s.people(), "person_id") == [("ann",), ("bob-2",), ("bob-2-2",)] and s.exemplars_of("bob").count() == 0
    assert s.persons(1).count() == 5  # older versions are as they were
    with pytest.raises(ValueError, match="'Eve'"):
        s.enroll(spark.createDataFrame([(0, "Eve", "", 0, None), (1, "Al", "", 0, [1.0])], NEW))
    assert s.version() == 3


def test_identify_around_the_stored_mean(spark, tmp_path):
    s = store.VoiceStore(spark, str(tmp_path / "s"))
    s.enroll(voices(spark, [f"P{i}" for i in range(6)], each=4))
    clusters = s.persons().select(F.lit(1).cast("long").alias("recording_id"), F.row_number().over(Window.orderBy("person_id")).alias("label"), "centroid")
    for use in (True, False):
        found = s.identify(clusters, use)
        assert found.where("mode = 'auto' and person_id = concat('p', label - 1)").count() == 6
    direct = identity.identify(clusters, s.persons(), mean=s.global_mean())
    assert rows(direct) == rows(s.identify(clusters)) and rows(direct) != rows(s.identify(clusters.withColumn("centroid", F.reverse("centroid"))))


def test_of_two_writers_both_changes_last(spark, tmp_path):
    path = str(tmp_path / "s")
    first = store.VoiceStore(spark, path)
    first.enroll(voices(spark, ["Bob"]))
    barrier, errors = threading.Barrier(2), []

    def write(seed):
        s, once = store.VoiceStore(spark, path), []

        def derive(persons, exemplars):
            if not once:  # both have read the same version
                once.append(1)
                barrier.wait()
            return store.enroll_all(persons, exemplars, voices(spark, ["Bob", "Cy"], seed), 1.0)

        try:
            s.change(derive)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and first.version() == 3
    assert rows(first.people(), "person_id", "n_exemplars") == [("bob", 3), ("bob-2", 3), ("bob-3", 3), ("cy", 3), ("cy-2", 3)]


def test_a_version_is_committed_once(spark, tmp_path):
    c = Commits(spark, str(tmp_path / "c"))
    assert c.latest() == 0 and c.commit(0, "a") == 1
    with pytest.raises(Conflict):
        c.commit(0, "b")
    assert c.content(1) == "a" and c.commit(1, "b") == 2 and c.latest() == 2
