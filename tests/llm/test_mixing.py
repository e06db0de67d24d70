import math

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.llm import mixing as m
from colloquy.llm.queries import ORACLE_SQL, op9_mixing

from .conftest import make, prose


def water(sizes, weights, budget=1.5, epochs=2):
    """Targets by resharing what is over, again and again."""
    goal, target = budget * sum(sizes), [0.0] * len(sizes)
    full = set()
    while True:
        left = goal - sum(epochs * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        total = sum(weights[i] for i in open_)
        target = [epochs * s for s in sizes]
        for i in open_:
            target[i] = left * weights[i] / total
        over = {i for i in open_ if target[i] > epochs * sizes[i]}
        if not over:
            return target
        full |= over


def test_targets_equal_resharing(spark):
    sizes = [5, 1000, 37, 0, 400, 400, 90, 12345]
    df = spark.createDataFrame([(f"0{i}", s) for i, s in enumerate(sizes)], "key string, size long")
    got = [r.target for r in m.targets(df).orderBy("key").collect()]
    want = water(sizes, [m.WEIGHTS[i % 3] for i in range(len(sizes))])
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want))


def test_quotas_equal_highest_quotients(spark):
    goals = {"0a": 700.0, "0b": 310.0, "0c": 95.0, "0d": 4000.0, "0e": 95.0}
    got = {(r.shard, r.key): r.quota for r in m.apportion(spark.createDataFrame(list(goals.items()), "key string, target double"), block=10, shard_blocks=16).collect()}
    seats = round(sum(goals.values()) / 10)
    order = sorted(((2 * k - 1) / (2 * g / sum(goals.values())), s) for s, g in goals.items() for k in range(1, seats + 1))[:seats]
    want = {}
    for rank, (_, s) in enumerate(order):
        want[rank // 16, s] = want.get((rank // 16, s), 0) + 1
    assert got == want


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op9_mixing"]).fetchall())
    got = sorted(tuple(r) for r in op9_mixing(spark, small).collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-12) for g, w in zip(got, want))


def test_shares_and_limits(spark):
    docs = make(spark, [prose(i, 50 + i % 90) for i in range(300)], sources=("a", "a", "a", "b", "c", None))
    mix = m.mix(docs, block=16, shard_blocks=32)
    sources = {r.source: r for r in mix.sources.collect()}
    taken = {r.source: r.t for r in mix.documents.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert set(sources) == {"a", "b", "c", None}
    for s, r in sources.items():
        assert abs(taken[s] - r.target) <= 32
    assert mix.documents.where("taken > 2 * size or taken < 0").count() == 0
    assert {r.source: r.n for r in mix.quotas.groupBy("source").agg(F.sum("quota").alias("n")).collect()} == {s: r.seats for s, r in sources.items()}
    again = {r.doc_id: r.taken for r in m.mix(docs.repartition(7), block=16, shard_blocks=32).documents.collect()}
    assert again == {r.doc_id: r.taken for r in mix.documents.collect()}


def test_taken_texts_hold_the_words_taken(spark):
    docs = make(spark, [prose(i, 40) for i in range(60)] + ["", None])
    out = m.take(docs, block=16, shard_blocks=32)
    assert out.columns == docs.columns
    words = lambda df: {r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.sum(m.word_count(F.col("text"))).alias("n")).collect()}
    plan = {r.doc_id: r.taken for r in m.mix(docs, block=16, shard_blocks=32).documents.collect()}
    got = words(out)
    assert all(got.get(i, 0) == n for i, n in plan.items()) and {60, 61} <= set(got)
    assert out.where("n_chars != coalesce(length(text), n_chars)").count() == 0


def test_odd_rows(spark, odd, none):
    got = m.digest(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.size for r in got if r.doc_id in (0, 1, 2, 3)} == {0: 0, 1: 0, 2: 0, 3: 1}
    assert m.digest(none).count() == 0
    assert m.digest(make(spark, [None, ""])).collect()[0].taken == 0


def test_shards_take_their_quotas_in_blocks(spark):
    docs = make(spark, [prose(i, 50 + i % 90) for i in range(200)], sources=("a", "a", "b", "c"))
    options = {"block": 16, "shard_blocks": 8}
    mix = m.mix(docs, **options)
    out = m.take(docs, shard="part", **options)
    assert out.columns == [*docs.columns, "part"]
    got = {(r.part, r.source): r.n for r in out.groupBy("part", "source").agg(F.sum(m.word_count(F.col("text"))).alias("n")).collect()}
    quotas = {(r.shard, r.source): r.quota for r in mix.quotas.collect()}
    ends = {r.source: (r.blocks * 16 - r.size) for r in mix.sources.collect()}
    assert set(got) == set(quotas)
    # a block is of 16 words, but for the last of a source's line
    assert all(q * 16 - 2 * ends[key[1]] <= got[key] <= q * 16 for key, q in quotas.items())
    assert max(sum(q for (p, _), q in quotas.items() if p == part) for part, _ in quotas) == 8


def test_rows_without_ids_or_of_one_id_are_documents_of_their_own(spark):
    docs = make(spark, [prose(i, 30) for i in range(40)]).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(1).cast("long")))
    docs = docs.union(docs)
    options = {"block": 8, "shard_blocks": 16}
    assert m.digest(docs, **options).count() == 80
    out, texts = m.take(docs, **options), {r.text for r in docs.collect()}
    total = m.mix(docs, **options).documents.agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(m.word_count(F.col("text")))).first()[0] == total
    assert out.count() <= 80 * 3 and all(any(r.text in t for t in texts) for r in out.collect())


@pytest.mark.parametrize("text, at, n, want", [("  a b\n c ", 0, 2, "  a b"), ("  a b\n c ", 1, 2, " b\n c"), ("x", 0, 1, "x")])
def test_words_between(spark, text, at, n, want):
    assert spark.range(1).select(m.words_between(F.lit(text), F.lit(at), F.lit(n))).first()[0] == want


def test_a_source_beside_many_small_ones_has_all_its_seats(spark):
    goals = {"0": 2000.0, **{f"0s{i:03}": 2.0 for i in range(600)}}
    got = {r.key: r.n for r in m.apportion(spark.createDataFrame(list(goals.items()), "key string, target double"), block=10, shard_blocks=64).groupBy("key").agg(F.sum("quota").alias("n")).collect()}
    seats = round(sum(goals.values()) / 10)
    order = sorted(((2 * k - 1) / (2 * g / sum(goals.values())), s) for s, g in goals.items() for k in range(1, seats + 1))[:seats]
    want = {}
    for _, s in order:
        want[s] = want.get(s, 0) + 1
    assert got == want and got["0"] > math.ceil(2000 / 3200 * seats) + 2
