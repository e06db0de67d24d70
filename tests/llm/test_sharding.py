import pytest

from colloquy.llm import sharding
from colloquy.llm._common import shared_path

from .conftest import make, prose


def content(df):
    return sorted(map(repr, df.collect()))


def test_compaction_keeps_every_row(spark):
    docs = make(spark, [prose(i, 200) for i in range(120)]).repartition(6)
    store = sharding.ShardStore(spark, shared_path(spark, "t"), target_bytes=40_000)
    first = store.append(docs.where("doc_id < 60"))
    second = store.append(docs.where("doc_id >= 60"))
    before = store.manifest().count()
    last = store.compact()
    assert (first, second) == (1, 2) and last > 2
    assert content(store.rows()) == content(docs)
    live = store.manifest().collect()
    assert len(live) < before and sum(s.rows for s in live) == 120
    full = [s.bytes for s in live if s.tier == 99]
    assert full and all(30_000 <= b < 60_000 for b in full)
    # older versions are still whole until vacuumed
    assert content(store.rows(1)) == content(docs.where("doc_id < 60"))
    assert store.vacuum(last) == before and content(store.rows()) == content(docs)


def test_fewer_than_fanout_shards_stay(spark):
    store = sharding.ShardStore(spark, shared_path(spark, "t"))
    store.append(make(spark, ["a", "b"]).coalesce(1))
    assert store.compact() == 1


def test_of_two_writers_one_wins(spark):
    path = shared_path(spark, "t")
    one, two = sharding.ShardStore(spark, path), sharding.ShardStore(spark, path)
    one.append(make(spark, ["a"]))
    base = one.version()
    one._commit(one.manifest(), base)
    with pytest.raises(sharding.Conflict):
        two._commit(two.manifest(base), base)
    assert one.version() == base + 1


def test_a_late_writer_commits_onto_the_other(spark):
    path = shared_path(spark, "t")
    one, two = sharding.ShardStore(spark, path), sharding.ShardStore(spark, path)
    staged = two.stage(make(spark, ["b"]))
    one.append(make(spark, ["a"]))
    assert two.add(staged) == 2 and sorted(r.text for r in one.rows().collect()) == ["a", "b"]


def test_arrivals_one_after_another_fill_tiers(spark):
    docs = make(spark, [prose(i, 200) for i in range(160)]).repartition(2)
    versions, store = [], sharding.ShardStore(spark, shared_path(spark, "t"), target_bytes=60_000)
    staged = store.stage(docs, docs.doc_id % 8)
    for i in range(8):
        store.add(staged.where(f"batch = {i}"))
        store.compact()
        versions.append(store.manifest().collect())
        assert content(store.rows()) == content(docs.where(f"doc_id % 8 <= {i}"))
        tiers = [s.tier for s in versions[-1]]
        assert all(tiers.count(t) < 4 or t == 99 for t in tiers)  # no tier is left full
    assert len({s.tier for v in versions for s in v}) > 1
    whole = sharding.arrive_and_compact(docs, shared_path(spark, "t"), target_bytes=60_000)
    assert content(whole.rows()) == content(docs) and whole.version() > 8


def test_odd_rows(spark, odd, none):
    store = sharding.arrive_and_compact(odd, shared_path(spark, "t"), target_bytes=5000)
    assert content(store.rows()) == content(odd)
    empty = sharding.ShardStore(spark, shared_path(spark, "t"))
    empty.append(none)
    assert empty.compact() == 1 and empty.manifest().count() == 0
    with pytest.raises(LookupError):
        empty.rows()


def test_vacuum_deletes_what_no_version_names(spark):
    docs = make(spark, [prose(i, 50) for i in range(20)])
    store = sharding.ShardStore(spark, shared_path(spark, "t"))
    store.append(docs.where("doc_id < 10"))
    lost = store.stage(docs.where("doc_id >= 10"))  # the driver dies here
    assert store.vacuum(store.version(), grace_s=3600) == 0  # another writer may still commit it
    assert store.vacuum(store.version(), grace_s=-5) == 1
    fs, where = store._fs(store.path + "/" + lost.first()["shard"].split("/")[0])
    assert not fs.exists(where) and content(store.rows()) == content(docs.where("doc_id < 10"))
    assert store.vacuum(store.version(), grace_s=-5) == 0


def test_compaction_is_rebased_onto_appends(spark, monkeypatch):
    docs = make(spark, [prose(i, 200) for i in range(120)]).repartition(6)
    path = shared_path(spark, "t")
    one, two = (sharding.ShardStore(spark, path, target_bytes=40_000) for _ in range(2))
    one.append(docs.where("doc_id < 90"))
    merge, late = one._merge, [docs.where("doc_id >= 90").coalesce(1)]

    def slow(*args):
        found = merge(*args)
        if late:
            two.append(late.pop())  # while the merge is being written
        return found

    monkeypatch.setattr(one, "_merge", slow)
    last = one.compact()
    assert last > 2 and content(one.rows()) == content(docs)
    live = one.manifest().collect()
    assert len({r.shard for r in live}) == len(live) and {r.since for r in live} == {1, 2}


def test_two_compactions_at_once_lose_and_double_nothing(spark, monkeypatch):
    docs = make(spark, [prose(i, 200) for i in range(60)]).repartition(6)
    path = shared_path(spark, "t")
    one, two = (sharding.ShardStore(spark, path, target_bytes=40_000) for _ in range(2))
    one.append(docs)
    merge, once = one._merge, [1]

    def slow(*args):
        found = merge(*args)
        if once:
            once.pop()
            two.compact()
        return found

    monkeypatch.setattr(one, "_merge", slow)
    one.compact()
    assert content(one.rows()) == content(docs)
    kept = content(one.rows())
    assert one.vacuum(one.version(), grace_s=-5) >= 6 and content(one.rows()) == kept  # the loser's files are gone


def test_shards_are_merged_in_order_of_arrival(spark):
    store = sharding.ShardStore(spark, shared_path(spark, "t"), target_bytes=20_000)
    for i in range(8):
        store.append(make(spark, [f"{i} " + prose(i, 350)]).coalesce(1))
    merged = store._due(store.manifest()).collect()
    assert [r.since for r in sorted(merged, key=lambda r: (r.bin, r.since))] == sorted(r.since for r in merged)
    store.compact()
    runs = [sorted(int(r.text.split()[0]) for r in rows) for rows in ([x.row for x in store.placed().collect() if x.shard == s.shard] for s in store.manifest().collect())]
    assert all(r == list(range(r[0], r[-1] + 1)) for r in runs) and max(map(len, runs)) > 1
