import hashlib

from pyspark.sql import functions as F

from colloquy.llm import fingerprints as f

from .conftest import make, prose


def shingles(text):
    low = text.translate({c: c + 32 for c in range(65, 91)})
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(got, texts, tolerance):
    ids = sorted(texts, reverse=True)
    assert set(got) == set(ids)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        n = len(texts[a])
        edited = texts[a][: n - n // 3] + texts[b][: n // 3]
        row = got[a]
        assert (row.n_chars, row.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert abs(row.near_edited - jaccard(shingles(texts[a]), shingles(edited))) <= tolerance
        assert abs(row.near_next - jaccard(shingles(texts[a]), shingles(texts[b]))) <= tolerance


def test_edited_texts_over_run_edges(spark):
    texts = {i * 700: prose(i % 9, 10 + i * 7) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    check({r.doc_id: r for r in f.edited_fingerprints(docs).collect()}, texts, 0.12)


def test_one_document_follows_itself(spark):
    row = f.edited_fingerprints(make(spark, ["a b c d e f g h i j k l"])).collect()[0]
    assert row.near_next == 1.0 and row.doc_id == 0


def test_small_texts_are_exact(spark):
    texts = {i: prose(i % 4, 20) for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check({r.doc_id: r for r in f.edited_fingerprints(docs).collect()}, texts, 1e-9)


def test_odd_rows(spark, odd, none):
    got = f.edited_fingerprints(odd).collect()
    assert len(got) == odd.count() and {r.doc_id for r in got if r.n_chars == 0} == {0, 1}
    same = [r.fingerprint for r in got if r.doc_id in (3, 4)]
    assert same[0] == same[1]
    assert f.edited_fingerprints(none).count() == 0


def test_parts_merge_and_estimate(spark):
    parts = [("x", prose(1, 900)), ("x", prose(2, 900)), ("y", prose(1, 900)), ("z", ""), (None, None)]
    merged = f.merge(f.sketches(spark.createDataFrame(parts, "k string, text string")), ["k"])
    found = {r.k: r for r in merged.withColumn("n", f.distinct_shingles(F.col("sketch"))).collect()}
    a, b = shingles(parts[0][1]), shingles(parts[1][1])
    assert len(found) == 4 and found["z"].n == 0 and found[None].n == 0
    assert abs(found["x"].n - len(a | b)) < 0.25 * len(a | b)
    x, y = (merged.where(F.col("k") == k).select(F.col("sketch").alias(k)) for k in "xy")
    row = x.crossJoin(y).select(f.resemblance(F.col("x"), F.col("y")).alias("r"), f.containment(F.col("y"), F.col("x")).alias("c")).first()
    assert abs(row.r - jaccard(a | b, a)) < 0.15 and row.c > 0.95
