import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as p
from colloquy.llm import byte_bpe, line_dedup
from colloquy.llm._common import materialize
from colloquy.llm.queries import TOKENIZERS

from .conftest import make, prose


def test_stages_on_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        seen[name] = docs
        docs = materialize(stage(spark, docs, small), name)
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns and docs.dtypes == seen["language_id"].dtypes
    # languages are known here, so all stay
    assert seen["line_dedup"].count() == seen["language_id"].count()
    # line dedup by exact counts
    sites = {}
    for r in seen["line_dedup"].collect():
        for line in set(r.text.split("\n")):
            sites.setdefault(line.strip(), set()).add(r.source)
    for before, after in zip(seen["line_dedup"].orderBy("doc_id").collect(), seen["near_dedup"].orderBy("doc_id").collect()):
        lines = before.text.split("\n")
        stay = "\n".join(x for x in lines if not (len(x.split()) >= line_dedup.MIN_WORDS and len(sites[x.strip()]) >= line_dedup.MIN_SITES))
        own = any(len(x.split()) >= line_dedup.MIN_WORDS for x in stay.split("\n"))
        want = stay if own and 0 < len(before.text) - len(stay) <= p.MAX_SHARE * len(before.text) else before.text
        assert after.text == want and after.n_chars == len(want)
    kept = [r.doc_id for r in seen["mixing"].collect()]
    assert len(kept) == len(set(kept)) < seen["near_dedup"].count()
    # what is encoded is what was mixed
    ranks = byte_bpe.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, len(library.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in seen["byte_bpe"].collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in docs.collect()) == want


def test_copies_and_foreign_texts_go_and_clean_ones_stay(spark):
    clean = [prose(i, 80) for i in range(30)]
    foreign = "".join(chr(0x4E00 + i * 37 % 9000) for i in range(300))
    docs = make(spark, [*clean, clean[3], clean[4].replace("w1", "w2", 1)])
    docs = docs.union(make(spark, [foreign], langs=(None,)).withColumn("doc_id", F.lit(32).cast("long")))
    first = p.language_id(spark, docs, "")
    assert {r.doc_id for r in first.collect()} == set(range(32))
    third = p.near_duplicates(spark, first, "")
    assert {r.doc_id for r in third.collect()} == set(range(30))


def test_odd_rows_pass_every_stage(spark, odd, none):
    docs, seen = odd, {}
    for name, stage in p.STAGES:
        docs = materialize(stage(spark, docs, ""), name)
        seen[name] = sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect())
    # rows without evidence go, then equal texts and repeated rows; texts without words are taken once
    assert seen["language_id"] == seen["line_dedup"] == [-1, 1, 2, 3, 4, 5, 5, 7, 8]
    assert seen["near_dedup"] == [-1, 1, 2, 3, 5, 7, 8]
    assert {1, 2} <= set(seen["mixing"]) <= {-1, 1, 2, 3, 5, 7, 8} and all(seen["mixing"].count(i) == 1 for i in (1, 2))
    assert seen["byte_bpe"] == seen["mixing"]
    docs = none
    for name, stage in p.STAGES:
        docs = materialize(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_rows_without_ids_or_of_one_id_are_kept_apart(spark):
    texts = [prose(i, 60) for i in range(20)]
    docs = make(spark, texts + texts[:4]).withColumn("doc_id", F.when(F.col("doc_id") < 10, F.lit(7).cast("long")))
    kept = p.near_duplicates(spark, docs, "")
    assert sorted(r.text for r in kept.collect()) == sorted(texts)
    mixed = p.mix_sources(spark, docs, "")
    assert mixed.count() <= 24 * 3
    swapped = spark.createDataFrame([(1, None, "a", None, 0), (1, None, None, "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert p.language_id(spark, docs.select(*swapped.columns).union(swapped), "").count() >= 24
