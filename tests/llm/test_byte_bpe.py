import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from colloquy.llm import byte_bpe
from colloquy.llm.queries import TOKENIZERS, op7_byte_bpe


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_equals_the_library(spark, small, library):
    got = {r.doc_id: tuple(r)[1:] for r in op7_byte_bpe(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert got == {d.doc_id: expected(library, d.text) for d in docs}


def test_odd_rows_in_small_blocks(spark, odd, ranks, library):
    done = byte_bpe.decode(byte_bpe.encode(odd.repartition(3), ranks, public_tokenizers.PATTERN, block_chars=50), ranks)
    got = sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in done.collect()), key=repr)
    want = sorted(((r.doc_id, np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in odd.collect()), key=repr)
    assert got == want


def test_empty_table(spark, none, ranks):
    assert byte_bpe.digests(none, ranks, public_tokenizers.PATTERN).count() == 0
