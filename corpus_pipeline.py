"""A corpus pipeline: documents whose language is known, without boilerplate lines and near copies,
mixed to source weights and encoded.

Each stage takes (spark, docs, sf_dir), reads all of ``docs`` and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``. All stages but the last return the columns of
``documents``. No stage joins rows by their id, so rows that share one or have none are documents of
their own; very long texts are one row each everywhere; an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import byte_bpe, lang_id, line_dedup, mixing, order_minhash
from colloquy.llm._common import materialize
from colloquy.llm.queries import TOKENIZERS


#: Documents that would lose more of their characters to line dedup are left for the near-copy stage, so
#: that copies reach it whole.
MAX_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; ``lang`` is the declaration and ``source`` the host. The model is
    fitted on the stage's own documents (a bounded sample of those with a language).

    Null and empty texts have the evidence of their declaration and host only; rows that repeat have one
    outcome; ties of languages go to the first by name; without any declared language all documents go."""
    marked = [F.coalesce(F.concat(F.lit("1"), F.col(c).cast("string")), F.lit("0")) for c in ("doc_id", "text", "lang", "source")]
    key = [F.xxhash64(*marked).alias("k1"), F.xxhash64(F.lit(1), *marked).alias("k2")]
    found = lang_id.identify(docs.select(*key, "text", "lang", "source"), lang_id.fit(docs), declared="lang", host="source")
    gone = materialize(found.where(~lang_id.accepted(F.col("language"), F.col("probability"))).select("k1", "k2").distinct(), "rejected")
    return docs.select(*key, F.struct(*docs.columns).alias("row")).join(gone, ["k1", "k2"], "left_anti").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites; ``n_chars`` is counted again.

    Null texts stay null, and a null source is a site of its own; every row stays, and rows that repeat
    are treated alike; a text of nothing but such lines, or of more than ``MAX_SHARE``, is left whole."""
    cleaned = line_dedup.remove_boilerplate(docs, max_share=MAX_SHARE)
    return cleaned.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least id.

    Null and empty texts are equal to each other; a row without an id stays only where no near copy has
    one; of different texts under one id each stands for itself; of rows equal in id and text one stays."""
    return order_minhash.representatives(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document stands once for each round that takes it, cut where a round begins or ends.

    Texts without words (null ones among them) stay once; null sources are one source, the last; rows
    that repeat are taken each for itself; ties in the seeded order go by text."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 (of the bytes that the ids decode to), a row for each row.

    Null texts are empty and have no ids; rows that repeat or lack an id are encoded each for itself."""
    import public_tokenizers

    ranks = byte_bpe.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    done = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, stable=True), ranks)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: SQL has no byte-level BPE.
ORACLE_SQL = None
