"""Line dedup: cross-site boilerplate found by how many distinct sites a line is seen on.

Every line that is long enough is hashed (128 bits, of the line without outer white space). A
HyperLogLog sketch of sites is aggregated for each line hash, in partial sketches that merge in the
shuffle, so a line seen everywhere costs one sketch a task. Lines whose estimate is far from
``min_sites`` are decided by it; for those within ``band`` of it the distinct sites are counted
exactly. Lines seen on at least ``min_sites`` sites are boilerplate.

A document loses its boilerplate lines. Only one that has no other line that is long enough is left
whole: it is a copy, of which nothing would be left, and is for document-level deduplication to judge.
With ``max_share``, so is a document that would lose a greater share of its characters.

Edge cases: a null text stays null; a null site is a site of its own; empty lines and lines of fewer
than ``min_words`` words always stay (with 1, every line with a word counts); line ends are ``\\n``; rows
that repeat are treated alike; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm._common import materialize

MIN_SITES, MIN_WORDS, LG_K = 5, 3, 10
#: Four standard errors of a sketch of 2 ** 10 registers, and never under one site.
BAND = 4 * 1.04 / 32
_EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _counts(line: Column, min_words: int) -> Column:
    """Whether a bare line has at least ``min_words`` words."""
    return line.rlike(r"^(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (min_words - 1))


def _exploded(rows: DataFrame, min_words: int) -> DataFrame:
    line = rows.select(*(c for c in rows.columns if c != "text"), F.explode(_lines(F.col("text"))).alias("line")).withColumn("line", _bare(F.col("line")))
    line = line.where(_counts(F.col("line"), min_words))
    return line.select(*(c for c in rows.columns if c != "text"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """(h1, h2, sites) of the boilerplate lines; ``sites`` is an estimate unless ``exact``."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.concat(F.lit("0"), F.col(site).cast("string")), F.lit("1")).alias("site"))
    lines = _exploded(rows, min_words)
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    estimated = sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - band) - 1)
    estimated = materialize(estimated, "spread")
    width = max(1.0, band * min_sites)
    near = F.abs(F.col("sites") - min_sites) <= width
    exact = lines.join(estimated.where(near).select("h1", "h2"), ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
    far = estimated.where(~near & (F.col("sites") > min_sites)).withColumn("exact", F.lit(False))
    return far.unionByName(exact.where(F.col("sites") >= min_sites).withColumn("exact", F.lit(True)))


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, max_share: float | None = None) -> DataFrame:
    """``docs`` with ``text`` cleaned, ``n_lines`` and ``n_removed`` (in place of columns of that name)."""
    found = materialize(boilerplate(docs, text, site, min_sites, min_words).select("h1", "h2"), "boilerplate")
    # a row is known by its id and text; equal rows share a key and an outcome
    key = [F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"), F.xxhash64(F.col(text), F.col(doc_id), F.lit(1)).alias("k2")]
    rows = docs.select(*key, F.col(text).cast("string").alias("text"))
    hits = _exploded(rows, min_words).join(found, ["h1", "h2"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("h1").alias("gone"))
    whole = docs.select(*key, F.col(text).cast("string").alias("text"), F.struct(*(F.col(c) for c in docs.columns if c != text)).alias("row"))
    joined = whole.join(hits, ["k1", "k2"], "left")
    lines = _lines(F.col("text"))
    goes = lambda x: F.array_contains(F.col("gone"), F.xxhash64(_bare(x))) & _counts(_bare(x), min_words)
    joined = joined.withColumn("stay", F.when(F.col("gone").isNotNull(), F.filter(lines, lambda x: ~goes(x))))
    cut = F.coalesce(F.exists("stay", lambda x: _counts(_bare(x), min_words)), F.lit(False))
    if max_share is not None:
        lost = F.char_length("text") - F.char_length(F.array_join("stay", "\n"))
        cut &= F.coalesce(lost <= F.lit(max_share) * F.char_length("text"), F.lit(False))
    cleaned = F.when(cut, F.array_join("stay", "\n")).otherwise(F.col("text"))
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines)
    removed = F.when(cut, F.size(lines) - F.size("stay")).otherwise(F.lit(0)).cast("long")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*(cleaned.alias(c) if c == text else F.col("row")[c].alias(c) for c in kept), n_lines.alias("n_lines"), removed.alias("n_removed"))


_SQL_BARE = r"trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_SQL_WORDS = r"^(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (MIN_WORDS - 1)


def sql(table: str, columns: str) -> str:
    """SQL for ``columns`` (of: every column of ``table``, ``cleaned``, ``n_lines``, ``n_removed``)."""
    return f"""
  with lines as (select doc_id, text, source, n, {_SQL_BARE} as bare, l from (
      select doc_id, text, source, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as n from (select distinct doc_id, text, source from {table}))),
  spread as (select bare from lines where regexp_matches(bare, '{_SQL_WORDS}') group by bare having count(distinct coalesce('0' || source, '1')) >= {MIN_SITES}),
  kept as (select doc_id, text, source, count(*) as n_lines, count(s.bare) as gone,
      coalesce(string_agg(case when s.bare is null then l end, chr(10) order by n), '') as stay,
      count(*) filter (where s.bare is null and regexp_matches(bare, '{_SQL_WORDS}')) as own from lines left join spread s using (bare) group by doc_id, text, source),
  done as (select doc_id, text, source, n_lines, gone > 0 and own > 0 as cut, gone, stay from kept)
  select {columns} from (select d.*, case when cut then stay else d.text end as cleaned, coalesce(k.n_lines, 0)::bigint as n_lines, case when cut then gone else 0 end::bigint as n_removed
    from {table} d left join done k on d.doc_id is not distinct from k.doc_id and d.text = k.text and d.source is not distinct from k.source)
"""


ORACLE_SQL = sql("documents", "doc_id, n_lines, n_removed, cleaned as text")
