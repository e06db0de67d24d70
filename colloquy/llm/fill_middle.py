"""Fill-in-the-middle by escaped markers, with DataFrame operations only.

A control character is the mark. It is escaped in the text, ``regexp_replace`` appends it to every unit,
the marks are counted, and ``substring_index`` cuts the text at the marks of two ranks that a hash of the
row's key chooses; the parts lose their marks, are unescaped and put together around three sentinels.
No row meets another: there is no shuffle, and a row costs time linear in its text.

Edge cases: a null text is an empty one; an empty text, one that already has a sentinel, and a share of all
rows stay plain; cuts at either end or at one place give empty parts; a null key is hashed as no digits;
rows that repeat have one outcome; what no unit covers stays with the unit behind it, or with the last part
at the end; a text of more than about 600 MB does not fit the marked string (2 GB). Other columns are
carried by ``fill_middle`` only, but for those that have a name of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units for ``unit``: code points, words with the white space behind them, lines with their ends.
CHARACTERS, WORDS, LINES = r"(?s).", r"\S+\s*", r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of rows that are changed, and of these that have the suffix first.
RATE, SPM_RATE = 90, 20
_MARK, _ESCAPE = "\x01", "\x02"


@dataclass(frozen=True)
class Parts:
    n: Column
    prefix: Column
    middle: Column
    suffix: Column


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_MARK), F.lit(_ESCAPE + "m"))


def _bare(marked: Column) -> Column:
    plain = F.replace(marked, F.lit(_MARK), F.lit(""))
    return F.replace(F.replace(plain, F.lit(_ESCAPE + "m"), F.lit(_MARK)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))


def mark_units(text: Column, unit: str = CHARACTERS) -> Column:
    """The escaped text with the mark behind every unit; an escape and the letter behind it are never parted."""
    whole = f"(?:{_ESCAPE}.|{unit})" if unit == CHARACTERS else f"(?:{unit})"
    return F.regexp_replace(_escaped(text), F.lit(whole), F.lit("$0" + _MARK))


def count_units(marked: Column) -> Column:
    return (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(_MARK), F.lit("")))).cast("long")


def _index(marked: Column, count: Column) -> Column:
    return F.call_function("substring_index", marked, F.lit(_MARK), count.cast("int"))


def cut(marked: Column, n: Column, low: Column, high: Column) -> Parts:
    """Units up to ``low``, from there to ``high``, and the rest, from a marked text of ``n`` units."""
    head = _index(marked, high)
    return Parts(n, _bare(_index(marked, low)), _bare(_index(head, low - high)), _bare(_index(marked, high - n - 1)))


def hashes(key: Column, seed: int = 1, count: int = 4) -> list[Column]:
    """Unsigned 32-bit integers from the hex digits of the SHA-256 of seed, colon and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    first, head = F.substring(output, len(PREFIX) + 1, 1 << 30), F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(first, SUFFIX, 1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring_index(first, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = CHARACTERS, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = 1) -> DataFrame:
    """``docs`` with n (units), form (plain, psm, spm), prefix, middle and suffix (null if plain) and output."""
    own = {"n", "form", "prefix", "middle", "suffix", "output"}
    kept = [c for c in docs.columns if c.lower() not in own or c in (key, text)]
    body = F.coalesce(F.col("_row")[text].cast("string"), F.lit(""))
    h1, h2, h3, h4 = (F.col("_h")[i] for i in range(4))
    rows = docs.select(F.struct(*kept).alias("_row"))
    rows = rows.withColumn("_h", F.array(*hashes(F.col("_row")[key], seed))).withColumn("_text", body)
    rows = rows.withColumn("_marked", mark_units(F.col("_text"), unit)).withColumn("n", count_units(F.col("_marked")))
    has = [F.contains(F.col("_text"), F.lit(s)) for s in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("_text") == "") | has[0] | has[1] | has[2] | (h3 % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm"))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    parts = cut(F.col("_marked"), F.col("n"), F.least(a, b), F.greatest(a, b))
    changed = F.col("form") != "plain"
    rows = rows.withColumns({c: F.when(changed, getattr(parts, c)) for c in ("prefix", "middle", "suffix")})
    p, m, s = F.col("prefix"), F.col("middle"), F.col("suffix")
    psm, spm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m), F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    rows = rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text")))
    return rows.select("_row.*", "n", "form", "prefix", "middle", "suffix", "output")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every text."""
    done = fill_middle(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    sizes = [F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return done.select("doc_id", "n", "form", *sizes, F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = """with h as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents),
k as (
  select *, ('0x' || s[1:8])::bigint % (n + 1) as a, ('0x' || s[9:16])::bigint % (n + 1) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || s[17:24])::bigint % 100 >= 90 then 'plain'
         when ('0x' || s[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form from h),
c as (
  select *, substring(t, 1, least(a, b)) as p, substring(t, least(a, b) + 1, abs(a - b)) as m, substring(t, greatest(a, b) + 1) as f from k)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then least(a, b) end::bigint as prefix_chars,
  case when form <> 'plain' then abs(a - b) end::bigint as middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || f || '<M>' || m when 'spm' then '<S>' || f || '<P>' || p || '<M>' || m else t end) as output_sha256,
  sha256(t) as restored_sha256 from c"""
