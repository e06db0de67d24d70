"""Text rules of a conversation transcript, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag prefixes, junk phrases and fillers that recognisers are known to leak.
PREFIXES = (r"Sujets\s*:", r"Intervenants\s*:", r"R&D\s*F?\s*:", r"R&D\b[\s:]*", r"-\s*Sous-titrage[^\n]*")
JUNK = (r"sous-titrage", r"radio-canada", r"amara\.org", r"crayon d.ontario", r"\bm\.d\.\b", r"société radio", r"sous-titres réalisés")
FILLERS = ("merci.", "merci", "...", "- -", "-", "–", "—", "sous-titrage", "")
JUNK_LIMIT = 60
WORD = r"[\p{L}\p{N}_]+"
PALETTE_SIZE = 6


def strip(text: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_prefixes(text: Column) -> Column:
    """Without any number of stacked tag prefixes (taken one after another, so that there is no limit)."""
    return strip(F.regexp_replace(strip(text), r"(?iuU)^(?:\s*(?:" + "|".join(PREFIXES) + r"))++", ""))


def collapse_loops(text: Column) -> Column:
    """A phrase of 3 to 40 characters that is said three times or more in a row, however often, is said once."""
    return F.regexp_replace(text, r"(?U)(\b[^.!?]{3,40}[.!?])(?:\s*\1){2,}+", "$1")


def clean_text(text: Column) -> Column:
    return strip(collapse_loops(strip_prefixes(text)))


def junk_pattern() -> str:
    return r"(?iuU)(?:" + "|".join(JUNK) + ")"


def is_filler(text: Column, edge: str = " .!?-–—") -> Column:
    return F.btrim(F.lower(text), F.lit(edge)).isin(*FILLERS)


def rejected(text: Column) -> Column:
    """Whether a cleaned text is nothing but filler, or short junk."""
    return (text == "") | is_filler(text) | (text.rlike(junk_pattern()) & (F.char_length(text) < JUNK_LIMIT))


def excise_junk(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, junk_pattern(), ""), F.lit(" -–—"))


def kept_text(text: Column) -> Column:
    """The cleaned text of an utterance, null if it is dropped."""
    first = clean_text(text)
    rest = excise_junk(first)
    return F.when(~rejected(first) & (rest != "") & ~is_filler(rest, " .!?-"), rest)


def tokens(text: Column) -> Column:
    """The set of lower-cased words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower))


def slug(name: Column) -> Column:
    plain = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("person"))


def cluster_number(name: Column) -> Column:
    """The number of a cluster named ``S3``, ``s3`` or ``3``; null of what holds no number."""
    bare = strip(F.regexp_replace(name, "^[Ss]+", ""))
    return F.when(F.rlike(bare, F.lit(r"^[+-]?[0-9]+$")), bare).try_cast("int")


def file_name(name: Column) -> Column:
    return strip(F.regexp_replace(name, r"(?U)\s+", " "))


def yaml_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))


def hms(seconds: Column) -> Column:
    """Whole seconds as H:MM:SS."""
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def seconds(value: Column) -> Column:
    """Whole seconds from text: a number, or fields to base 60; null, empty or unreadable is 0."""
    parts = F.transform(F.split(strip(value), ":"), lambda p: F.when(strip(p) == "", F.lit(0.0)).otherwise(strip(p).try_cast("double")))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 60 + p.try_cast("long"))
    return F.when(value.isNull() | (strip(value) == ""), F.lit(0).cast("long")).otherwise(F.coalesce(total, F.lit(0).cast("long")))


def exact_seconds(value: Column) -> Column:
    """Seconds with their fraction from text, as by ``seconds``; negative numbers stay so."""
    parts = F.transform(F.split(strip(value), ":"), lambda p: F.when(strip(p) == "", F.lit(0.0)).otherwise(strip(p).try_cast("double")))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)
    return F.when(value.isNull() | (strip(value) == ""), F.lit(0.0)).otherwise(F.coalesce(total, F.lit(0.0)))


def duration_text(text: Column) -> Column:
    """Seconds of exactly H..:MM:SS, else 0."""
    return F.when(strip(text).rlike(r"^\d+:\d{2}:\d{2}$"), seconds(text).cast("double")).otherwise(F.lit(0.0))


def html_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def chunk_line(t0: Column, name: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.rint(t0).cast("long").cast("string"), F.lit("s] "), name, F.lit(": "), text)


def after_marker(old: Column, marker: str) -> Column:
    """What stands after the first marker, empty without one."""
    at = F.instr(old, marker)
    return F.when(at > 0, F.substring(old, at + F.lit(len(marker)), F.char_length(old))).otherwise(F.lit(""))


def preserve_tail(generated: Column, old: Column, marker: str) -> Column:
    """New text above the marker, the old file's text below it kept."""
    return F.concat(F.regexp_replace(generated, r"(?U)\s+$", ""), F.lit("\n\n" + marker), F.coalesce(after_marker(old, marker), F.lit("")))


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(strip(x))), lambda x: x != "")
