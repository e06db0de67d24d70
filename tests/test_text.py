import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import text as T


def each(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


CLEAN = [
    ("Sujets : Roadmap produit", "Roadmap produit"),
    ("Sujets: Intervenants: bonjour", "bonjour"),
    ("R&D : R&D le point", "le point"),
    ("- Sous-titrage par X", ""),
    ("  rien à enlever  ", "rien à enlever"),
    ("C'est fini, hein. C'est fini, hein. C'est fini, hein.", "C'est fini, hein."),
    ("C'est fini. C'est fini.", "C'est fini. C'est fini."),
]


def test_clean_text(spark):
    assert each(spark, [a for a, _ in CLEAN], T.clean_text) == [b for _, b in CLEAN]


KEPT = [
    ("merci.", None),
    ("Merci !", None),
    (" ... ", None),
    ("SOUS-TITRES RÉALISÉS par nous", None),
    ("Nous parlons de radio-canada et du budget de toute l'année avec les équipes", "Nous parlons de  et du budget de toute l'année avec les équipes"),
    ("- bonjour -", "bonjour"),
    ("", None),
    (None, None),
]


def test_kept_text(spark):
    assert each(spark, [a for a, _ in KEPT], T.kept_text) == [b for _, b in KEPT]


SECONDS = [("3723", 3723), ("1:02:03", 3723), ("0:00:28", 28), ("28", 28), ("28.0", 28), ("5.9", 5), (None, 0), ("", 0), ("garbage", 0), ("1:x:2", 0), ("5:03", 303), (" 7 ", 7), (":30", 30)]


def test_seconds(spark):
    assert each(spark, [a for a, _ in SECONDS], T.seconds) == [b for _, b in SECONDS]


def test_times(spark):
    assert each(spark, [3723, 0, None, 59, 36000], T.hms, "long") == ["1:02:03", "0:00:00", "0:00:00", "0:00:59", "10:00:00"]
    assert each(spark, ["1:02:03", "1:2:3", "", None, "00:00:10 "], T.duration_text) == [3723.0, 0.0, 0.0, 0.0, 10.0]


def test_names(spark):
    assert each(spark, ["Alice Martin", "Éva  N.", "--", "A&B 2"], T.slug) == ["alice-martin", "va-n", "person", "a-b-2"]
    assert each(spark, ["  Alice \t Martin "], T.file_name) == ["Alice Martin"]
    assert each(spark, [["[[A]]", "[[B]]"], []], T.yaml_list, "array<string>") == ['["[[A]]", "[[B]]"]', "[]"]
    assert each(spark, ["MD, html,, Vault "], T.comma_list) == [["md", "html", "vault"]]


def test_chunk_line_rounds_half_to_even(spark):
    line = lambda v: T.chunk_line(v, F.lit("Alice"), F.lit("bonjour"))
    assert each(spark, [1979.4, 0.5, 1.5, 2.5], line, "double") == [f"[{n}s] Alice: bonjour" for n in (1979, 0, 2, 2)]


def test_marker(spark):
    keep = lambda v: T.preserve_tail(F.lit("new text \n\n"), v, "<!--m-->")
    got = each(spark, ["old<!--m-->mine<!--m-->too", "no marker", None], keep)
    assert got == ["new text\n\n<!--m-->mine<!--m-->too", "new text\n\n<!--m-->", "new text\n\n<!--m-->"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=20, max_size=20))
def test_escape_and_tokens_equal_python(spark, texts):
    texts = [t for t in texts if "\x00" not in t and not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    if texts:
        assert each(spark, texts, T.html_escape) == [html.escape(t) for t in texts]


@pytest.mark.parametrize("text", ["On ship, Friday!", "Été_2 l'été", "", "日本語 12"])
def test_tokens(spark, text):
    assert sorted(each(spark, [text], T.tokens)[0]) == sorted({m.lower() for m in re.findall(r"\w+", text)})


def test_rules_hold_on_loops_of_any_length(spark):
    df = spark.createDataFrame([("Bonjour. " * 100000 + "Fin", "Sujets: " * 100000 + "texte")], "loop string, stacked string")
    loop, stacked, clean = df.select(T.collapse_loops(F.col("loop")), T.strip_prefixes(F.col("stacked")), T.clean_text(F.concat("stacked", F.lit(" "), "loop"))).first()
    assert (loop, stacked, clean) == ("Bonjour. Fin", "texte", "texte Bonjour. Fin")
