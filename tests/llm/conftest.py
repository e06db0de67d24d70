import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, h1 string, row string"


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}x{draw.randrange(3)}" + ("\n" if draw.random() < 0.1 else "") for _ in range(n))


def make(spark, texts, langs=("en",), sources=("a", "b", "c")):
    """Documents with columns beside those of ``documents``, some with names that operators use."""
    data = [(i, t, langs[i % len(langs)], sources[i % len(sources)], len(t or ""), "k", 7, "h", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, texts of few words."""
    long = prose(1, 30000, 5000)
    data = [
        (0, None, None, None, None, None, None, None, None),
        (1, "", "en", "a", 0, "", 0, "", ""),
        (2, " \n\t ", "en", "b", 4, "x", 1, "x", "x"),
        (3, "one", "en", "a", 3, "x", 1, "x", "x"),
        (4, "one", "fr", None, 3, "x", 1, "x", "x"),
        (5, long, "en", "a", len(long), "x", 1, "x", "x"),
        (5, long, "en", "a", len(long), "x", 1, "x", "x"),
        (None, "no id here at all", "de", "b", 17, "x", 1, "x", "x"),
        (7, "é ü 𝔘nicode text \U0001f600 ''s 12 ³", "es", "c", 20, "x", 1, "x", "x"),
        (8, "\x00 nul \x1f and <|endoftext|>", None, "c", 20, "x", 1, "x", "x"),
    ]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
