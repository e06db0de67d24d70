"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied for each language and for ``und`` (no known language):
the likelihood of the text's byte trigrams under a table for each language, against a flat table for
``und``; a declared markup language, right with probability ``DECLARED``; the country suffix of the
address, right with probability ``SUFFIX``; and a prior for the host. Host priors are smoothed
hierarchically from expected counts, found by grouped aggregation of each row's posterior before
priors: the host's counts (less the row's own share) are mixed with ``KAPPA`` counts of the prior of
its domain, that with ``KAPPA`` of the prior of all rows, and that with a flat one.

The trigram tables are fitted on at most ``SAMPLE`` labelled rows, those with the least hash of
their id and text (rows equal in both count once), for the ``LANGUAGES`` most frequent labels among
them, in ``2 ** BITS`` hashed cells a language: a bounded model, whatever the corpus. Rarer labels are
no languages of the model.

Edge cases: a null or empty text, declaration, address or host is no evidence of its kind, and a row
without any gets the prior of all rows; a declaration or suffix of another language than the model's
is no evidence; ties go to the first language by name; rows that repeat count each; an empty table
gives an empty result; without labelled rows every row is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm._common import chunks, materialize

SAMPLE, LANGUAGES, BITS = 8000, 64, 15
DECLARED, SUFFIX, KAPPA = 0.9, 0.8, 20.0
#: The share of trigrams that counts as independent evidence, and the prior of ``und``.
TEMPER, UND_PRIOR = 1 / 3, 1e-3
MIN_PROBABILITY = 0.5
#: Country suffixes that speak for a language; others are no evidence.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (languages + 1, cells) log-probabilities, the last for und


def cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of every trigram whose middle byte is a letter or beyond ASCII; A-Z are folded
    and other ASCII is white space. Trigrams don't cross rows: each row is framed by white space."""
    fold = np.full(256, 32, np.uint32)
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    fold[128:] = np.arange(128, 256)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    at = fold[data]
    left, right = np.full(n, 32, np.uint32), np.full(n, 32, np.uint32)
    left[1:], right[:-1] = at[:-1], at[1:]
    edges = offsets[:-1][offsets[:-1] < n]
    left[edges] = 32
    tails = offsets[1:][offsets[1:] > 0] - 1
    right[tails] = 32
    middle = np.flatnonzero(at != 32)
    key = (left[middle] << np.uint32(16)) | (at[middle] << np.uint32(8)) | right[middle]
    return (key * np.uint32(2654435761)) >> np.uint32(32 - BITS), middle


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE, most: int = LANGUAGES) -> Model:
    """Trigram tables from at most ``sample`` different rows with a label, of the ``most`` most frequent labels."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"))
    least = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if least is None:
        return Model([], np.zeros((1, 1 << BITS), np.float32))

    def count(batches):
        import pyarrow as pa

        found: dict[str, np.ndarray] = {}
        for part, data, offsets in chunks(batches):
            cell, where = cells(data, offsets)
            row = np.searchsorted(offsets, where, "right") - 1
            labels = part.column("label").to_pylist()
            names = sorted(set(labels))
            of = np.array([names.index(x) for x in labels])[row]
            for i, name in enumerate(names):
                found[name] = found.get(name, 0) + np.bincount(cell[of == i], minlength=1 << BITS)
        for name, n in found.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["label", "cell", "n"])

    # at most sample rows; cells times labels rows come back, a bound that doesn't grow with the corpus
    chosen = rows.where(F.col("h") <= least).groupBy("h").agg(F.min("label").alias("label"), F.first("text").alias("text"))
    chosen = materialize(chosen.select("label", "text"), "labelled")
    usual = [r.label for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(most).collect()]
    counted = chosen.where(F.col("label").isin(usual)).mapInArrow(count, "label string, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.label for r in counted})
    table = np.full((len(languages) + 1, 1 << BITS), 0.5)
    for r in counted:
        table[languages.index(r.label), r.cell] += r.n
    table[-1] = 1
    return Model(languages, np.log(table / table.sum(1, keepdims=True)).astype(np.float32))


def _evidence(model: Model, carried: list[str]):
    languages = model.languages
    place = {x: i for i, x in enumerate(languages)}
    size = len(languages)

    def said(values, right, read):
        """Log-evidence of a column of claims."""
        out = np.zeros((len(values), size + 1))
        for i, v in enumerate(values):
            at = place.get(read(v)) if v else None
            if at is not None and size > 1:
                out[i, :] = np.log((1 - right) / (size - 1))
                out[i, at] = np.log(right)
                out[i, size] = np.log(1 / size)
        return out

    def run(batches):
        import pyarrow as pa

        for part, data, offsets in chunks(batches, "_text"):
            n = part.num_rows
            cell, where = cells(data, offsets)
            edge = np.searchsorted(where, offsets)
            log = np.zeros((n, size + 1))
            for i in range(size + 1):
                total = np.concatenate(([0.0], np.cumsum(model.table[i][cell], dtype=np.float64)))
                log[:, i] = (total[edge[1:]] - total[edge[:-1]]) * TEMPER
            log += said(part.column("_declared").to_pylist(), DECLARED, lambda v: v.strip().lower().split("-")[0].split("_")[0])
            log += said(part.column("_suffix").to_pylist(), SUFFIX, lambda v: SUFFIXES.get(v.lower()))
            log -= log.max(1, keepdims=True)
            log = np.maximum(log, -700)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (size + 1), pa.int32()), pa.array(log.ravel()))], [*carried, "evidence"])

    return run


def _smoothed(counts: list[Column], total: Column, above: list[Column], kappa: float) -> list[Column]:
    return [(n + kappa * p) / (total + kappa) for n, p in zip(counts, above)]


def identify(rows: DataFrame, model: Model, text: str = "text", declared: str | None = None, host: str | None = None, kappa: float = KAPPA) -> DataFrame:
    """``rows`` without ``text`` and with ``language``, ``probability`` and ``prior`` (of that
    language at the row's host; columns of these names give way). ``host`` is a name like ``www.example.org``: its last part is the
    suffix and its last two parts the domain."""
    names = [*model.languages, "und"]
    size = len(names)
    name = F.lower(F.col(host).cast("string")) if host else F.lit(None).cast("string")
    parts = F.split(name, r"\.")
    suffix = F.when(F.size(parts) > 1, F.element_at(parts, -1))
    domain = F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(name)
    kept = [c for c in rows.columns if c not in (text, "language", "probability", "prior")]
    ready = rows.select(F.struct(*kept).alias("row") if kept else F.struct(F.lit(0).alias("_")).alias("row"), F.col(text).cast("string").alias("_text"), (F.col(declared).cast("string") if declared else F.lit(None).cast("string")).alias("_declared"), suffix.alias("_suffix"), F.coalesce(name, F.lit("")).alias("_host"), F.coalesce(domain, F.lit("")).alias("_domain"))
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    carried = ["row", "_host", "_domain"]
    schema = StructType([*(f for f in ready.schema.fields if f.name in carried), StructField("evidence", ArrayType(DoubleType()))])
    found = materialize(ready.mapInArrow(_evidence(model, carried), schema), "evidence")
    flat = [(1 - UND_PRIOR) / max(1, size - 1)] * (size - 1) + [UND_PRIOR if size > 1 else 1.0]
    weigh = lambda priors: F.zip_with("evidence", F.array(*priors), lambda e, p: F.exp(e) * p)
    share = lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, b: a + b))
    own = found.withColumn("_own", share(weigh([F.lit(p) for p in flat])))
    sums = [F.sum(F.col("_own")[i]).alias(f"c{i}") for i in range(size)]
    hosts = materialize(own.groupBy("_host", "_domain").agg(*sums, F.count(F.lit(1)).alias("n")), "hosts")
    again = [F.sum(f"c{i}").alias(f"c{i}") for i in range(size)]
    domains = hosts.groupBy("_domain").agg(*again, F.sum("n").alias("n"))
    whole = domains.agg(*again, F.sum("n").alias("n")).select(*(((F.coalesce(f"c{i}", F.lit(0.0)) + kappa * F.lit(flat[i])) / (F.coalesce("n", F.lit(0)) + kappa)).alias(f"g{i}") for i in range(size)))
    domains = domains.crossJoin(F.broadcast(whole))  # one row
    domains = domains.select("_domain", *(x.alias(f"d{i}") for i, x in enumerate(_smoothed([F.col(f"c{i}") for i in range(size)], F.col("n"), [F.col(f"g{i}") for i in range(size)], kappa))))
    hosts = hosts.join(domains, "_domain").select("_host", F.array(*(f"c{i}" for i in range(size))).alias("_counts"), F.array(*(f"d{i}" for i in range(size))).alias("_above"), "n")
    joined = own.join(hosts, "_host")
    prior = [F.when(F.col("_host") == "", F.col("_above")[i]).otherwise((F.greatest(F.col("_counts")[i] - F.col("_own")[i], F.lit(0.0)) + kappa * F.col("_above")[i]) / (F.col("n") - 1 + kappa)) for i in range(size)]
    joined = joined.withColumn("_prior", F.array(*prior)).withColumn("_post", share(F.zip_with("evidence", "_prior", lambda e, p: F.exp(e) * p)))
    best = F.array_position("_post", F.array_max("_post")).cast("int")
    joined = joined.withColumn("_best", best)
    return joined.select(*(F.col("row")[c].alias(c) for c in kept), F.element_at(F.array(*map(F.lit, names)), F.col("_best")).alias("language"), F.element_at("_post", F.col("_best")).alias("probability"), F.element_at("_prior", F.col("_best")).alias("prior"))


def accepted(language: Column, probability: Column, least: float = MIN_PROBABILITY) -> Column:
    """Whether a document is kept: a known language, and more likely than not."""
    return (language != "und") & (probability >= least)


def page_text(html: Column) -> Column:
    """The text of a page: without comments, scripts, styles and tags, the five basic entities resolved."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return bare


def markup_language(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return F.nullif(found, F.lit(""))


def address_host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))
