import math
import random

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import lang_id

from .conftest import make

WORDS = {"en": "the of and that with this from which have were".split(), "de": "der die und nicht mit eine auch werden sich über".split(), "fr": "les des une dans pour être avec où qui été".split()}


def text(lang, seed, n=30):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS[lang]) for _ in range(n))


def docs(spark, n=120):
    return make(spark, [text(("en", "de", "fr")[i % 3], i) for i in range(n)], langs=("en", "de", "fr"))


def test_held_out_accuracy(spark):
    model = lang_id.fit(docs(spark))
    assert model.languages == ["de", "en", "fr"]
    rows = spark.createDataFrame([(i, text(("en", "de", "fr")[i % 3], 1000 + i, 6), ("en", "de", "fr")[i % 3]) for i in range(90)], "id long, body string, want string")
    got = lang_id.identify(rows, model, "body").collect()
    assert sum(r.language == r.want for r in got) >= 88 and all(0 < r.probability <= 1 for r in got)


def test_claims_and_hosts_decide_without_text(spark):
    model = lang_id.fit(docs(spark))
    rows = [(i, text("de", i), None, "www.seite.example.de") for i in range(30)] + [(100, "", None, "www.seite.example.de"), (101, "", None, "other.example.de"), (102, "", "fr-FR", None), (103, None, None, None), (104, "12 34", "xx", "a.example.com")]
    got = {r.id: r for r in lang_id.identify(spark.createDataFrame(rows, "id long, body string, said string, host string"), model, "body", "said", "host").collect()}
    assert got[100].language == "de" and got[100].prior > 0.9
    assert got[101].language == "de" and got[102].language == "fr"
    assert got[103].language == "de"  # the prior of all rows
    assert len(got) == 35


def test_priors_equal_brute_force(spark):
    model = lang_id.fit(docs(spark))
    rows = [(i, text(("en", "de")[i % 2], i), f"h{i % 3}.d{i % 2}.net") for i in range(40)]
    got = {r.id: r for r in lang_id.identify(spark.createDataFrame(rows, "id long, body string, host string"), model, "body", None, "host").collect()}
    kappa, flat = lang_id.KAPPA, {"de": (1 - lang_id.UND_PRIOR) / 3, "en": (1 - lang_id.UND_PRIOR) / 3}
    # texts decide, so expected counts are counts
    for i, _, host in rows:
        lang = ("en", "de")[i % 2]
        same = [j for j, _, h in rows if h == host]
        domain = [j for j, _, h in rows if h.split(".", 1)[1] == host.split(".", 1)[1]]
        whole = (sum(j % 2 == i % 2 for j, _, _ in rows) + kappa * flat[lang]) / (len(rows) + kappa)
        above = (sum(j % 2 == i % 2 for j in domain) + kappa * whole) / (len(domain) + kappa)
        want = (sum(j % 2 == i % 2 for j in same) - 1 + kappa * above) / (len(same) - 1 + kappa)
        assert got[i].language == lang and abs(got[i].prior - want) < 1e-3


def test_foreign_bytes_are_no_language(spark):
    model = lang_id.fit(docs(spark))
    noise = "".join(chr(random.Random(4).randrange(0x4E00, 0x9FFF)) for _ in range(200))
    row = lang_id.identify(spark.createDataFrame([(1, noise)], "id long, body string"), model, "body").first()
    assert row.language == "und"


def test_pages(spark):
    html = '<!DOCTYPE html><HTML class="x" lang=\'de-AT\'><head><script>var t="</p>";</script><style>p{}</style></head><body><!-- no --><p>A &amp;lt; b</p></body></html>'
    df = spark.createDataFrame([(html, "https://user@www.Example.org:8080/a?b#c"), (None, None)], "html string, url string")
    a, b = df.select(lang_id.page_text(F.col("html")), lang_id.markup_language(F.col("html")), lang_id.address_host(F.col("url"))).collect()
    assert a[0].split() == ["A", "&lt;", "b"] and a[1] == "de-AT" and a[2] == "www.Example.org"
    assert tuple(b) == (None, None, None)


def test_the_sample_is_bounded_where_ids_and_labels_repeat(spark):
    rows = make(spark, [text("en", 1)] * 50 + [text(("en", "de", "fr")[i % 3], i) for i in range(60)], langs=[f"l{i:02}" for i in range(50)] + ["en", "de", "fr"] * 20)
    rows = rows.withColumn("doc_id", F.when(F.col("doc_id") >= 50, F.col("doc_id")))
    model = lang_id.fit(rows, most=3)
    assert model.languages == ["de", "en", "fr"]
    assert len(lang_id.fit(rows, sample=5).languages) <= 5


def test_posteriors_equal_brute_force(spark):
    model = lang_id.fit(docs(spark))
    size, tables = len(model.languages), model.table.astype(float)
    rows = [(0, "der und which über", "fr", "h.example.es"), (1, "pour être", None, None), (2, None, "de", "x.de"), (3, "zzzz qqqq", "xx", "y.de")]
    frame = spark.createDataFrame(rows, "id long, body string, said string, host string")
    logs = []
    for _, body, said, host in rows:
        data = np.frombuffer((body or "").encode(), np.uint8)
        cell, _ = lang_id.cells(data, np.array([0, len(data)]))
        log = [sum(tables[i][c] for c in cell) * lang_id.TEMPER for i in range(size + 1)]
        for claim, right in ((said, lang_id.DECLARED), (lang_id.SUFFIXES.get(host.split(".")[-1]) if host else None, lang_id.SUFFIX)):
            if claim in model.languages:
                log = [x + math.log(right if i < size and model.languages[i] == claim else 1 / size if i == size else (1 - right) / (size - 1)) for i, x in enumerate(log)]
        top = max(log)
        logs.append([max(x - top, -700) for x in log])
    flat = [(1 - lang_id.UND_PRIOR) / size] * size + [lang_id.UND_PRIOR]
    norm = lambda w: [x / sum(w) for x in w]
    own = [norm([math.exp(x) * p for x, p in zip(log, flat)]) for log in logs]
    kappa = lang_id.KAPPA
    whole = [(sum(o[i] for o in own) + kappa * flat[i]) / (len(rows) + kappa) for i in range(size + 1)]
    got = {r.id: r for r in lang_id.identify(frame, model, "body", "said", "host").collect()}
    for n, (i, _, _, host) in enumerate(rows):
        # each host is the only one of its domain; without a host, of the empty one
        domain = [(own[n][j] + kappa * whole[j]) / (1 + kappa) for j in range(size + 1)]
        prior = [(max(0, own[n][j] - own[n][j]) + kappa * domain[j]) / (0 + kappa) if host else domain[j] for j in range(size + 1)]
        post = norm([math.exp(x) * p for x, p in zip(logs[n], prior)])
        best = max(range(size + 1), key=lambda j: post[j])
        assert got[i].language == [*model.languages, "und"][best] and abs(got[i].probability - post[best]) < 1e-5


def test_odd_rows(spark, odd, none):
    model = lang_id.fit(odd)
    got = lang_id.identify(odd, model, declared="lang", host="source")
    assert got.count() == odd.count() and got.where("language is null or probability is null").count() == 0
    assert set(odd.columns) - {"text"} <= set(got.columns)
    assert lang_id.identify(none, model, declared="lang", host="source").count() == 0
    bare = lang_id.fit(none)
    assert bare.languages == [] and {r.language for r in lang_id.identify(odd, bare).collect()} == {"und"}
