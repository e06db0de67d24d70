import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.llm import fill_middle as fm
from colloquy.llm.queries import op12_fill_middle

from .conftest import make, prose


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text, digest = text or "", sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def check(docs):
    got = [tuple(r) for r in fm.digests(docs).collect()]
    assert sorted(got, key=repr) == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=repr)


def test_marks_escapes_and_sentinels_in_texts(spark):
    texts = ["\x01", "\x02", "\x02\x01m\x02e", "a\x01\x02\x02mb" * 9, "<P>x", "a<S>", "<M", "<<P", "P>S>M>", "x<" * 30, "\U0001f600́é\x00\r\n" * 5, "$0 \\1", "ab"]
    check(make(spark, texts * 12))


def test_odd_rows(spark, odd, none):
    check(odd)
    assert fm.digests(none).count() == 0
    assert fm.fill_middle(odd).columns == [*odd.columns, "n", "form", "prefix", "middle", "suffix", "output"]
    clash = odd.withColumn("output", F.lit(1)).withColumn("Form", F.lit(2))
    assert fm.fill_middle(clash).count() == odd.count()


@pytest.mark.parametrize("unit", [fm.WORDS, fm.LINES])
def test_other_units_restore_texts(spark, unit):
    docs = make(spark, [f"  {prose(i, i)}\n\x01\x02m tail" for i in range(80)])
    done = fm.fill_middle(docs, unit=unit, rate=100).withColumn("back", fm.restore(F.col("output"), F.col("form"))).collect()
    assert all(r.back == r.text == r.prefix + r.middle + r.suffix and r.form != "plain" for r in done) and len(done) == 80
    ends = ("", " ", "\n") if unit == fm.WORDS else ("", "\n")
    assert all(r.prefix[-1:] in ends or r.prefix == r.text for r in done)


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    got = sorted(tuple(r) for r in op12_fill_middle(spark, small).collect())
    assert got == sorted(con.execute(fm.ORACLE_SQL).fetchall()) and {g[2] for g in got} == {"plain", "psm", "spm"}
