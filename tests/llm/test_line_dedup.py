import duckdb
from pyspark.sql import functions as F

from colloquy.llm import line_dedup as d
from colloquy.llm.queries import ORACLE_SQL, op3_line_dedup

from .conftest import make


def test_query_equals_exact_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op3_line_dedup"]).fetchall(), key=repr)
    got = sorted((tuple(r) for r in op3_line_dedup(spark, small).collect()), key=repr)
    assert got == want and any(r[2] for r in got)


def test_spread_near_the_threshold_is_exact(spark):
    # line k stands on k + 1 sites, each twice
    rows = [(100 * k + s, f"line number {k} of all\nbody of {k} {s} is its own and long enough to stay", f"s{s}") for k in range(40) for s in range(k + 1) for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (2, 5, 20):
        found = {r.h1 for r in d.boilerplate(docs, min_sites=least).collect()}
        want = {spark.range(1).select(F.xxhash64(F.lit(f"line number {k} of all"))).first()[0] for k in range(40) if k + 1 >= least}
        assert found == want


def test_copies_stay_whole_and_pages_are_cleaned(spark):
    notice = "All rights reserved by them"
    page = lambda i: f"this is page {i} with its own words and more of them\n{notice}\nand page {i} ends here now"
    copy = "a text that was copied\nto a great many sites\nwith all its lines"
    docs = make(spark, [page(i) for i in range(8)] + [copy] * 8, sources=tuple("abcdefgh"))
    got = {r.doc_id: r for r in d.remove_boilerplate(docs).collect()}
    assert all(notice not in got[i].text and got[i].n_removed == 1 and got[i].n_lines == 3 for i in range(8))
    assert all(got[i].text == copy and got[i].n_removed == 0 for i in range(8, 16))


def test_pages_of_mostly_boilerplate_lose_it(spark):
    notice = "\n".join(f"line {j} of a long notice that all of the sites have" for j in range(9))
    docs = make(spark, [f"own line number {i}\n{notice}" for i in range(8)], sources=tuple("abcdefgh"))
    assert {r.text for r in d.remove_boilerplate(docs).collect()} == {f"own line number {i}" for i in range(8)}
    assert d.remove_boilerplate(docs, max_share=0.5).where("n_removed > 0").count() == 0


def test_short_lines_count_where_one_word_is_enough(spark):
    docs = make(spark, [f"menu\nsomething else number {i} stays" for i in range(9)], sources=tuple("abcdefghi"))
    assert {r.text.split()[0] for r in d.remove_boilerplate(docs, min_words=1).collect()} == {"something"}


def test_short_lines_stay(spark):
    docs = make(spark, [f"two words\nsomething else number {i} stays" for i in range(9)], sources=tuple("abcdefghi"))
    assert d.remove_boilerplate(docs).where("n_removed > 0").count() == 0


def test_odd_rows(spark, odd, none):
    got = d.remove_boilerplate(odd)
    assert sorted(map(repr, got.drop("n_lines", "n_removed").collect())) == sorted(map(repr, odd.collect()))
    assert d.remove_boilerplate(none).count() == 0
    again = d.remove_boilerplate(got)
    assert again.columns == got.columns
