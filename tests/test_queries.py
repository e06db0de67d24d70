"""Every query against its SQL on the smallest tables; the others give rows of a steady schema."""

import math

import duckdb
import pytest

from colloquy.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, sql, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    assert got
    if name in ORACLE_SQL:
        found = sql.sql(ORACLE_SQL[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted([plain(r[i]) for i in at] for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_nothing_imports_the_optional_part():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent
    for path in (root / "colloquy").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"import.*llm|from colloquy\.llm", path.read_text()), path
