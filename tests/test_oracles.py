"""Every query with SQL, against DuckDB over the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(set(entry.oracle_sql()) & set(entry.queries()))


def value(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    mine = entry.queries()[name](spark, SF)
    theirs = duck.sql(entry.oracle_sql()[name])
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    got = sorted((tuple(map(value, r)) for r in mine.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    want = sorted((tuple(map(value, r)) for r in theirs.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    assert got == want


def test_all_other_queries_run(spark):
    for name in ("sanitized", "sanitized_aggressive", "sarif_log", "human_report", "scan_json", "pii_spans"):
        assert entry.queries()[name](spark, SF).count() > 0
    assert entry.entry(spark).count() > 0


def test_answers_are_not_empty(duck):
    """What is compared holds rows, but for one query that the given tables have no rows for."""
    empty = [n for n in NAMES if not duck.sql(entry.oracle_sql()[n]).limit(1).fetchall()]
    assert empty in ([], ["spoof_words"])


def test_tables_are_as_restated():
    """The operators' tables against what the SQL has of them."""
    from glyphward import tables
    from glyphward.plans import fixed

    assert (tables.BIDI, tables.PROFANITY, tables.SOFTENERS) == (fixed.BIDI, fixed.PROFANITY, fixed.SOFTENERS)
