"""Revisit resolution against brute force, its SQL and hard rows."""

import duckdb
from pyspark.sql import functions as F

from glyphward.llm import registry, warc

SF = "/root/testdata/sf0.01"
SCHEMA = "record_id long, uri string, date long, type string, profile string, status int, headers array<struct<name:string,value:string>>, payload string, base string, cell int, url_key string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def full(i, uri, date, tag=None, body="b", status=200):
    return (i, uri, date, "response", None, status, [("Content-Type", "t"), ("Date", "old")] + ([("ETag", tag)] if tag else []), body)


def again(i, uri, date, tag=None):
    return (i, uri, date, "revisit", PROFILE, 304, [("Date", "new"), ("content-type", "bad")] + ([("etag", tag)] if tag else []), None)


def test_canonical(spark):
    want = {"HTTP://WWW2.Ex.org:80/a//?b=2&a=1&utm_source=z#f": "ex.org/a?a=1&b=2", "https://u@ex.org": "ex.org", "ex.org/a": None, "": None, "http://ex.org/A/?SID=3": "ex.org/A", None: None}
    got = spark.createDataFrame([(k,) for k in want], "u string").select("u", warc.canonical(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == want


def test_hard_rows(spark):
    u = "http://ex.org/a"
    records = made(spark, [
        full(1, u, 10, '"x"', "one"), full(2, u + "/", 20, '"y"', "two"), full(3, u, 20, '"y"', "three"), full(4, u, 25, '"p"', status=206), full(5, None, 5, '"x"'), full(6, u, None, '"x"'),
        again(11, u, 10, '"x"'), again(12, u, 20, '"x"'), again(13, u, 21, 'W/"y"'), again(14, u, 22, '"x"'), again(15, None, 30, '"x"'), again(16, u, None, '"x"'), again(17, u, 30), again(18, "http://no.org/", 30, '"x"'),
        (19, u, 40, "revisit", "identical-payload-digest", 200, None, None), (None, None, None, None, None, None, None, None), again(13, u, 21, 'W/"y"'), full(20, "http://n.org", 1, None, None), again(21, "http://n.org", 2), full(22, "http://n.org/e", 1, '"e"', ""), again(23, "http://n.org/e", 2, '"e"'),
    ])
    out = warc.resolve(records).collect()
    assert len(out) == records.count()
    got = {r.record_id: (r.outcome, r.base_id, r.matched_by, r.status, r.payload) for r in out}
    lost = (None, None, 304, None)
    assert got[11] == ("no_response", *lost) and got[15] == ("no_url", *lost) and got[16] == ("no_date", *lost) and got[18] == ("no_response", *lost)
    assert got[12] == ("resolved", 1, "etag", 200, "one") and got[13] == ("resolved", 3, "etag", 200, "three")
    assert got[14] == ("mismatch", 3, None, 304, None) and got[17] == ("mismatch", 3, None, 304, None)
    assert got[19] == ("other", None, None, 200, None) and got[None] == ("other", None, None, None, None) and got[4][0] == "other"
    assert got[21] == ("resolved", 20, "none", 200, None) and got[23] == ("resolved", 22, "etag", 200, "")
    head = next(r.headers for r in out if r.record_id == 13)
    assert [(h.name, h.value) for h in head] == [("Content-Type", "t"), ("Date", "new"), ("etag", 'W/"y"')]
    assert warc.resolve(records.limit(0)).count() == 0


def test_hot_url(spark):
    """One URL over several range partitions, with ties of dates, against brute force."""
    u = "http://ex.org/a"
    rows = [full(i, u, i // 3, f'"{i % 5}"', f"b{i}") if i % 7 == 0 else again(i, u, (i * 37 % 900) // 3, f'"{i % 5}"') for i in range(900)] + [full(5000 + i, f"http://o{i}.org", 1) for i in range(50)]
    out = warc.resolve(made(spark, rows).repartition(4)).collect()
    fulls = [r for r in rows if r[3] == "response" and r[1] == u]
    got = {r.record_id: r for r in out}
    assert len(out) == len(rows)
    for r in rows:
        if r[3] == "revisit":
            best = max(((f[2], f[0], f) for f in fulls if f[2] < r[2]), default=None)
            ok = best is not None and best[2][6][-1][1] == r[6][-1][1]
            assert got[r[0]].base_id == (best and best[1]) and (got[r[0]].outcome == "resolved") == ok
            assert got[r[0]].payload == (best[2][7] if ok else None)


def test_sql(spark):
    columns = "record_id, url_key, outcome, base_id, matched_by, status, headers, payload_md5"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(db.execute(f"SELECT {columns} FROM ({registry.ORACLE_SQL['op2_warc']})").fetchall())
    got = sorted(tuple(r) for r in registry.op2_warc(spark, SF).select(*columns.split(", ")).collect())
    assert got == want and {r[2] for r in got} >= {"response", "resolved", "mismatch", "no_response"}
