"""Operators over corpora: the user's columns and keys, hot groups, one reading of the table."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphward import clean, sanitize, scan
from glyphward.operators import clean_corpus, corpus, quarantine, ranked_by_findings, render_scan, sarif, spoof_members, spoof_pairs, to_json, union_findings
from glyphward.plans import QUERIES

FOLD = {"р": "p", "а": "a", "ο": "o"}


def folded(word):
    return "".join(FOLD.get(c, c) for c in word)


def test_a_users_columns_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    for out, more in ((clean(docs), 1), (scan(docs), 5), (sanitize(docs), 8)):
        assert out.columns[:5] == docs.columns and len(out.columns) == 5 + more
        assert out.select(docs.columns).exceptAll(docs).count() == 0 and out.count() == docs.count()
    # the text may have any name, with dots and blanks in it, or be called source
    odd = docs.select(F.col("text").alias("my.text x"), F.col("doc_id").alias("text")).limit(3)
    assert clean(odd, "my.text x").filter(F.col("clean").isNull()).count() == 0
    named = scan(docs.select(F.col("text").alias("source")), "source").withColumn("report", render_scan("source"))
    assert named.count() == docs.count() and sarif(named.withColumn("k", F.lit(1)), "k", text="source").count() == docs.count()


def test_columns_that_are_taken(spark):
    docs = spark.createDataFrame([(1, "a‮b bob@example.com", "mine", 5), (2, None, "mine", 6)], "doc_id long, text string, clean string, score int")
    for call in (scan, clean, sanitize):
        with pytest.raises(ValueError, match="clean"):
            call(docs)
    row = scan(docs, prefix="s_").withColumn("json", to_json("s_")).withColumn("report", render_scan(prefix="s_")).orderBy("doc_id").first()
    assert row["clean"] == "mine" and row["s_clean"] == "ab [redacted-email]" and row["s_dangerous"] and '"clean":"ab [redacted-email]"' in row["json"] and "DANGEROUS" in row["report"]
    assert sarif(scan(docs, prefix="s_"), prefix="s_").count() == 2
    both = sanitize(clean(docs, prefix="c_"), prefix="p_").orderBy("doc_id").collect()
    assert [(r["clean"], r["c_clean"], r["p_score"], r["score"]) for r in both] == [("mine", "ab [redacted-email]", 80, 5), ("mine", None, 100, 6)]


def test_rows_without_a_key_do_not_slip_through(spark):
    docs = spark.createDataFrame([(None, "a‮b"), (1, "a‮b"), (2, "fine"), (3, "fine"), (3, "c​d"), (4, None)], "doc_id long, text string")
    scanned = scan(docs)
    texts = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in df.collect())
    assert texts(quarantine(scanned)) == [(-1, "a‮b"), (1, "a‮b"), (3, "c​d")]
    assert texts(clean_corpus(scanned)) == [(2, "fine"), (3, "fine"), (4, "")]
    # by key, all rows of a key share its fate
    assert texts(clean_corpus(docs, scanned)) == [(2, "fine"), (4, "")]
    assert texts(quarantine(docs, scanned)) == [(-1, "a‮b"), (1, "a‮b"), (3, "c​d"), (3, "fine")]
    assert quarantine(scanned.limit(0)).count() == clean_corpus(docs.limit(0), scanned.limit(0)).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_read_once(spark):
    docs = scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert plan(union_findings(docs)).count("FileScan") == 1
    assert plan(quarantine(docs)).count("FileScan") == plan(clean_corpus(docs)).count("FileScan") == 1
    ranked = ranked_by_findings(docs)
    assert plan(ranked).count("FileScan") == 0 and ranked.count() == 200
    dangerous = plan(QUERIES["dangerous_docs"](spark, "/root/testdata/sf0.001"))
    # the look at the texts stands above the deal of rows to all cores, and makes no findings
    assert dangerous.index("translate") < dangerous.index("RoundRobin") and "translate" not in dangerous[dangerous.index("RoundRobin") :] and "inline" not in dangerous


def test_spoofs_with_a_skeleton_of_half_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(corpus, "HOT", 20)
    hot = ["pao", "рao", "pаo", "paο", "раο"]
    rows = [(i, f"{hot[i % 5]} word{i} {hot[(i + 1) % 5]} word{i}") for i in range(300)] + [(i, f"tail{i} pop{i % 7}") for i in range(300, 500)]
    rows += [(600, "рop1 pop1"), (601, None), (602, ""), (None, "рao"), (603, "рao рao"), (603, "рao")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    words = [(i, w) for i, t in rows if t is not None for w in dict.fromkeys(t.split(" "))]
    groups, n_docs = defaultdict(set), Counter(w for _, w in words)
    for _, w in words:
        groups[folded(w)].add(w)
    known = {w: (s, min(g, key=lambda x: (not x.isascii(), x)), len(g) - 1) for s, g in groups.items() if len(g) > 1 for w in g}
    got = sorted(map(tuple, spoof_pairs(docs).select("word", "skeleton", "representative", "n_links", "n_docs").collect()))
    assert got == sorted((w, *known[w], n_docs[w]) for w in known) and len(got) == 7
    got = spoof_members(docs).select("doc_id", "word", "skeleton", "representative", "n_links").collect()
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(map(key, got)) == sorted(key((i, w, *known[w])) for i, w in words if w in known)
    # all pairs of the group follow from it
    assert sum(r["n_links"] for r in spoof_pairs(docs).collect() if r["skeleton"] == "pao") == 5 * 4
    assert spoof_members(docs.limit(0)).count() == spoof_pairs(docs.limit(0)).count() == 0
