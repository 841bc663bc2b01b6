"""The automaton of a large lexicon finds what the patterns find, at any number of entries."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glyphward import Lexicon, sanitize
from glyphward.functions import lexicon, spans
from glyphward.functions.arrays import rows_of
from glyphward.functions.spans import detect, raw_spans

PARTS = ["ab", "AB", "a", "ſhit", "shit", "İx", "ıx", "kın", "Kin", "straße", "STRASSE", "σας", "ΣΑΣ", "naïve", "c++", "-x-", "_", "you're", "go away", "go", "away", "ß", "ǆ", "ǅ", "१२", "😀", "é"]
GAPS = [" ", "  ", ".", "-", ",", "'", "", "\n", "@", "_", "1"]


def draw(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(PARTS) + r.choice(GAPS) for _ in range(n))


def own():
    r = random.Random(9)
    profanity = {p: f"<{i}>" for i, p in enumerate(PARTS[:14])} | {draw(i, r.randrange(1, 3)).strip() or "z": "soft" for i in range(40)} | {"": "nothing"}
    softeners = {draw(1000 + i, r.randrange(1, 4)): r.choice(["[removed]", "kinder"]) for i in range(40)} | {"go away": "see you", "you're": "[removed]", "c++": "c"}
    return Lexicon(profanity, softeners, ["Kin", "ΣΑΣ", "", "-x-", "straße", *[draw(2000 + i, 2) for i in range(30)]])


def test_automaton_finds_what_patterns_find(spark, monkeypatch):
    texts = [(i, draw(i, 60)) for i in range(150)] + [(500, None), (501, ""), (502, "mail ab@example.com shit 123-45-6789")]
    docs, lex = spark.createDataFrame(texts, "doc_id long, text string"), own()
    fields = ("start", "end", "category", "severity", "matched", "replacement", "detector", "seq", "rank")

    def all_spans():
        rows = rows_of(docs, raw_spans(F.col("text"), lex), "start", "doc_id")
        chosen = rows_of(docs, detect(F.col("text"), lex), "start", "doc_id")
        return sorted(map(tuple, rows.select("doc_id", *fields).collect())), sorted(map(tuple, chosen.collect()))

    monkeypatch.setattr(spans, "LARGE", 10**9)
    patterns = all_spans()
    monkeypatch.setattr(spans, "LARGE", 0)
    automaton = all_spans()
    for found, wanted in zip(automaton, patterns, strict=True):
        assert set(found) ^ set(wanted) == set()
    assert automaton == patterns and len(patterns[0]) > 1500


def test_time_is_nearly_flat_in_the_entries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = [f"zq{i:06d}x" for i in range(100_000)]

    def took(n):
        lex = Lexicon({w: "soft" for w in words[: n // 2]}, {f"{w} {w}": "soft" for w in words[n // 2 : n - 1]}, [words[-1]])
        plan = docs.select(F.size(raw_spans(F.concat("text", F.lit(f" {words[0]} and {words[-1].upper()}")), lex)).alias("n"))
        start = time.time()
        assert plan.filter("n >= 2").count() == docs.count()
        return time.time() - start

    took(1000)
    few, many = took(1000), took(100_000)
    assert many < 4 * few + 10


def test_lexicon_of_a_table(spark):
    rows = [("profanity", f"w{i}", None if i % 2 else "fine") for i in range(lexicon.LARGE + 50)] + [("softener", "go away", "see you"), ("softener", "go away", "bye"), ("slur", "zorg", None), ("slur", None, None), ("slur", "", "x")]
    lex = Lexicon.from_table(spark.createDataFrame(rows, "kind string, entry string, replacement string"))
    assert lex.entries() == lexicon.LARGE + 52 and lex.slurs == ["zorg"] and lex.softeners == {"go away": "bye"}
    text = "W4 w5 Go away ZORG bob@example.com w4x"
    row = sanitize(spark.createDataFrame([(text,), (None,)], "text string"), lexicon=lex, provider="strict").orderBy(F.desc("text")).first()
    assert row["clean"] == "Fine [removed] Bye [redacted-slur] [redacted-email] w4x" and row["blocked_by"] == ["hostility", "slur"]
    with pytest.raises(ValueError, match="verb"):
        Lexicon.from_table(spark.createDataFrame([("verb", "x", None)], "kind string, entry string, replacement string"))
    assert Lexicon.from_table(spark.createDataFrame([], "kind string, entry string, replacement string")).entries() == 0


def test_batches_of_a_large_lexicon_are_bounded(spark):
    """No worker holds the hits of more than BATCH rows at once, whatever the session's setting."""
    from glyphward.functions import lexicon

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        for rows in ("10000", "0", "100"):
            spark.conf.set(name, rows)
            lexicon.lexicon_spans(F.col("text"), Lexicon({}, {}, ["a"]), 0, "start:int")
            assert int(spark.conf.get(name)) == min(int(rows) or lexicon.BATCH, lexicon.BATCH)
    finally:
        spark.conf.set(name, old)
