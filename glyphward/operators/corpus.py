"""Operators over whole corpora that have no like for a single text (extensions): quarantine, ranks, groups, spoofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import call, rows_of
from ..functions.unicode import skeleton
from ..sources import settled


def quarantine(docs: DataFrame, scanned: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The dangerous rows: of docs itself, scan()'s result, or, where scanned is another table, those that share their key with a dangerous row of it.

    Keys are compared null-safe: rows without a key are those of scanned without one.
    """
    if scanned is None or scanned is docs:
        return docs.filter("dangerous")
    return docs.join(_bad(scanned, key), docs[key].eqNullSafe(F.col("_bad")), "left_semi")


def clean_corpus(docs: DataFrame, scanned: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The rows that quarantine() does not give: where any row of a key is dangerous, be the key null, none of them is left."""
    if scanned is None or scanned is docs:
        return docs.filter(~F.col("dangerous"))
    return docs.join(_bad(scanned, key), docs[key].eqNullSafe(F.col("_bad")), "left_anti")


def _bad(scanned: DataFrame, key: str) -> DataFrame:
    """The keys of dangerous rows, each once, so that a key of many rows is one on its side of the join."""
    return scanned.filter("dangerous").select(F.col(key).alias("_bad")).distinct()


def union_findings(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a finding of either kind: key, kind, start, end, category, severity, detector, replacement.

    Unicode findings have offsets in the source, personal data in the text without dangerous characters. Both kinds of a row
    come from one array, so the table is read, and each text searched, once.
    """
    unicode = call("transform", "unicode_findings", "x -> named_struct('kind', 'unicode', 'start', x.offset, 'end', x.offset + 1, 'category', x.category, 'severity', x.severity, 'detector', x.codepoint, 'replacement', x.replacement)")
    pii = call("transform", "pii_findings", "x -> named_struct('kind', 'pii', 'start', x.start, 'end', x.end, 'category', x.category, 'severity', x.severity, 'detector', x.detector, 'replacement', x.replacement)")
    return rows_of(scanned, F.concat(unicode, pii), "kind", key)


def findings_by(scanned: DataFrame, *keys: str) -> DataFrame:
    """Per values of the keys and category: the Unicode findings, and the rows that hold one. Rows are counted before the shuffle."""
    kinds = scanned.select(*keys, F.array_distinct(F.transform("unicode_findings", lambda x: x["category"])).alias("_k"), "unicode_findings")
    numbers = F.transform("_k", lambda k: F.struct(k.alias("category"), F.size(F.filter("unicode_findings", lambda x: x["category"] == k)).alias("_n")))
    each = rows_of(kinds, numbers, "category", *keys)
    return each.groupBy(*keys, "category").agg(F.sum("_n").alias("n_findings"), F.count(F.lit(1)).alias("n_docs"))


def ranked_by_findings(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_findings, rank: rows by their number of findings, most first; equal numbers share a rank.

    Numbers are written once, as they are needed twice. Only the different numbers, of which there are few, are put in order
    in one task; their ranks are joined back.
    """
    counted = settled(scanned.select(key, (F.size("unicode_findings") + F.size("pii_findings")).cast("long").alias("n_findings")))
    sizes = counted.groupBy("n_findings").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy(F.desc("n_findings")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = sizes.select("n_findings", (F.coalesce(before, F.lit(0)) + 1).alias("rank"))
    return counted.join(ranks, "n_findings").select(key, "n_findings", "rank")


def top_findings(scanned: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k rows with the most findings, ties to the smaller key; each task keeps k rows."""
    counted = scanned.select(key, (F.size("unicode_findings") + F.size("pii_findings")).cast("long").alias("n_findings"))
    return counted.orderBy(F.desc("n_findings"), key).limit(k)


#: A key that one in so many rows has, or more, is met where its rows stand: at most so many keys are broadcast.
HOT = 1000


def _with_facts(rows: DataFrame, facts: DataFrame, on: str, weight: str) -> DataFrame:
    """Inner join with facts: one row a key, column weight being how many rows have it. No task gets all rows of a hot key.

    Hot keys are known from the weights, and there are at most HOT of them; their facts are broadcast.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    bar = max(total / HOT, 1)
    hot, rest = facts.filter(F.col(weight) >= bar), facts.filter(F.col(weight) < bar)
    few = F.broadcast(hot.select(F.col(on).alias("_hot")))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(few, rows[on] == F.col("_hot"), "left_anti").join(rest, on))


#: Parts into which the rows of a hot key are dealt.
SALTS = 32


def salted(rows: DataFrame, key: str, facts: DataFrame, on: str, counts: DataFrame) -> DataFrame:
    """rows, each with the columns of the row of facts whose `on` its key is (nulls without one); counts: (on, n) rows of each key.

    The rows of a key that one in HOT rows has, or more, are dealt to SALTS parts, and the facts of those keys, HOT at most, come in
    as many copies: however large what a fact holds, none is broadcast and no task has all rows of a key.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("n") >= max(total / HOT, 2)).select(F.col(on).alias("_hot")))
    draw = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), draw).otherwise(0)).drop("_hot")
    last = F.when(F.col("_hot").isNotNull(), SALTS - 1).otherwise(0)
    copies = facts.join(hot, F.col(on) == F.col("_hot"), "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    return dealt.join(copies, (F.col(key) == F.col(on)) & (F.col("_salt") == F.col("_copy")), "left").drop("_salt", "_copy", on)


def _words(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    """The different words of each row's whole text, split at blanks."""
    return docs.select(*keys, F.explode(F.array_distinct(F.split(F.col(f"`{text}`"), " "))).alias("word"))


def _spoof_words(docs: DataFrame, text: str) -> DataFrame:
    """word, n_docs, skeleton, representative, n_words, group_docs of each word that looks like another.

    Words are counted before they are shuffled, and a group's representative and sizes come from partial sums, so a skeleton
    may have any share of the words. Written once.
    """
    words = _words(docs, text).groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))
    words = settled(words.withColumn("skeleton", skeleton(F.col("word"))))
    least = F.min(F.struct(F.col("word").rlike("[^\\x00-\\x7F]"), "word"))["word"]
    groups = words.groupBy("skeleton").agg(least.alias("representative"), F.count(F.lit(1)).alias("n_words"), F.sum("n_docs").alias("group_docs"))
    return settled(_with_facts(words, settled(groups.filter("n_words > 1")), "skeleton", "n_words"))


def spoof_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """skeleton, representative, word, n_docs, n_links: each word that looks like others, with the one that stands for them all.

    Words of whole texts, split at blanks, that differ but have one skeleton are all linked with each other. Rather than all
    pairs, a word has its representative (the least ASCII word of its group, else the least; the representative's own row is
    among them), the rows that hold it (n_docs) and the number of words that it is linked with (n_links). Null texts have no words.
    """
    return _spoof_words(docs, text).select("skeleton", "representative", "word", "n_docs", (F.col("n_words") - 1).alias("n_links"))


def spoof_members(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, word, skeleton, representative, n_links: a row for each row of docs and each of its words that looks like another word.

    Membership in two levels: words belong to a skeleton's representative, rows to words. A word or skeleton that
    many rows have is met where they stand. Rows without a key and repeated rows have rows of their own.
    """
    facts = _spoof_words(docs, text)
    return _with_facts(_words(docs, text, key), facts, "word", "n_docs").select(key, "word", "skeleton", "representative", (F.col("n_words") - 1).alias("n_links"))


def spoofs(docs: DataFrame, text: str = "text") -> DataFrame:
    """skeleton, n: words of whole texts, split at blanks, that differ but look alike, and how many there are of them."""
    words = docs.select(F.explode(F.split(text, " ")).alias("word")).distinct()
    return words.groupBy(skeleton(F.col("word")).alias("skeleton")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
