"""Operator 7: personal data, and terms that disclose it, by information-theoretic sanitisation."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import only, ship, stash
from .textvec import pieces

KINDS = ("email", "ip", "card", "phone")
#: A term discloses an entity whose information it gives away by this part or more.
DISCLOSURE = 0.8
#: Different terms that a task counts before it sends them on.
TERMS_HELD = 300_000
#: Terms of texts sent on at once, but for those of one text.
WORDS_A_BATCH = 50_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
# A match can only start where a run of digits does: from within it, the same dots would be missing.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Terms are runs of at least four letters.
_TERM = re.compile(r"[^\W\d_]{4,}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; leftmost matches, those that fail a test left out."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            # the local part is the run of its characters before the sign, from the last match's end at the earliest
            at = start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Each term of the text with its places outside all spans."""
    taken = sorted((s, e) for _, s, e in spans)
    out: dict[str, list[tuple[int, int]]] = {}
    at = covered = 0
    for m in _TERM.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][0] < e:
            covered = max(covered, taken[at][1])
            at += 1
        if s >= covered:
            out.setdefault(m[0].lower(), []).append((s, e))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(docs: DataFrame) -> DataFrame:
    """Each row's base spans and entities, and its text where it has any."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            base, key, entities, kept = [], [], [], []
            for t in b.column("text").to_pylist():
                spans = base_spans(t or "")
                base.append(joined(spans))
                entities.append(sorted({f"{k}:{t[s:e].lower()}" for k, s, e in spans}))
                kept.append(t if spans else None)
                key.append(int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(key, pa.int64()), pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.string())), pa.array(kept, pa.string())], ["doc_id", "text_key", "base", "entities", "text"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, text_key long, base string, entities array<string>, text string")


def _words(texts: DataFrame) -> DataFrame:
    """text_key, term: the terms of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            key, term = array("q"), []
            for k, t in zip(b.column("text_key").to_pylist(), b.column("text").to_pylist(), strict=True):
                term += terms_of(t, base_spans(t))
                key.extend([k] * (len(term) - len(key)))
                if len(key) > WORDS_A_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(term, pa.string())], ["text_key", "term"])
                    key, term = array("q"), []
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(term, pa.string())], ["text_key", "term"])

    return texts.select("text_key", "text").mapInArrow(work, "text_key long, term string")


def _places(texts: DataFrame) -> DataFrame:
    """text_key, terms: the places in each text of the terms in its column marked, in order."""
    place = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for t, marked in zip(b.column("text").to_pylist(), b.column("marked").to_pylist(), strict=True):
                own = terms_of(t, base_spans(t))
                out.append([{"s": s, "e": e} for s, e in sorted(x for term in marked for x in own[term])])
            yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(out, place)], ["text_key", "terms"])

    return texts.select("text_key", "text", "marked").mapInArrow(work, "text_key long, terms array<struct<s:long,e:long>>")


def _term_counts(docs: DataFrame) -> DataFrame:
    """term, n_t: the documents of the whole corpus that hold each term; a task adds up its own before it sends them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()

        def held() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])
            count.clear()
            return out

        for b in batches:
            for t in b.column("text"):
                if text := t.as_py():
                    count.update({x.lower() for x in set(_TERM.findall(text))})
                    if len(count) > TERMS_HELD:
                        yield held()
        yield held()

    return docs.select("text").mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def find(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, text_key, base, terms: base spans of every row, and the spans of terms that disclose its entities.

    With p from the documents of the corpus, a term t discloses an entity c if PMI(c, t) >= disclosure * -log p(c),
    be c in many documents or in one; c and t go together where a document holds both, at any distance. All places
    of t in all documents that hold c are marked. terms is an array of structs (s, e). Null texts count as
    empty; repeated rows have equal results, one each; an empty table gives no rows; other columns are ignored.
    """
    scanned = stash(_scan(docs))
    plain = scanned.select("doc_id", "text_key", "base")
    # rows of one text hold the same; m of them
    texts = stash(scanned.filter(F.size("entities") > 0).groupBy("text_key").agg(F.count(F.lit(1)).alias("m"), F.first("entities").alias("entities"), F.first("text").alias("text")))
    if texts.isEmpty():
        return plain.withColumn("terms", F.lit(None).cast("array<struct<s:long,e:long>>"))
    total = F.lit(float(scanned.count()))
    named = texts.select("text_key", "m", F.explode("entities").alias("entity"))
    # entities that stand in the same texts have the same terms: one stands for all of them
    where = [F.bit_xor(F.xxhash64("text_key", F.lit(i))).alias(f"at{i}") for i in range(2)]
    entities = named.groupBy("entity").agg(F.sum("m").alias("n_c"), F.count(F.lit(1)).alias("texts"), *where)
    entities = entities.groupBy("n_c", "texts", "at0", "at1").agg(F.min("entity").alias("entity")).select("entity", "n_c")
    # n_ct <= n_c, so no term of more documents than this can pass
    most = F.pow(total, F.lit(1 - disclosure)) * F.pow(F.col("n_c"), F.lit(disclosure)) * (1 + 1e-9)
    held = stash(named.join(entities, "entity").withColumn("most", most))
    highest = held.groupBy("text_key").agg(F.first("m").alias("m"), F.max("most").alias("highest"))
    words = _words(texts).join(highest, "text_key").join(_term_counts(docs), "term").filter(F.col("n_t") <= F.col("highest"))
    words = stash(words.select("text_key", "m", "term", "n_t"))
    # so do terms that as many documents hold, and the same texts with entities: pairs are of what differs, not entities times terms
    own = words.groupBy("term", "n_t").agg(F.count(F.lit(1)).alias("texts"), *where)
    groups = own.groupBy("n_t", "texts", "at0", "at1").agg(F.min("term").alias("like"))
    likes = own.join(groups, ["n_t", "texts", "at0", "at1"]).select("term", "like")
    words = stash(words.join(likes, "term"))
    stands = words.filter(F.col("term") == F.col("like")).select("text_key", "like", "n_t")
    pairs = stash(held.join(stands, "text_key").filter(F.col("n_t") <= F.col("most")).select("text_key", "m", "entity", "like", "n_c", "n_t"))
    counted = pairs.groupBy("entity", "like", "n_c", "n_t").agg(F.sum("m").alias("n_ct"))
    pmi = F.log(total * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    telling = counted.filter(pmi >= F.lit(disclosure) * F.log(total / F.col("n_c"))).select("entity", "like")
    told = pairs.join(telling, ["entity", "like"], "left_semi").select("text_key", "like").distinct()
    marked = words.join(told, ["text_key", "like"], "left_semi").select("text_key", "term")
    terms = _places(texts.join(marked.groupBy("text_key").agg(F.collect_list("term").alias("marked")), "text_key"))
    return plain.join(terms, "text_key", "left").select("doc_id", "text_key", "base", "terms")


def _of_kind(kind: str):
    return lambda x: x.startswith(f"{kind}:")


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans (base, then terms) of find()'s rows."""
    count = [F.size(F.filter(F.split("base", ","), _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    extra = F.transform(F.coalesce("terms", F.array().cast("array<struct<s:long,e:long>>")), lambda x: F.concat(F.lit("term:"), x.s.cast("string"), F.lit(":"), x.e.cast("string")))
    spans = F.array_join(F.filter(F.concat(F.array("base"), extra), lambda x: x != ""), ",")
    return found.select("doc_id", *count, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Entities and disclosing terms generalised to their kind; of overlapping spans the earliest, longest stays."""
    out, at = [], 0
    for s, e, k in sorted(((s, e, k) for k, s, e in spans), key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"[{k}]"]
            at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """The same rows and columns with texts generalised; n_chars, where there is one, follows the text.

    Base kinds are replaced where the texts stand; only rows of documents with disclosing terms are looked up. Null texts stay
    null, empty ones empty; repeated rows have equal results; columns of any other name are carried along; an empty table
    gives no rows.
    """
    found = stash(find(docs, disclosure).filter(F.size("terms") > 0).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "terms").distinct())
    own = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
    no_terms = F.lit(None).cast("array<struct<s:long,e:long>>").alias("terms")
    if found.isEmpty():
        rows = own.select("text", no_terms, "_all")
    else:
        ids = stash(found.select(F.col("_d").alias("doc_id")).distinct().filter("doc_id is not null"))
        known = own.filter("doc_id is not null")
        told = only(known, ids, "doc_id").unionByName(own.filter("doc_id is null"))
        told = _key(told).join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text_key") == F.col("_k")), "left")
        rows = told.select("text", "terms", "_all").unionByName(only(known, ids, "doc_id", out=True).select("text", no_terms, "_all"))
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            text = []
            for t, terms in zip(b.column("text").to_pylist(), b.column("terms").to_pylist(), strict=True):
                spans = base_spans(t or "") + [("term", x["s"], x["e"]) for x in terms or []]
                text.append(sanitised(t, spans) if spans else t)
            new = {"text": pa.array(text, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in text], pa.int64())
            kept = dict(zip(names, b.column("_all").flatten(), strict=True))
            yield pa.RecordBatch.from_arrays([new.get(n, kept[n]) for n in names], names)

    return rows.select("text", "terms", "_all").mapInArrow(work, T.StructType(docs.schema.fields))


def _key(docs: DataFrame) -> DataFrame:
    """docs with the key of its text that _scan() gives."""
    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little", signed=True)).astype("int64")

    return docs.withColumn("_text_key", key("text"))
