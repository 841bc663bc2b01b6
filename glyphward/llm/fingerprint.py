"""Operator 9: document fingerprints by one-permutation MinHash with optimal densification and b-bit packing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship
from .textvec import mix, pieces, shingles

WORDS, BINS, BITS = 5, 256, 4
#: The fingerprint of a text without words.
EMPTY = "empty"
#: Rows of a range, about, and places drawn for each cut, of which every DRAWN-th is taken, so that ranges are of like size.
RANGE_ROWS, DRAWN = 1000, 16
#: Places drawn at most: beyond that ranges grow, so that places, cuts and heads stay small tables.
MOST_PLACES = 1_000_000
#: The order of rows: with a doc_id first, by descending doc_id (its complement), then by the text's hash.
_ORDER = np.dtype([("none", "i1"), ("id", "<i8"), ("hash", "<i8")])


@lru_cache(4)
def probes(bins: int) -> np.ndarray:
    """probes[t, j]: the bin that empty bin j asks at attempt t, alike for all documents."""
    at = np.arange(1, 1024 * bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(at) % np.uint64(bins)).astype(np.int64).reshape(1024, bins)


def sketch(texts: pa.Array, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(low-order bits of each text's bins, whether it has any word).

    Every shingle is hashed once: its top bits name a bin, which keeps the least hash. An empty bin takes over the
    bin that it meets first on its own random walk (optimal densification), so bins agree with probability J.
    """
    hashes, offs = shingles(texts, words)
    n = len(offs) - 1
    least = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(offs))
    np.minimum.at(least, doc * bins + (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64), hashes)
    least = least.reshape(n, bins)
    full = least != np.iinfo(np.uint64).max
    some = full.any(axis=1)
    row, col = np.nonzero(~full & some[:, None])
    for walk in probes(bins):
        if not len(row):
            break
        source = walk[col]
        hit = full[row, source]
        least[row[hit], col[hit]] = least[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    for r, c in zip(row.tolist(), col.tolist(), strict=True):  # walks this long are all but impossible
        own = np.flatnonzero(full[r])
        least[r, c] = least[r, own[c % len(own)]]
    return (least & np.uint64((1 << bits) - 1)).astype(np.uint8), some


def packed(low: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Hexadecimal digits of the packed bits."""
    flags = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(low), -1)
    return [x.tobytes().hex() if s else EMPTY for x, s in zip(np.packbits(flags, axis=1), some.tolist(), strict=True)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity: equal bins less those that agree by chance. Two empty texts: 1; one: 0."""
    chance = 2.0**-bits
    j = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1) if len(a) else np.zeros(0)
    return np.where(some_a & some_b, j, (some_a == some_b).astype(float))


def unpacked(fingerprint: str, bits: int = BITS) -> np.ndarray:
    flags = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8)).reshape(-1, bits)
    return flags @ (1 << np.arange(bits - 1, -1, -1))


def fingerprint_likeness(a: str, b: str, bits: int = BITS) -> float:
    """likeness() of two stored fingerprints."""
    x, y = a != EMPTY, b != EMPTY
    if not (x and y):
        return float(x == y)
    return float(likeness(unpacked(a, bits)[None], np.array([True]), unpacked(b, bits)[None], np.array([True]), bits)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint of every document; null and empty texts, and those of white space, have EMPTY.

    Repeated rows have equal results; an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(packed(*sketch(b.column("text"), words, bins, bits), bits), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fingerprint string")


def _keys(none: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), _ORDER)
    out["none"], out["id"], out["hash"] = none, ids, hashes
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, _range, _head) dealt so that each row and the next by descending doc_id share a range.

    Null doc_ids come last; rows of equal doc_id, or without, are ordered by their text's hash. Ranges are cut between
    places that a hash of doc_id and text draws, RANGE_ROWS rows apart or so, so many rows of one doc_id are cut as well;
    only rows that are equal in both stay together. The first row of each range is added once more, marked _head,
    behind the range before it (the last range gets the first range's).
    """
    spark = docs.sparkSession
    ship(spark)
    none, flipped = F.col("doc_id").isNull().cast("byte"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long"))
    docs = docs.select("doc_id", "text", none.alias("_none"), flipped.alias("_id"), F.xxhash64("text").alias("_hash"))
    order = docs.select("_none", "_id", "_hash")
    apart = max(1, RANGE_ROWS // DRAWN, order.count() // MOST_PLACES)
    drawn = order.filter(F.pmod(F.xxhash64("_none", "_id", "_hash"), F.lit(apart)) == 0).distinct().toPandas()
    cuts = np.sort(_keys(drawn["_none"], drawn["_id"], drawn["_hash"]))[DRAWN // 2 :: DRAWN]

    @F.pandas_udf("int")
    def place(none: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, _keys(none, ids, hashes), "right").astype(np.int32))

    placed = place("_none", "_id", "_hash").alias("_range")
    tops = order.select(placed, F.struct("_none", "_id", "_hash").alias("top")).groupBy("_range").agg(F.min("top").alias("top")).collect()
    tops = sorted((r["_range"], *r["top"]) for r in tops)
    follow = [(tops[i - 1][0], *tops[i][1:]) for i in range(len(tops))]
    table = spark.createDataFrame(follow, "_range int, _none byte, _id long, _hash long")
    copies = docs.join(F.broadcast(table), ["_none", "_id", "_hash"]).withColumn("_head", F.lit(True))
    rows = docs.withColumn("_range", placed).withColumn("_head", F.lit(False)).unionByName(copies)
    dealt = rows.repartition("_range").sortWithinPartitions("_range", "_head", "_none", "_id", "_hash")
    return dealt.select("doc_id", "text", "_range", "_head")


def edit_fingerprints(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and the next document's.

    The edited text has its last floor(n / 3) code points replaced by the first as many (or all) of the next
    document by descending doc_id; after the last document comes the first. Null texts count as empty, null doc_ids come
    last, rows of one doc_id by their text's hash; an empty table gives no rows; other columns are ignored. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for b in pieces(batches):
            joined = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
            yield joined
            held = joined.slice(joined.num_rows - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            span, head = np.asarray(b.column("_range")), np.asarray(b.column("_head").to_pylist(), bool)
            own = np.flatnonzero((span[:-1] == span[1:]) & ~head[:-1])
            if not len(own):
                continue
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [len(texts[i]) for i in own]
            edited = [texts[i][: k - k // 3] + texts[i + 1][: k // 3] for i, k in zip(own.tolist(), n, strict=True)]
            low, some = sketch(b.column("text"), words, bins, bits)
            changed, any_changed = sketch(pa.array(edited, pa.large_string()), words, bins, bits)
            out = [
                b.column("doc_id").take(pa.array(own)),
                pa.array(n, pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(packed(low[own], some[own], bits)),
                pa.array(packed(changed, any_changed, bits)),
                pa.array(likeness(low[own], some[own], changed, any_changed, bits)),
                pa.array(likeness(low[own], some[own], low[own + 1], some[own + 1], bits)),
            ]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(work, schema)
