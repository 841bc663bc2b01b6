"""Operator 4: language identification by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship
from .textvec import pieces

#: Documents of a language that the sample has, about; bytes of a dictionary, which draws on all of them.
SAMPLE_DOCS, DICTIONARY = 150, 96 << 10
#: Of a sampled text so many times its part of the dictionary goes to the driver, in slices of SLICE bytes spread over all of it.
ROOM, SLICE = 8, 256
#: Bytes of all dictionaries; beyond that those of very many languages are smaller.
DICTIONARIES = 48 << 20
#: Bytes of the parts of a text that are encoded on their own, and the level at which all are.
PART, LEVEL = 4096, 6
_WORD = re.compile(r"[^\W\d_]+")


def learn(docs: DataFrame, dictionary: int = DICTIONARY, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """A dictionary for each language: raw text of a bounded sample of its labelled rows (columns text, lang).

    The sample has about sample_docs rows of a language, chosen by a hash of doc_id. All of them go into its dictionary
    with slices of equal length, spread over their whole texts; how much other languages have does not matter. dictionary
    bounds what a language takes, so a text of it gives up to ROOM times its part of that, and all of it where the
    language has few rows. There may be any number of languages: their dictionaries share DICTIONARIES bytes. Rows
    whose text is null or without letters teach nothing.
    """
    ship(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    counts = known.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return {}
    dictionary = max(SLICE, min(dictionary, DICTIONARIES // len(counts)))
    shares = [(r["lang"], min(1.0, sample_docs / r["count"]), min(dictionary, ROOM * dictionary // min(sample_docs, r["count"]))) for r in counts]
    # a row a language, as are the dictionaries that every worker has
    bounds = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, _share double, _kept int"))
    known = known.select("lang", "text", "doc_id").join(bounds, "lang")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            cut = [spread(plain(t).encode(), n) for t, n in zip(b.column("text").to_pylist(), b.column("_kept").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(cut, pa.binary())], ["lang", "t"])

    def drawn(rows: DataFrame) -> DataFrame:
        return rows.select("lang", "text", "_kept").mapInArrow(work, "lang string, t binary")

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        own = sorted(map(bytes, rows["t"]), key=lambda t: (hashlib.blake2b(t, digest_size=8).digest(), t))
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "t": [evenly(own, dictionary)]})

    # repeated rows share a draw; distinct keeps the sample bounded
    sample = drawn(known.filter(draw <= F.col("_share"))).distinct()
    top = sample.withColumn("r", F.row_number().over(_window())).filter(F.col("r") <= 4 * sample_docs)
    # a group has 4 * sample_docs texts of bounded length; dictionaries alone go to the driver
    out = {r["lang"]: bytes(r["t"]) for r in top.select("lang", "t").groupBy("lang").applyInPandas(joined, "lang string, t binary").collect()}
    if missing := [(r["lang"],) for r in counts if r["lang"] not in out]:
        # rare languages of which the draw has taken no row: the one with the least hash
        rare = known.join(F.broadcast(docs.sparkSession.createDataFrame(missing, "lang string")), "lang")
        least = rare.groupBy("lang").agg(F.min(F.xxhash64("doc_id")).alias("_h"))
        rows = rare.join(least, "lang").filter(F.xxhash64("doc_id") == F.col("_h"))
        for r in drawn(rows).groupBy("lang").agg(F.min("t").alias("t")).collect():
            out[r["lang"]] = evenly([bytes(r["t"])], dictionary)
    return dict(sorted(out.items()))


def spread(text: bytes, size: int) -> bytes:
    """The text, or size bytes of it in slices of about SLICE bytes at equal distances, from its start to its end."""
    if len(text) <= size:
        return text
    n = max(1, size // SLICE)
    length = size // n
    return b"".join(text[(len(text) - length) * i // max(1, n - 1) :][:length] for i in range(n))


def evenly(parts: list[bytes], size: int) -> bytes:
    """The parts joined, each cut by spread() to one length so that all have at most size bytes; short parts leave room for others."""
    left, most = size, 0
    for i, n in enumerate(sorted(map(len, parts))):
        most = left // (len(parts) - i)
        if n > most:
            break
        left -= n
    else:
        return b"".join(parts)
    return b"".join(spread(x, most) for x in parts)


def _window():
    from pyspark.sql.window import Window

    return Window.partitionBy("lang").orderBy(F.xxhash64("t"), "t")


def plain(text: str) -> str:
    """The text's words of letters, lower-cased, with blanks around: what is encoded of texts and of samples."""
    return f" {' '.join(_WORD.findall(text.lower()))} "


def has_letter(text: str) -> bool:
    """Whether a character is a letter; numerals such as fractions and superscripts are none."""
    return any(c.isalpha() for m in _WORD.finditer(text) for c in m[0])


class Classifier:
    """Bytes that a text takes with each language's dictionary; the smallest wins, ties go to the first name."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.names, self.coders = list(dictionaries), []
        for data in dictionaries.values():
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> np.ndarray:
        parts = [raw[i : i + PART] for i in range(0, len(raw), PART)]
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self.coders], float)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language or und, score, margin: the part by which the next language's size is larger)."""
        if not text or not self.names or not has_letter(text):
            return "und", 0.0, 0.0
        size = self.sizes(plain(text).encode())
        if len(size) == 1:
            return self.names[0], 1.0, 1.0
        i = int(size.argmin())
        score = 1 / np.exp(-(size - size[i]) / 4).sum()
        second = np.partition(size, 1)[1]
        return self.names[i], float(score), float((second - size[i]) / second)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = 0.002) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for every document.

    lang_pred is a learned language, or und for null texts, texts without a letter, or if none was learned; those
    and margins below least_margin are rejected. Whole texts count, as plain() gives them, in parts of PART bytes. Repeated rows have equal
    results; an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(own.value)
        for b in pieces(batches):
            lang, score, margin = zip(*[c.predict(t) for t in b.column("text").to_pylist()], strict=True)
            rejected = [x == "und" or m < least_margin for x, m in zip(lang, margin, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang), pa.array(score), pa.array(margin), pa.array(rejected)], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = 0.002) -> DataFrame:
    """The rows that identify() does not reject, with all their columns, in one pass without a shuffle.

    Null texts and texts without letters go; repeated rows and rows without a doc_id stay or go each for itself; an empty
    table gives no rows.
    """
    ship(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(own.value)
        for b in pieces(batches):
            found = [c.predict(t) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([lang != "und" and margin >= least_margin for lang, _, margin in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def training(docs: DataFrame) -> DataFrame:
    """Rows that the contract lets a model learn from: crc32 of doc_id as text, modulo 4, is not 2."""
    return docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False)))
