"""Operator 11: alignment of two tokenizers' tokens, by document and over the corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import MEMO, Coder
from .runtime import Scratch, heavy, heavy_join, ship
from .textvec import flat, pieces, span_hashes

#: Pairs of ids whose counts are broadcast at most (about 60 bytes each); beyond that they are shuffled.
PAIRS = 500_000
#: The share of all rows from which a pair's counts are broadcast when the others are shuffled.
HEAVY = 0.001
#: Characters beyond which a text is aligned in parts of about so many.
LONG = 4 << 20
#: A place where tokens of both sides end: behind a visible ASCII character, before a blank.
_BORDER = re.compile(r"[!-~](?= )")
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


class ByteTokens(Coder):
    """The byte-level vocabulary; text that spells an added token is ordinary text."""

    def __init__(self, path: str):
        super().__init__(path, added=False)

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts one after the other, len + 1 offsets, each token's bytes, and whether each text's tokens spell it."""
        ids, offs = self.encode(texts)
        _, at = flat(texts)
        size = self.size[ids]
        reach = np.concatenate([[0], np.cumsum(size)])
        return ids, offs, size, reach[offs[1:]] - reach[offs[:-1]] == np.diff(at)


class PieceTokens:
    """A sentencepiece vocabulary: each distinct word with the blanks before it is encoded once and then looked up.

    No piece holds a blank behind anything but a blank, so no merge crosses the border before a word's blanks. The texts come with
    the blank that the model puts in front. Where the library's pieces do not spell a word (as it reads U+2581 as a
    blank), the whole text counts as not spelt.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("pieces that hold a blank behind other characters are not known here")
        if self.model.encode("a") != self.model.encode("a", add_bos=False, add_eos=False) or self.model.decode(self.model.encode("  a  b ")) != "  a  b ":
            raise ValueError("a model that puts something around texts or drops blanks is not known here")
        self.blank = self.model.piece_to_id("▁")
        self.bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.checked = False
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.count, self.fine = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.pool = np.zeros(0, np.int32)

    def _learn(self, words: list[bytes], keys: np.ndarray) -> None:
        """The ids of new words, each of which begins with a blank, as the model itself adds it."""
        got = [ids if w != b" " else [self.blank] for w, ids in zip(words, self.model.encode([w[1:].decode() for w in words], num_threads=1), strict=True)]
        fine = np.array([b"".join(self.bytes[i] for i in ids) == w for w, ids in zip(words, got, strict=True)], bool)
        count = np.array([len(ids) for ids in got], np.int64)
        start = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, *[np.array(ids, np.int32) for ids in got]])
        joined = [np.concatenate(x) for x in ((self.keys, keys), (self.start, start), (self.count, count), (self.fine, fine))]
        order = np.argsort(joined[0], kind="stable")
        self.keys, self.start, self.count, self.fine = (x[order] for x in joined)

    def check(self, texts: list[str]) -> None:
        """Holds whole texts (as they are, without the blank in front) against the library."""
        ids, offs, _, _ = self.tokens(pa.array([" " + t for t in texts], pa.string()))
        for i, t in enumerate(texts):
            if t and self.model.encode(t) != ids[offs[i] : offs[i + 1]].tolist():
                raise ValueError("the model does not encode as expected")

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ByteTokens.tokens(), of texts that begin with a blank or are empty."""
        if not self.checked:
            self.checked = True
            self.check([str(t or "")[1:2000] for t in texts[:3].to_pylist() if "▁" not in (t or "")])
        raw, offs = flat(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.ones(len(texts), bool)
        border = np.zeros(len(raw) + 1, bool)
        border[1:-1] = (raw[:-1] != 0x20) & (raw[1:] == 0x20)
        border[offs] = True
        at = np.flatnonzero(border)
        starts, ends = at[:-1], at[1:]
        keys = span_hashes(raw, starts, ends)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > MEMO:
            self.forget()
        i = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool) if not len(self.keys) else self.keys[np.minimum(i, len(self.keys) - 1)] != distinct
        if new.any():
            f = first[new]
            self._learn([raw[a:e].tobytes() for a, e in zip(starts[f].tolist(), ends[f].tolist(), strict=True)], distinct[new])
            i = np.searchsorted(self.keys, distinct)
        i = i[back]
        count = self.count[i]
        out = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(self.start[i] - out[:-1], count) + np.arange(out[-1])]
        word = np.searchsorted(starts, offs)
        bad = np.concatenate([[0], np.cumsum(~self.fine[i])])
        return ids, out[word], self.size[ids], bad[word[1:]] == bad[word[:-1]]


@lru_cache(2)
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


@lru_cache(2)
def piece_tokens(path: str) -> PieceTokens:
    return PieceTokens(path)


@lru_cache(4)
def _written(size: int, end: str) -> np.ndarray:
    """The numbers below size in decimal, with that sign behind."""
    out = np.empty(size, object)
    out[:] = [f"{i}{end}" for i in range(size)]
    return out


def merged(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of each link, as places, and the links at which a group ends: the merge of both sides' cumulative ends.

    Each further end, of one side or both, closes one link: the tokens that are open there. Both sides spell the same bytes.
    """
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    ends = np.union1d(a_end, b_end)
    a, b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    return a, b, np.flatnonzero((a_end[a] == ends) & (b_end[b] == ends)) if len(ends) else np.zeros(0, np.int64)


def _groups(a_ids: np.ndarray, b_ids: np.ndarray, a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The parts of all groups in order: `a1,a2|b1;`, where the last of them all has its `;` too."""
    # of the groups' last links: the tokens that end there are the last of their side
    a_last, b_last = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    a_last[a[last]], b_last[b[last]] = True, True
    most = int(max(a_ids.max(), b_ids.max())) + 1
    size = 1 << most.bit_length()
    parts = np.empty(len(a_ids) + len(b_ids), object)
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    # before a token of a stand the tokens of b of all groups before its own; before one of b, those of a of its group too
    a_at = np.arange(len(a_ids)) + np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=len(last)))])[a_group]
    b_at = np.arange(len(b_ids)) + np.cumsum(np.bincount(a_group, minlength=len(last)))[b_group]
    parts[a_at] = np.where(a_last, _written(size, "|")[a_ids], _written(size, ",")[a_ids])
    parts[b_at] = np.where(b_last, _written(size, ";")[b_ids], _written(size, ",")[b_ids])
    return parts


class Aligner:
    """The two vocabularies of a worker, and what they make of texts."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.a, self.b = byte_tokens(byte_vocabulary), piece_tokens(piece_model)

    def batch(self, texts: pa.Array) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, pairs, times, whether both sides spell it) of each text that begins with a blank or is empty."""
        a_ids, a_offs, a_size, a_fine = self.a.tokens(texts)
        b_ids, b_offs, b_size, b_fine = self.b.tokens(texts)
        fine = a_fine & b_fine
        if not fine.all():
            a_kept, b_kept = np.repeat(fine, np.diff(a_offs)), np.repeat(fine, np.diff(b_offs))
            a_ids, a_size, b_ids, b_size = a_ids[a_kept], a_size[a_kept], b_ids[b_kept], b_size[b_kept]
            a_offs, b_offs = (np.concatenate([[0], np.cumsum(np.where(fine, np.diff(o), 0))]) for o in (a_offs, b_offs))
        # texts end where tokens of both sides do, so one merge serves all texts of the batch
        a, b, last = merged(a_size, b_size)
        link_offs = np.searchsorted(a, a_offs)
        counts = [np.diff(o).tolist() for o in (a_offs, b_offs, np.searchsorted(last, link_offs), link_offs)]
        parts, part_offs = (_groups(a_ids, b_ids, a, b, last) if len(a) else np.zeros(0, object)), a_offs + b_offs
        joined = a_ids[a].astype(np.int64) << 32 | b_ids[b] if len(a) else np.zeros(0, np.int64)
        out = []
        for d, (n_a, n_b, n_groups, n_links) in enumerate(zip(*counts, strict=True)):
            pairs, times = np.unique(joined[link_offs[d] : link_offs[d + 1]], return_counts=True)
            out.append((n_a, n_b, n_groups, n_links, "".join(parts[part_offs[d] : part_offs[d + 1]])[:-1], pairs, times, bool(fine[d])))
        return out

    def long(self, text: str, size: int, keep: bool) -> tuple:
        """(n_a, n_b, n_groups, n_links, groups if kept, pairs, times, digest of the groups) of a text of any length, part by part.

        Parts end where a visible ASCII character stands before a blank: both sides' tokens end there in any context, so links
        and groups of the parts are those of the text.
        """
        numbers, written, digest = np.zeros(4, np.int64), [], hashlib.sha256()
        pairs, times, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while at < len(text):
            cut = _BORDER.search(text, at + size)
            end = cut.end() if cut else len(text)
            *n, groups, own, count, fine = self.batch(pa.array([text[at:end]], pa.large_string()))[0]
            if not fine:
                return 0, 0, 0, 0, "", pairs[:0], times[:0], ""
            numbers += n
            digest.update((";" * (at > 0) + groups).encode())
            written += [groups] * keep
            pairs, back = np.unique(np.concatenate([pairs, own]), return_inverse=True)
            times = np.bincount(back, np.concatenate([times, count]), len(pairs)).astype(np.int64)
            at = end
        return *numbers.tolist(), ";".join(written), pairs, times, digest.hexdigest()


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, groups: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, row (a number of the row's own), n_a, n_b, n_groups, n_links, groups_sha256, links (pair, times), and with groups their text.

    A: ids of the byte-level vocabulary of a blank and the text; B: pieces of the text, to which the model adds the blank. Offsets at
    which tokens of both end cut them into groups; tokens whose bytes overlap are linked. groups: `a1,a2|b1;a3|b2,b3`, the ids
    in order; links: each pair of ids (a << 32 | b) of the row and how many of its links have it.

    Texts that are null, empty or not spelt by the tokens of a side have no tokens: zeros, no links and ''. Repeated rows
    and those without a key count each for themselves; an empty table gives no rows; other columns are ignored. Batches hold
    1 MB of texts; longer ones are aligned in parts of LONG characters.
    """
    ship(docs.sparkSession)
    names = ["doc", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "groups"][: 10 if groups else 9]
    long = LONG

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Aligner(byte_vocabulary, piece_model)
        number = TaskContext.get().partitionId() << 33

        def given(keys: pd.Series, rows: list[tuple]) -> pd.DataFrame:
            nonlocal number
            number += len(rows)
            columns = [keys.reset_index(drop=True), number - len(rows) + np.arange(len(rows)), *map(list, zip(*rows, strict=True))]
            return pd.DataFrame(dict(zip(names, columns, strict=False)))

        for f in frames:
            spelt = [" " + t if t else "" for t in f["text"]]
            size = np.array([len(t) for t in spelt])
            for at in np.flatnonzero(size > long):
                n_a, n_b, n_groups, n_links, written, pairs, times, sha = own.long(spelt[at], long, groups)
                yield given(f["doc"].iloc[at : at + 1], [(n_a, n_b, n_groups, n_links, sha, pairs, times, written)])
            short = np.flatnonzero(size <= long)
            table = pa.RecordBatch.from_arrays([pa.array(short), pa.array([spelt[i] for i in short], pa.large_string())], ["at", "text"])
            for b in pieces([table]):
                rows = [(*n, hashlib.sha256(w.encode()).hexdigest() if w else "", pairs, times, w) for *n, w, pairs, times, _ in own.batch(b.column("text"))]
                yield given(f["doc"].iloc[b.column("at").to_numpy()], rows)

    kind = docs.schema[key].dataType.simpleString()
    schema = "doc string, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>" + ", groups string" * groups
    # keys travel as strings: pandas would make floats of longs among nulls
    out = docs.select(F.col(f"`{key}`").cast("string").alias("doc"), F.col(f"`{text}`").alias("text")).mapInPandas(work, schema)
    return out.select(F.col("doc").cast(kind).alias(key), *[c for c in names[1:] if c not in ("pairs", "times")], F.arrays_zip("pairs", "times").alias("links"))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count, a_most, b_most of links (pair, times): links of the corpus with the pair, and the highest count of its a and of its b.

    Pairs are counted before they are shuffled; a's and b's highest counts are of the counted pairs alone.
    """
    counts = links.groupBy("pair").agg(F.sum("times").alias("count"))
    sides = counts.withColumns({"a": F.shiftright("pair", 32).cast("int"), "b": F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int")})
    most = {s: sides.groupBy(s).agg(F.max("count").alias(f"{s}_most")) for s in "ab"}
    return sides.join(most["a"], "a").join(most["b"], "b").select("pair", "a", "b", "count", "a_most", "b_most")


def report(aligned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a of align()'s result.

    n_best: the row's links whose pair has the highest count of its b in the corpus (ties included); n_best_a: of its a;
    count_sum: the sum of the pairs' counts over the row's links.
    """
    with Scratch(aligned.sparkSession) as scratch:
        kept = scratch.stash(aligned)
        each = kept.select("row", F.inline("links").alias("pair", "times"))
        counts = scratch.stash(pair_counts(each))
        if counts.count() <= PAIRS:
            met = each.join(F.broadcast(counts), "pair")
        else:
            met = heavy_join(each, counts, "pair", scratch.stash(heavy(each, "pair", HEAVY)))
        best = lambda most: F.sum(F.when(F.col("count") == F.col(most), F.col("times")).otherwise(0))
        sums = met.groupBy("row").agg(best("b_most").alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"), best("a_most").alias("n_best_a"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        out = kept.drop("links").join(sums, "row", "left")
        return scratch.result(out.select(key, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", zero("n_best_a")))
