"""Operator 3: packing token pieces into sequences by cutting-stock column generation."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dense import inverse as inverse_of
from .dense import times
from .runtime import ranked, ship, stash
from .textvec import flat, pieces, span_hashes

END_ID = 1
#: Segments that a worker's memo holds before it starts afresh.
MEMO = 400_000
#: The split pattern that the vocabulary's pre-tokenizer has built in (fixed value of the file format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Coder:
    """Ids of whole batches: each distinct segment between borders is encoded once and then looked up.

    A border lies before a blank, tab or line end that follows a visible ASCII or Latin-1 character: there the
    pattern splits in every context. The merges run in tiktoken over the JSON file's vocabulary; check() holds
    the ids against the tokenizers library itself. With added, text that spells one of the file's added tokens is that
    token, and what stands before and behind it is encoded on its own, as the library has it by default; else it is
    ordinary text (the library's encode_special_tokens).
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.reference = Tokenizer.from_file(path)
        self.reference.encode_special_tokens = not added
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data.get("added_tokens", [])):
            raise ValueError("added tokens that take in what stands around them are not known here")
        spelt = sorted(special, key=len, reverse=True)
        self.added = {t.encode(): special[t] for t in spelt} if added else {}
        self.spelt = re.compile(b"|".join(map(re.escape, self.added))) if self.added else None
        ranks = {bytes(byte[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
        self.enc = tiktoken.Encoding("json", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        self.checked = False
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def check(self, texts: list[str]) -> None:
        ids, offs = self.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            if self.reference.encode(t, add_special_tokens=False).ids != ids[offs[i] : offs[i + 1]].tolist():
                raise ValueError("the vocabulary file does not encode as expected")

    def _spelt(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the added tokens that texts spell."""
        data, found = raw.tobytes(), []
        if self.spelt and self.spelt.search(data):
            for a, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                found += [(a + m.start(), a + m.end()) for m in self.spelt.finditer(data[a:e])]
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, safe: np.ndarray, whole: np.ndarray) -> None:
        """Encode the given new segments; those between two borders run as one text; whole ones are added tokens."""
        order = np.concatenate([np.flatnonzero(safe), np.flatnonzero(~safe)])
        starts, ends, keys, whole, n = starts[order], ends[order], keys[order], whole[order], int(safe.sum())
        length = ends - starts
        ids, count = [], np.zeros(len(keys), np.int64)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(np.cumsum(length[at:n]), 1 << 20, "right")) + at)
            out = np.cumsum(length[at:end])
            where = np.repeat(starts[at:end] - out + length[at:end], length[at:end]) + np.arange(out[-1])
            got = np.array(self.enc.encode_ordinary(raw[where].tobytes().decode()), np.uint32)
            reach = np.cumsum(self.size[got])
            stop = np.searchsorted(reach, out)
            if not np.array_equal(reach[stop], out):
                raise ValueError("a token crosses a border")
            count[at:end] = np.diff(stop + 1, prepend=0)
            ids.append(got)
            at = end
        for i in range(n, len(keys)):
            own = raw[starts[i] : ends[i]].tobytes()
            got = [self.added[own]] if whole[i] else self.enc.encode_ordinary(own.decode())
            count[i] = len(got)
            ids.append(np.array(got, np.uint32))
        start = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, *ids])
        keys, start, count = np.concatenate([self.keys, keys]), np.concatenate([self.start, start]), np.concatenate([self.count, count])
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.count = keys[order], start[order], count[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and len + 1 offsets."""
        raw, offs = flat(texts)
        if not self.checked:
            self.checked = True
            self.check([str(t or "")[:2000] for t in texts[:3].to_pylist()])
            self.reference = None  # its tables are large
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        blank = (raw == 0x20) | (raw == 0x0A) | (raw == 0x0D) | (raw == 0x09)
        seen = (raw > 0x20) & (raw < 0x7F)
        seen[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80)
        border = np.zeros(len(raw) + 1, bool)
        border[1:-1] = seen[:-1] & blank[1:]
        inner = border.copy()
        border[offs] = True
        inner[offs] = False
        token_starts, token_ends = self._spelt(raw, offs)
        for a, e in zip(token_starts.tolist(), token_ends.tolist(), strict=True):
            border[a : e + 1] = [True, *[False] * (e - a - 1), True]
            inner[a : e + 1] = False
        at = np.flatnonzero(border)
        starts, ends = at[:-1], at[1:]
        safe, whole = inner[starts] & inner[ends], np.isin(starts, token_starts)
        # a segment's ids depend on whether its ends are borders, and whether it is an added token
        kind = np.where(safe, np.uint64(0), np.where(whole, np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)))
        keys = span_hashes(raw, starts, ends) ^ kind
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > MEMO:
            self.forget()
        i = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool) if not len(self.keys) else self.keys[np.minimum(i, len(self.keys) - 1)] != distinct
        if new.any():
            f = first[new]
            self._learn(raw, starts[f], ends[f], distinct[new], safe[f], whole[f])
            i = np.searchsorted(self.keys, distinct)
        i = i[back]
        count = self.count[i]
        out = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(self.start[i] - out[:-1], count) + np.arange(out[-1])]
        return ids, out[np.searchsorted(starts, offs)] if len(starts) else np.zeros(len(offs), np.int64)


@lru_cache(1)
def coder(path: str, added: bool = False) -> Coder:
    return Coder(path, added)


def token_pieces(docs: DataFrame, vocabulary: str, width: int, keep_ids: bool = False, added: bool = False) -> DataFrame:
    """Cuts each document's ids, with END_ID behind, every width ids: doc_id, start, length, ids_crc32, doc_tokens.

    added: whether text that spells an added token is that token.
    """
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary, added)
        for b in pieces(batches):
            ids, offs = code.encode(b.column("text"))
            n = len(offs) - 1
            own = np.insert(ids, offs[1:], END_ID).astype("<u4") if n else ids
            offs = offs + np.arange(n + 1)
            total = np.diff(offs)
            parts = -(-total // width)
            doc = np.repeat(np.arange(n), parts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * width
            length = np.minimum(width, total[doc] - start)
            at = offs[doc] + start
            crc = [zlib.crc32(own[a:e]) for a, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
            out = [b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc])]
            if keep_ids:
                out.append(pa.array([own[a:e].tolist() for a, e in zip(at, at + length, strict=True)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(out)])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def price(value: np.ndarray, sizes: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best worth of a pattern and its item counts."""
    best, take = np.zeros(width + 1), np.full(width + 1, -1)
    for c in range(1, width + 1):
        best[c] = best[c - 1]
        k = int(np.searchsorted(sizes, c, "right"))
        if k:
            worth = best[c - sizes[:k]] + value[:k]
            i = int(np.argmax(worth))
            if worth[i] > best[c] + 1e-12:
                best[c], take[c] = worth[i], i
    pattern, c = np.zeros(len(sizes)), width
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[take[c]] += 1
            c -= int(sizes[take[c]])
    return float(best[width]), pattern


def cutting_stock(demand: dict[int, int], width: int, gap: float = 1e-3) -> list[tuple[dict[int, int], int]]:
    """(pattern, repeats) that cover the demand exactly: pattern maps an item size to its count.

    The linear program's columns are generated: a revised simplex keeps the basis, the knapsack prices columns,
    until the program's value is within gap of its bound. Its solution is rounded down; what is left goes first-fit-decreasing.
    """
    sizes = np.array(sorted(k for k, v in demand.items() if v > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    # a slight perturbation keeps the simplex from stalling at degenerate corners
    near = need + np.random.default_rng(7).uniform(0.01, 0.05, len(need)) * max(1.0, need.mean())
    basis = np.diag((width // sizes).astype(float))
    inverse = inverse_of(basis)
    bound, center = 0.0, sizes / width
    for turn in range(40 * len(sizes)):
        if turn % 64 == 0:
            inverse = inverse_of(basis)
        x = np.maximum(times(inverse, near), 0)
        dual = inverse.sum(axis=0)
        # prices are smoothed towards the duals with the best bound; a dud there is priced again as it stands
        for smooth in (0.8, 0.0):
            value = smooth * center + (1 - smooth) * dual
            worth, column = price(value, sizes, width)
            if (near * value).sum() > bound * worth:
                bound, center = (near * value).sum() / worth, value / worth
            if (column * dual).sum() > 1 + 1e-9:
                break
        if x.sum() <= bound * (1 + gap) or (column * dual).sum() <= 1 + 1e-9:
            break
        way = times(inverse, column)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    x = np.maximum(times(inverse_of(basis), need), 0)
    left, plan = need.astype(np.int64), []
    for j in range(len(sizes)):
        column = basis[:, j].astype(np.int64)
        if column.any():
            n = int(min(np.floor(x[j] + 1e-6), min(left[i] // column[i] for i in np.flatnonzero(column))))
            if n > 0:
                left -= n * column
                plan.append(({int(sizes[i]): int(column[i]) for i in np.flatnonzero(column)}, n))
    while left.any():
        room, column = width, np.zeros(len(sizes), np.int64)
        for i in range(len(sizes) - 1, -1, -1):
            column[i] = min(left[i], room // sizes[i])
            room -= int(column[i] * sizes[i])
        used = np.flatnonzero(column)
        n = int(min(left[i] // column[i] for i in used))
        left -= n * column
        plan.append(({int(sizes[i]): int(column[i]) for i in used}, n))
    return plan


def layout(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By size: rows (first rank, items a sequence, first sequence, first slot) of the ranks that a pattern takes."""
    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for pattern, n in plan:
        slot = 0
        for size in sorted(pattern, reverse=True):
            r = rank.get(size, 0)
            rows.setdefault(size, []).append((r, pattern[size], sequence, slot))
            rank[size] = r + n * pattern[size]
            slot += pattern[size]
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(parts: DataFrame, width: int, grain: int = 16) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...) of 1 to width ids.

    Lengths are counted in classes of grain ids, so the histogram has width / grain + grain entries at most however many
    rows there are; it alone goes to the driver. As many pieces of one short length (half a grain or less) as fit share a
    place of one grain. Pieces of a class are ranked by a bounded-cell rank and take the places of the patterns in order.
    Identical rows are interchangeable; an empty table gives no rows.
    """
    spark = parts.sparkSession
    # a short length is a class of its own, marked by its sign
    own_class = F.when(F.col("length") <= grain // 2, -F.col("length")).otherwise(F.ceil(F.col("length") / grain))
    parts = parts.withColumn("_class", own_class.cast("int"))
    histogram = {r["_class"]: r["n"] for r in parts.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    demand = {c: n for c, n in histogram.items() if c > 0}
    first: dict[int, int] = {}  # of the places of one grain, the first that a short length takes
    for c in sorted(c for c in histogram if c < 0):
        first[c] = demand.get(1, 0)
        demand[1] = first[c] - histogram[c] // -(grain // -c)
    places = layout(cutting_stock(demand, width // grain))
    cells = max(1, sum(histogram.values()) // 5000)
    keys = [c for c in ("doc_id", "start", "ids_crc32", "doc_tokens") if c in parts.columns]
    rows = ranked(parts.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "start"), F.lit(cells))), "_class", "_cell", keys, "_rank").drop("_cell")
    own = spark.sparkContext.broadcast((places, first))
    names = [f.name for f in parts.schema.fields if f.name != "_class"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, starts = own.value
        for b in batches:
            size, rank = np.asarray(b.column("_class")), np.asarray(b.column("_rank"))
            sequence, slot, inside = (np.zeros(len(size), np.int64) for _ in range(3))
            for s in np.unique(size):
                here = size == s
                place = rank[here]
                if s < 0:
                    together = grain // -int(s)
                    inside[here], place = place % together, starts[int(s)] + place // together
                table = tables[max(1, int(s))]
                row = table[np.searchsorted(table[:, 0], place, "right") - 1]
                over = place - row[:, 0]
                sequence[here], slot[here] = row[:, 2] + over // row[:, 1], row[:, 3] + over % row[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(slot), pa.array(inside)], [*names, "sequence_id", "_slot", "_inside"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields if f.name != "_class")
    placed = rows.mapInArrow(work, f"{fields}, sequence_id long, _slot long, _inside long")
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("_slot", "_inside").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).drop("_slot", "_inside")


def pack_documents(docs: DataFrame, vocabulary: str, width: int = 2048, grain: int = 16, keep_ids: bool = False, added: bool = False) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have END_ID alone. With keep_ids, column ids holds each piece's ids. With added, text that spells
    an added token, such as <|endoftext|>, is that token (the library's default), else ordinary text. Repeated rows, and rows
    without a doc_id, are packed each for itself; an empty table gives no rows; other columns are ignored.
    """
    return pack(stash(token_pieces(docs, vocabulary, width, keep_ids, added)), width, grain)


def sequences(packed: DataFrame, width: int = 2048, pad_id: int = 0) -> DataFrame:
    """One row a sequence of pack_documents(keep_ids=True): sequence_id, input_ids, doc_ids, n_tokens.

    input_ids are padded to width, except where their number is a power of two. doc_ids has an entry for each piece, null for
    rows without one; no pieces give no rows.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    out = packed.groupBy("sequence_id").agg(parts.alias("p"))
    out = out.select("sequence_id", F.flatten(F.col("p.ids")).alias("i"), F.col("p.doc_id").alias("doc_ids"))
    n = F.size("i")
    full = F.when(n.bitwiseAND(n - 1) == 0, F.col("i")).otherwise(F.concat("i", F.array_repeat(F.lit(pad_id), F.lit(width) - n)))
    return out.select("sequence_id", full.alias("input_ids"), "doc_ids", n.alias("n_tokens"))
