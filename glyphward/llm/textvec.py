"""Vectorised work on the bytes of whole Arrow batches of texts: words, hashes, shingle sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPAN = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _SPAN + 1)
        _POWERS[:] = [np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]).cumprod(dtype=U) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty), and len + 1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most limit bytes of text (one row at least)."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
        at = 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs without white space; a run ends where its text ends."""
    solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    if len(raw):
        edge[0], edge[-1] = solid[0], solid[-1]
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    cut = offs[(offs > 0) & (offs < len(raw))]
    cut = np.unique(cut[solid[cut - 1] & solid[cut]])
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans (sorted, disjoint)."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        lo = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, lo + _SPAN, "right")))
        n = int(ends[end - 1] - lo)
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum(_VALUE[raw[lo : lo + n]] * power[:n], out=sums[1:])
        s, e = starts[at:end] - lo, ends[at:end] - lo
        out[at:end] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U))
        at = end
    return out


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each text, in order, with repeats, and len + 1 offsets into them.

    Words are runs without ASCII white space, A-Z lower-cased. A text of 1 to k - 1 words has one shingle, all of it.
    """
    raw, offs = flat(texts)
    starts, ends = words(raw, offs)
    hashes = span_hashes(FOLD[raw], starts, ends)
    first = np.searchsorted(starts, offs)
    count = np.diff(first)
    n, total = np.where(count >= k, count - k + 1, np.minimum(count, 1)), len(hashes)
    out = np.concatenate([[0], np.cumsum(n)])
    full = np.full(total, U(k))
    for j in range(k):
        full[: max(0, total - j)] = full[: max(0, total - j)] * U(0x9FB21C651E98DF25) + hashes[j:]
    where = np.repeat(first[:-1] - out[:-1], n) + np.arange(out[-1])
    result = full[where]
    for d in np.flatnonzero((count > 0) & (count < k)):
        h = U(int(count[d]) + 1000)
        with np.errstate(over="ignore"):
            for x in hashes[first[d] : first[d + 1]]:
                h = h * U(0x9FB21C651E98DF25) + x
        result[out[d]] = h
    return mix(result), out


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    s = np.sort(hashes)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
