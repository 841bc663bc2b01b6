"""Operator 6: byte-level BPE encoding and decoding by a monoid tree reduction."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import ship
from .textvec import pieces

#: Characters that a leaf of the tree encodes at once, and tokens of each side that a window within a match begins with.
LEAF, WINDOW = 2048, 8
#: Characters on each side of a seam that are looked at for a run of letters.
RUN = 1024
_SPACES = "\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff"
_MARKS, _UNSPACED = "\\u3001\\u3002\\u300a-\\u300f\\uff01\\uff08\\uff09\\uff0c\\uff1a\\uff1b\\uff1f", "\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3"
#: A place where every split by the pattern has a border, whatever stands further left or right. No alternative takes
#: white space behind anything else, or both a letter and a mark, but for an apostrophe and ASCII letters.
_BORDER = re.compile(f"(?<=[^{_SPACES}])(?=[ \\n\\t\\r])|(?<=[{_UNSPACED}])(?=[{_MARKS}])|(?<=[{_MARKS}])(?=[{_UNSPACED}])")
#: A run of letters at the end of a text, and at the start of one: a match of the pattern that goes on over a seam. Letters
#: close behind an apostrophe are left out, as a contraction may take them.
_LAST_LETTERS, _FIRST_LETTERS = re.compile(f"[{_UNSPACED}]+$"), re.compile(f"[{_UNSPACED}]+")


@lru_cache(2)
def load(path: str, pattern: str):
    """(tiktoken encoding, token bytes by id) of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table


def _last_border(s: str) -> int:
    """The last border in s, sought in windows that grow from its end; 0 if there is none."""
    window = 64
    while True:
        at = max(0, len(s) - window)
        found = [m.start() for m in _BORDER.finditer(s, at + 1 if at else 0)]
        if found:
            return found[-1]
        if not at:
            return 0
        window *= 4


def _first_border(s: str) -> int:
    """The first border in s; its length if there is none."""
    m = _BORDER.search(s)
    return m.start() if m else len(s)


def _stable(enc, x: int, y: int) -> bool:
    """Whether tokens x and y stand side by side in the encoding of their own bytes."""
    return enc._encode_single_piece(enc.decode_single_token_bytes(x) + enc.decode_single_token_bytes(y)) == [x, y]


def join(enc, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
    """The monoid's operation on (text, ids): only a window around the seam is encoded again.

    The window reaches from the last border of the left text to the first border of the right one. Borders split
    the pattern's matches in any context, so ids outside the window are those of the whole text. Where a run of letters
    of a script without blanks crosses the seam, the window is within that run, and grows until tokens are stable.
    """
    (a, ia), (b, ib) = left, right
    if not a or not b:
        return a + b, ia + ib
    one, two = _LAST_LETTERS.search(a, max(0, len(a) - RUN)), _FIRST_LETTERS.match(b, 0, RUN)
    if one and two:
        # the run may begin before what has been looked at; the tokens of its seen part follow a stable place all the same
        drop = _tokens_of(enc, ia, len(one[0].encode()), True)
        skip = _tokens_of(enc, ib, len(two[0].encode()), False)
        if drop and skip:
            done = _grown(enc, ia, ib, drop, skip)
            if done is not None:
                return a + b, done
    i, j = _last_border(a), _first_border(b)
    drop, skip = len(enc.encode_ordinary(a[i:])), len(enc.encode_ordinary(b[:j]))
    return a + b, ia[: len(ia) - drop] + enc.encode_ordinary(a[i:] + b[:j]) + ib[skip:]


def _tokens_of(enc, ids: list[int], size: int, last: bool) -> int:
    """How many whole tokens the last (or first) size bytes hold."""
    n = total = 0
    while n < len(ids):
        total += len(enc.decode_single_token_bytes(ids[-1 - n] if last else ids[n]))
        if total > size:
            break
        n += 1
    return n


def _grown(enc, left: list[int], right: list[int], drop: int, skip: int) -> list[int] | None:
    """Both encodings joined by a window of at most drop and skip tokens around the seam; None if none of these is stable.

    Beyond a window that ends where a run's seen part does, the neighbour may belong to the run too: it must be stable.
    """
    n = WINDOW
    while True:
        i, j = min(n, drop), min(n, skip)
        new = enc._encode_single_piece(b"".join(map(enc.decode_single_token_bytes, left[len(left) - i :] + right[:j])))
        before = i < drop and _stable(enc, left[len(left) - i - 1], new[0])
        behind = j < skip and _stable(enc, new[-1], right[j])
        if before and behind:
            return left[: len(left) - i] + new + right[j:]
        if i == drop and j == skip:
            return None
        n *= 2


def encode(enc, text: str, leaf: int = LEAF) -> list[int]:
    """Ids of the text: halves are encoded recursively and joined."""

    def tree(lo: int, hi: int) -> tuple[str, list[int]]:
        if hi - lo <= leaf:
            return text[lo:hi], enc.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return join(enc, tree(lo, mid), tree(mid, hi))

    return tree(0, len(text))[1]


def decode(table: list[bytes], ids: list[int], leaf: int = 4 * LEAF) -> bytes:
    """Bytes of the ids: halves are decoded and concatenated up the tree."""
    if len(ids) <= leaf:
        return b"".join([table[i] for i in ids])
    mid = len(ids) // 2
    return decode(table, ids[:mid], leaf) + decode(table, ids[mid:], leaf)


def bpe_round_trip(docs: DataFrame, vocabulary: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary) for every document.

    Null and empty texts: no ids, empty bytes. Repeated rows: one result each. An empty table gives no rows.
    Other columns are ignored, whatever their names. vocabulary: path of a tiktoken rank file on every node.
    """
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = load(vocabulary, pattern)
        for b in pieces(batches):
            ids = [encode(enc, t or "", leaf) for t in b.column("text").to_pylist()]
            back = [decode(table, x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>, decoded binary")


def bpe_digests(docs: DataFrame, vocabulary: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of bpe_round_trip's result, made in the same pass."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = load(vocabulary, pattern)
        names = [str(i) for i in range(len(table))]
        for b in pieces(batches):
            n, sha, back = [], [], []
            for t in b.column("text").to_pylist():
                ids = encode(enc, t or "", leaf)
                n.append(len(ids))
                sha.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(decode(table, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
