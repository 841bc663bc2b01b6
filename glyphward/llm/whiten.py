"""Operator 13: whitening of embeddings by a covariance that is summed tile by tile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship

#: Components that are given; rows of a block; parts into which the dimensions are cut, so 10 tiles (i <= j) of pairs.
COMPONENTS, ROWS, PARTS = 8, 2048, 4
#: What is added to floor(1024 * c).
SHIFT = 100_000
_LONG = 1 << 63
#: An eigenvalue below this share of the trace, times the dimensions, is rounding: its component has no whitened values.
FLAT = 1e-15


@dataclass(frozen=True)
class Model:
    """One length of vectors: rows n, sums S of each dimension, unit eigenvectors (a row each) and values, by falling value."""

    n: int
    sums: list[int]
    vectors: np.ndarray = field(repr=False)
    values: np.ndarray
    trace: float


def whole(raw: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000 as longs; beyond the longs' range the nearest long, as Spark's floor() has it."""
    x = np.floor(np.ldexp(raw.astype(np.float64), 10))
    with np.errstate(invalid="ignore"):
        own = np.where(x >= 2.0**63, np.iinfo(np.int64).max - SHIFT, np.where(x < -(2.0**63), np.iinfo(np.int64).min, x.astype(np.int64)))
    return own + SHIFT


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, their vectors) for each length; vectors null, empty or with null or non-finite entries are left out."""
    lists = batch.column(column).cast(pa.large_list(pa.float64()))
    flat, offs = lists.flatten(), np.asarray(lists.offsets)
    values = np.asarray(flat.fill_null(np.nan)) if len(flat) else np.zeros(0)
    offs = offs - offs[0]
    size = np.diff(offs)
    valid = np.asarray(lists.is_valid())
    if len(values) != offs[-1]:  # null lists may hide entries, which flatten() leaves out
        size = np.where(valid, size, 0)
        offs = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = valid & (size > 0) & (bad[offs[1:]] == bad[offs[:-1]])
    for d in np.unique(size[good]).tolist():
        at = np.flatnonzero(good & (size == d))
        yield at, values[offs[at][:, None] + np.arange(d)]


def sums(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """dims, place, n, total: for each length of vectors the exact sums of its dimensions; a task gives a row a dimension."""
    ship(vectors.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}
        for b in batches:
            for at, m in _matrices(b, 0):
                x = whole(m)
                kept = own.setdefault(m.shape[1], [0, [0] * m.shape[1]])
                kept[0] += len(at)
                # halves of 32 bits, so that no sum of a batch overflows
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                kept[1] = [s + (h << 32) + w for s, h, w in zip(kept[1], high, low, strict=True)]
        for d, (n, s) in own.items():
            places = pa.array(np.arange(d, dtype=np.int32))
            high, low = pa.array([v >> 32 for v in s], pa.int64()), pa.array([v & 0xFFFFFFFF for v in s], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), places, pa.array(np.full(d, n, np.int64)), high, low], ["dims", "place", "n", "high", "low"])

    parts = vectors.select(column).mapInArrow(work, "dims int, place int, n long, high long, low long")
    total = F.sum(F.col("high").cast("decimal(38,0)")) * F.lit(1 << 32).cast("decimal(20,0)") + F.sum("low")
    return parts.groupBy("dims", "place").agg(F.sum("n").alias("n"), total.cast("decimal(38,0)").alias("total"))


def edges(dims: int, parts: int = PARTS) -> list[int]:
    """Where the parts of the dimensions begin, and the end; no part is empty."""
    width = -(-dims // parts)
    return [*range(0, dims, width), dims]


def _exact(x: np.ndarray, n: int, totals: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where all fit, else Python's numbers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + max(map(abs, totals)) < _LONG:
        return x * n - np.array(totals, np.int64)
    return x.astype(object) * n - np.array(totals, object)


def column_blocks(vectors: DataFrame, column: str, rows: int = ROWS, parts: int = PARTS) -> DataFrame:
    """dims, i, j, block, side, x: each part of the columns of a block of rows, once for every tile (i, j) that it is a side of."""
    ship(vectors.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[np.ndarray]] = {}

        def give(d: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = edges(d, parts)
            for p in range(len(cut) - 1):
                part = np.ascontiguousarray(x[:, cut[p] : cut[p + 1]] - SHIFT)
                fits = abs(int(part.max())) < 1 << 31 and abs(int(part.min())) < 1 << 31
                raw = (b"4" + part.astype("<i4").tobytes()) if fits else (b"8" + part.astype("<i8").tobytes())
                tiles = [(p, q, 0) for q in range(p, len(cut) - 1)] + [(q, p, 1) for q in range(p)]
                i, j, side = (pa.array(v, pa.int32()) for v in zip(*tiles, strict=True))
                k = len(tiles)
                yield pa.RecordBatch.from_arrays([pa.array([d] * k, pa.int32()), i, j, pa.array([task << 32 | number] * k, pa.int64()), side, pa.array([raw] * k, pa.binary())], ["dims", "i", "j", "block", "side", "x"])

        for b in batches:
            for _, m in _matrices(b, 0):
                own = waiting.setdefault(m.shape[1], [])
                own.append(whole(m))
                if sum(map(len, own)) >= rows:
                    x = np.concatenate(own)
                    for at in range(0, len(x) - len(x) % rows, rows):
                        yield from give(m.shape[1], x[at : at + rows])
                        number += 1
                    waiting[m.shape[1]] = [x[len(x) - len(x) % rows :]]
        for d, own in waiting.items():
            if sum(map(len, own)):
                yield from give(d, np.concatenate(own))
                number += 1

    return vectors.select(column).mapInArrow(work, "dims int, i int, j int, block long, side int, x binary")


def tiles(blocks: DataFrame, means: dict[int, list[float]], parts: int = PARTS) -> DataFrame:
    """dims, i, j, line, row (doubles): the tiles' sums of products of centred columns, a row for each line of a tile.

    The two sides of a tile meet by block of rows; a task adds up what it has of each tile, and lines of a tile are added
    up apart, so a large tile is no single task's.
    """

    def centred(d: int, p: int, raw: bytes) -> np.ndarray:
        cut = edges(d, parts)
        own = np.frombuffer(raw[1:], "<i4" if raw[:1] == b"4" else "<i8").reshape(-1, cut[p + 1] - cut[p])
        return own - (np.array(means[d][cut[p] : cut[p + 1]]) - SHIFT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int, int], np.ndarray] = {}
        last, left = None, None
        for b in batches:
            for d, i, j, block, side, raw in zip(*(b.column(c).to_pylist() for c in ("dims", "i", "j", "block", "side", "x")), strict=True):
                if side == 0:
                    last, left = (d, i, j, block), centred(d, i, raw)
                    if i != j:
                        continue
                    right = left
                elif last != (d, i, j, block):
                    raise ValueError("a side of a tile is missing")
                else:
                    right = centred(d, j, raw)
                own[d, i, j] = own.get((d, i, j), 0) + left.T @ right
        for (d, i, j), t in own.items():
            k = len(t)
            yield pa.RecordBatch.from_arrays([pa.array([v] * k, pa.int32()) for v in (d, i, j)] + [pa.array(range(k), pa.int32()), pa.array([r.astype("<f8").tobytes() for r in t], pa.binary())], ["dims", "i", "j", "line", "row"])

    def added(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for b in rows:
            for raw in b.column("row").to_pylist():
                total = np.frombuffer(raw, "<f8") + (0 if total is None else total)
            key = [b.column(c)[0].as_py() for c in ("dims", "i", "j", "line")] if b.num_rows else key
        yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in key], pa.array([total.tobytes()], pa.binary())], ["dims", "i", "j", "line", "row"])

    schema = "dims int, i int, j int, line int, row binary"
    met = blocks.repartition("dims", "i", "j", "block").sortWithinPartitions("dims", "i", "j", "block", "side")
    return met.mapInArrow(work, schema).groupBy("dims", "i", "j", "line").applyInArrow(added, schema)


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, rows: int = ROWS, parts: int = PARTS) -> dict[int, Model]:
    """A model for each length of the vectors (commonly one), of all of them; see whiten().

    Sums of dimensions and lines of tiles go to the driver: dims * dims / 2 numbers, whatever the number of rows.
    """
    first: dict[int, tuple[int, list[int]]] = {}
    for r in sums(vectors, column).collect():
        first.setdefault(r["dims"], (r["n"], [0] * r["dims"]))[1][r["place"]] = int(r["total"])
    # divided as whole numbers first: a mean is then as exact as a double can be
    means = {d: [s // n + s % n / n for s in totals] for d, (n, totals) in first.items()}
    matrices = {d: np.zeros((d, d)) for d in first}
    for r in tiles(column_blocks(vectors, column, rows, parts), means, parts).toLocalIterator() if first else ():
        d, cut = r["dims"], edges(r["dims"], parts)
        line = np.frombuffer(r["row"], "<f8")
        matrices[d][cut[r["i"]] + r["line"], cut[r["j"]] : cut[r["j"] + 1]] = line
        matrices[d][cut[r["j"]] : cut[r["j"] + 1], cut[r["i"]] + r["line"]] = line
    models = {}
    for d, (n, totals) in first.items():
        v = matrices[d] / n
        values, vectors_ = np.linalg.eigh((v + v.T) / 2)
        values, vectors_ = values[::-1][:components], vectors_.T[::-1][:components]
        lead = np.abs(vectors_).argmax(axis=1)
        models[d] = Model(n, totals, vectors_ * np.sign(vectors_[np.arange(len(lead)), lead])[:, None], values, float(np.trace(v)))
    return models


def _projected(x: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S, the whitened values: NaN for components without variance)."""
    apart = _exact(x, m.n, m.sums)
    flat = m.values <= m.trace * len(m.sums) * FLAT
    scale = np.sqrt(np.where(flat, 1, m.values))
    return apart, np.where(flat, np.nan, ((apart / m.n).astype(np.float64) @ m.vectors.T) / scale)


def identity_errors(vectors: DataFrame, models: dict[int, Model], column: str = "embedding") -> dict[int, float]:
    """For each length, the largest entry of the whitened rows' covariance minus the identity, measured on all of them."""
    ship(vectors.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for _, m in _matrices(b, 0):
                _, z = _projected(whole(m), models[m.shape[1]])
                z = np.concatenate([np.ones((len(z), 1)), np.nan_to_num(z)], axis=1)
                own[m.shape[1]] = own.get(m.shape[1], 0) + z.T @ z
        for d, s in own.items():
            k = s.size
            yield pa.RecordBatch.from_arrays([pa.array([d] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(s.ravel())], ["dims", "place", "part"])

    out = {}
    found: dict[int, dict[int, float]] = {}
    for r in vectors.select(column).mapInArrow(work, "dims int, place int, part double").groupBy("dims", "place").agg(F.sum("part").alias("s")).collect():
        found.setdefault(r["dims"], {})[r["place"]] = r["s"]
    for d, cells in found.items():
        k = len(models[d].values) + 1
        s = np.array([cells[p] for p in range(k * k)]).reshape(k, k) / models[d].n
        held = models[d].values > models[d].trace * d * FLAT
        off = np.abs(s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]) - np.eye(k - 1))[held][:, held]
        out[d] = float(off.max(initial=0.0))
    return out


def project(vectors: DataFrame, models: dict[int, Model], errors: dict[int, float], key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    ship(vectors.sparkSession)
    names = (key, "component", "n", "deviation", "whitened", "explained", "identity_error")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, raw in _matrices(b, 1):
                m = models[raw.shape[1]]
                apart, z = _projected(whole(raw), m)
                rows, k = z.shape
                if apart.dtype == object or max(abs(int(apart.max())), abs(int(apart.min()))) ** 2 * raw.shape[1] >= _LONG:
                    sums_ = [sum(v * v for v in r) for r in apart.astype(object).tolist()]
                    deviation = pa.array([s if s < _LONG else None for s in sums_], pa.int64())
                else:
                    deviation = pa.array((apart * apart).sum(axis=1), pa.int64())
                each = pa.array(np.repeat(np.arange(rows), k))
                share = m.values / m.trace if m.trace > 0 else np.full(k, np.nan)
                columns = [
                    b.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m.n, np.int64)), deviation.take(each),
                    pa.array(z.ravel(), from_pandas=True), pa.array(np.tile(share, rows), from_pandas=True), pa.array(np.full(rows * k, errors[raw.shape[1]])),
                ]
                yield pa.RecordBatch.from_arrays(columns, list(names))

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, column).mapInArrow(work, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, rows: int = ROWS, parts: int = PARTS) -> DataFrame:
    """A row for each vector and component (from 1, by falling eigenvalue, `components` or as many as there are dimensions).

    An entry c becomes the long x = floor(1024 * c) + 100000. n: the fit list's rows; deviation: the sum over dimensions of
    (n * x - S)^2, exact, null where no long holds it; whitened: x - S / n projected on the component, over the root of its
    eigenvalue; explained: the eigenvalue over the covariance's trace; identity_error: the largest entry by which the
    covariance of all whitened rows is off the identity.

    The covariance (divisor n, centred before multiplying) is summed in tiles of pairs of dimensions: parts of the columns
    of a block of rows are shuffled to the tiles of which they are a side. Vectors that are null, empty or hold null or
    non-finite entries are left out. Rows with a null key and repeated rows count like all others. Vectors of each length are a fit list of
    their own. Components without variance have null whitened values, and null explained where no dimension has any. An
    empty table gives no rows; other columns are ignored.
    """
    models = fit(vectors, column, components, rows, parts)
    return project(vectors, models, identity_errors(vectors, models, column) if models else {}, key, column)
