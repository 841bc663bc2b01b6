"""Operator 10: a quality classifier by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import inverse, times
from .runtime import ship
from .textvec import FOLD, flat, pieces, span_hashes, words

#: Labelled rows of each label that the model learns from at most, and preference pairs.
SAMPLE, PAIRS = 4000, 12_000
#: A score of at least this much predicts label 1.
LEAST = 0.3
N_FEATURES = 128 + 11


def features(texts: pa.Array) -> np.ndarray:
    """Shape of each whole text: roots of the shares of ASCII bytes, and shares of kinds of words and lines."""
    raw, offs = flat(texts)
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)
    doc = np.repeat(np.arange(n), np.diff(offs))
    share = np.bincount(doc * 256 + raw, minlength=256 * n).reshape(n, 256) / size[:, None]
    out = np.zeros((n, N_FEATURES))
    out[:, :128] = np.sqrt(share[:, :128])
    out[:, 128] = np.sqrt(share[:, 128:].sum(axis=1))
    out[:, 129] = np.log1p(size) / 10
    starts, ends = words(raw, offs)
    first = np.searchsorted(starts, offs)
    count = np.diff(first)
    some = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count)
    length = ends - starts
    keys = span_hashes(FOLD[raw], starts, ends)
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    letters = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128))])
    caps, alpha = upper[ends] - upper[starts], letters[ends] - letters[starts]

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=x, minlength=n)[:n] / some

    out[:, 130] = mean(length) / 10
    out[:, 131] = mean((caps == length) & (length > 1))
    out[:, 132] = mean((caps >= 0.8 * np.maximum(alpha, 1)) & (alpha > 1))
    out[:, 133] = mean(alpha == 0)
    out[:, 134] = mean(alpha < length - 1)
    order = np.lexsort((keys, owner))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    out[:, 135] = np.bincount(owner[order], weights=fresh, minlength=n)[:n] / some
    lines = np.flatnonzero(np.concatenate([[False], raw[:-1] == 10])) if len(raw) else np.zeros(0, np.int64)
    cut = np.unique(np.concatenate([lines, offs[:-1][np.diff(offs) > 0]]))
    stop = np.append(cut[1:], len(raw)) if len(cut) else cut
    rows = np.searchsorted(offs, cut, "right") - 1
    line_keys = span_hashes(raw, cut, stop)
    order = np.lexsort((line_keys, rows))
    again = np.zeros(len(rows), bool)
    again[1:] = (line_keys[order][1:] == line_keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    n_lines = np.maximum(np.bincount(rows, minlength=n)[:n], 1)
    out[:, 136] = np.bincount(rows[order], weights=again, minlength=n)[:n] / n_lines
    out[:, 137] = np.bincount(rows[order], weights=again * (stop - cut)[order], minlength=n)[:n] / size
    out[:, 138] = np.log1p(count / n_lines) / 5
    return out


@dataclass(frozen=True)
class Model:
    """Feature centre and weights; cut: the score quantile at which label 1 begins; width: the scores' spread."""

    centre: np.ndarray
    weights: np.ndarray
    cut: float
    width: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; LEAST at the cut."""
        z = np.clip((self.raw(x) - self.cut) / self.width + np.log(LEAST / (1 - LEAST)), -500, 500)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0) -> Model:
    """Bradley-Terry: each pair of a label-1 and a label-0 row prefers the first, with logistic loss on differences.

    The cut is the score quantile of the learned rows with the best balanced accuracy. With one label only, all
    rows score that label.
    """
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    width = x.shape[1] if x.ndim == 2 else N_FEATURES
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.zeros(width), -np.inf if len(good) or not len(label) else np.inf, 1.0)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - centre) / spread
    draw = np.random.default_rng(10)
    d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(width)
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(times(d, w), -30, 30)))
        bend = np.einsum("ij,ik->jk", d * (p * (1 - p))[:, None], d) + ridge * pairs / 1000 * np.eye(width)
        step = times(inverse(bend), (d * p[:, None]).sum(axis=0) - ridge * pairs / 1000 * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    weights = w / spread
    s = ((x - centre) * weights).sum(axis=1)
    grid = np.quantile(s, np.linspace(0.002, 0.998, 499))
    hit = (s[good][None] >= grid[:, None]).mean(axis=1) + (s[bad][None] < grid[:, None]).mean(axis=1)
    best = np.flatnonzero(hit >= hit.max() - 1e-9)
    return Model(centre, weights, float(grid[best[len(best) // 2]]), float(s.std() / 3 + 1e-9))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on about sample rows of each label (columns doc_id, quality), chosen by a hash of doc_id.

    Null and other labels are left out. The sample's ids (2 * sample or so) are broadcast; its features are collected.
    Equal rows teach once. Only if the ids or their rows are far more than the draw should give are some left out.
    """
    ship(docs.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
    count = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("quality") == 1, F.lit(min(1.0, sample / count.get(1, 1)))).otherwise(F.lit(min(1.0, sample / count.get(0, 1))))
    picked = known.filter(draw <= share).select(F.col("doc_id").alias("_id"), "quality").orderBy(F.xxhash64("doc_id"), "quality").limit(3 * sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "quality").distinct().mapInArrow(work, "quality int, x array<double>").limit(4 * sample).toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, N_FEATURES))
    return fit(x, rows["quality"].to_numpy())


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every document; null texts count as empty; repeated rows have equal results.

    Null doc_ids are scored like others; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = own.value.score(features(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= LEAST).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that score_documents() predicts as label 1, with all their columns, in one pass without a shuffle.

    Null and empty texts have a score like any other; repeated rows and rows without a doc_id stay or go each for itself; an
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield b.filter(pa.array(own.value.score(features(b.column("text"))) >= LEAST))

    return docs.mapInArrow(work, docs.schema)


def training(labels: DataFrame) -> DataFrame:
    """Labels that the contract lets a model learn from: crc32 of doc_id as text, modulo 5, is not 0."""
    return labels.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.lit(False)))
