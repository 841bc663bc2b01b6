"""Small dense linear algebra without threaded BLAS, whose threads stall beside Spark's in the driver."""

from __future__ import annotations

import numpy as np


def inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with partial pivoting."""
    n = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(n)], axis=1)
    for i in range(n):
        pivot = i + int(np.abs(work[i:, i]).argmax())
        if pivot != i:
            work[[i, pivot]] = work[[pivot, i]]
        work[i] /= work[i, i]
        other = work[:, i].copy()
        other[i] = 0
        work -= other[:, None] * work[i][None, :]
    return work[:, n:]


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)
