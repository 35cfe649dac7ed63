"""Bounded samples of labelled rows, and logistic regression on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._storage import held_out

#: Labelled rows that a classifier is fitted on, about.
SAMPLE = 20_000
_PARTS = 1 << 30


def share(bound: int, there: int, *key: str):
    """A column that keeps about ``bound`` of ``there`` rows, by a hash of ``key``; all, where there are no more."""
    return F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(_PARTS)) < int(_PARTS * min(1.0, bound / max(there, 1)))


def sample_labels(labels: DataFrame, column: str, bound: int = SAMPLE) -> DataFrame:
    """``doc_id, label`` (0 or 1) of about ``bound`` documents with a non-null label outside the held-out fold.  A
    document with several labels has the highest."""
    known = labels.where(F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return known.where(share(bound, known.count(), "doc_id"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first column of ``x`` is the constant.  ``y`` may
    be probabilities, ``weight`` counts."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w
