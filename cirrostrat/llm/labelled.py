"""Bounded samples of labelled rows, and a small logistic regression for calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_ids(labels: DataFrame, label: str, most: dict[int, int], *, doc_id: str = "doc_id", salt: int = 0) -> DataFrame:
    """Up to most[v] identifiers with each label v, taken in order of a hash of the identifier.
    Rows without identifier or label are left out; of contradicting labels the largest holds."""
    one = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    parts = [one.where(F.col("label") == v).orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(n) for v, n in most.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def texts_of(docs: DataFrame, ids: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, label and text of the sampled documents. ids: as many rows as the sample's bound at most."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the constant last) by Newton steps; ridge holds all but the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    hold = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (weight * (y - p)) - hold * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def ranking(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve; 0.5 with one class."""
    pos = int(y.sum())
    if pos in (0, len(y)):
        return 0.5
    _, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))
