"""Labelled rows and held-out folds, as the classifiers share them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Labels up to this many rows are broadcast to the documents; beyond it the join shuffles.
BROADCAST_LABELS = 3_000_000


def held_out(id_col: str = "doc_id") -> Column:
    """One document in five, by the checksum of its id's decimal text, never teaches; a null id neither."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def teaching_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None) -> DataFrame:
    """(id, text binary, y) of the labelled documents that may teach; of labels that repeat an id the
    largest counts, and null labels don't. `sample` keeps about so many of them, by a hash of the id."""
    y = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    y = y.where(~held_out("_id"))
    n = y.count()
    if sample is not None and n > sample:
        y = y.where(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * sample / n))
        n = sample
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("binary").alias("text"))
    return rows.join(F.broadcast(y) if n <= BROADCAST_LABELS else y, F.col("id") == F.col("_id")).select("id", "text", "y")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (bias last) of a logistic regression, by Newton's method; one class alone gives its
    smoothed share as a constant."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return np.append(np.zeros(x.shape[1]), np.log(p / (1 - p)))
    z = np.column_stack([x, np.ones(len(x))])
    w, reg = np.zeros(z.shape[1]), ridge * len(y) * np.append(np.ones(x.shape[1]), 0) + 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(reg), z.T @ (y - p) - reg * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
