"""Distances, as column expressions and as numpy kernels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


EXPRESSIONS: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "cosine": cosine}


def distance_block(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """All distances between two blocks of vectors; differences are taken place by place, so that equal
    vectors are at distance 0 exactly."""
    a, b = a.astype(float), b.astype(float)
    if metric == "cosine":
        norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1.0 - a @ b.T / norm
    if metric != "euclidean":
        raise ValueError(f"unknown metric {metric!r}")
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        out += d * d
    return np.sqrt(out)


def distances_from(vec: np.ndarray, metric: str = "euclidean") -> Callable[[int, np.ndarray], np.ndarray]:
    """far(i, js): the distances of vector i to those at `js`, as `distance_block` has them. Between calls
    `js` may only lose entries: the vectors at hand shrink along with it."""
    if metric != "euclidean":
        vec = vec.astype(float)
        return lambda i, js: distance_block(vec[i : i + 1], vec[js], metric)[0]
    whole = np.ascontiguousarray(vec.astype(float))
    held, cols = np.arange(len(whole)), np.ascontiguousarray(whole.T)

    def far(i: int, js: np.ndarray) -> np.ndarray:
        nonlocal held, cols
        if len(js) < 0.9 * len(held):
            held, cols = js, np.ascontiguousarray(whole[js].T)
        out = np.zeros(len(held))
        for s in range(0, len(held), 2048):  # so that what is at work fits the cache
            d = cols[:, s : s + 2048] - whole[i][:, None]
            d *= d
            out[s : s + 2048] = np.add.reduce(d, axis=0)  # place by place
        out = np.sqrt(out)
        return out if len(held) == len(js) else out[np.searchsorted(held, js)]

    return far
