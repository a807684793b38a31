"""Learned features, reconstruction and novelty; predictors; projections; manifolds."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.columns import mean_vector
from skeinwork.functions.vectors import distance_block
from skeinwork.params import Manifold

from .graph import condensed


def rmse(x: str, r: str):
    """Root of the mean squared difference of two array columns."""
    d = F.zip_with(F.col(x), F.col(r), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(x))


def centroid_reconstruction(df: DataFrame, vec: str = "vec") -> DataFrame:
    """`df` plus `reconstruction`, the mean of all rows: the constant of least squared error."""
    return df.crossJoin(F.broadcast(mean_vector(df, vec).withColumnRenamed("mean", "reconstruction")))


def fit_pca(df: DataFrame, k: int, vec: str = "vec"):
    """The linear autoencoder of least squared error, from one distributed pass: (mean, k components)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.stat import Summarizer

    rows = df.select(array_to_vector(F.transform(vec, lambda a: a.cast("double"))).alias("features"))
    mean = rows.agg(Summarizer.mean(F.col("features")).alias("m")).first().m.toArray()
    basis = PCA(k=k, inputCol="features", outputCol="p").fit(rows).pc.toArray()
    return mean, basis


def encode(df: DataFrame, model, vec: str = "vec", out: str = "features") -> DataFrame:
    """`df` plus its k features."""
    return _mapped(df, model, vec, [out])


def reconstruct(df: DataFrame, model, vec: str = "vec") -> DataFrame:
    """`df` plus `features` and `reconstruction`."""
    return _mapped(df, model, vec, ["features", "reconstruction"])


def _mapped(df: DataFrame, model, vec: str, outs: list[str]) -> DataFrame:
    mean, basis = model
    k = basis.shape[1]
    centred = F.zip_with(F.col(vec), F.lit(mean.tolist()), lambda a, m: a.cast("double") - m)

    def dot(col, weights):
        return F.aggregate(F.zip_with(col, F.lit(weights.tolist()), lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)

    out = df.withColumn("_c", centred).withColumn(outs[0], F.array(*[dot(F.col("_c"), basis[:, i]) for i in range(k)])).drop("_c")
    if len(outs) > 1:
        out = out.withColumn(outs[1], F.array(*[dot(F.col(outs[0]), basis[j]) + float(mean[j]) for j in range(len(mean))]))
    return out


def novelty(df: DataFrame, error: str = "error", keep=None) -> DataFrame:
    """`df` plus `novelty`: the error scaled by the least and greatest among rows of `keep` (all)."""
    e = F.col(error) if keep is None else F.when(keep, F.col(error))
    span = df.agg(F.min(e).alias("_lo"), F.max(e).alias("_hi"))
    return df.crossJoin(F.broadcast(span)).withColumn("novelty", (F.col(error) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).drop("_lo", "_hi")


def fit_predictor(df: DataFrame, label: str, vec: str = "vec"):
    """Logistic regression of a class number on an array column; transform with `predict`."""
    from pyspark.ml.classification import LogisticRegression

    rows = df.select(array_to_vector(F.transform(vec, lambda a: a.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=30, regParam=1e-3).fit(rows)


def predict(df: DataFrame, model, vec: str = "vec") -> DataFrame:
    """`df` plus `predicted` and `probability`."""
    wide = model.transform(df.withColumn("features", array_to_vector(F.transform(vec, lambda a: a.cast("double")))))
    return wide.withColumn("probability", vector_to_array("probability")).withColumn("predicted", F.col("prediction").cast("int")).drop("features", "rawPrediction", "prediction")


def autoencoder(x: np.ndarray, hidden: int = 32, features: int = 8, epochs: int = 100, rate: float = 0.05, seed: int = 17):
    """A small dense autoencoder (Adagrad, batches of 32, stops when the loss no longer falls): a function
    from rows to (features, reconstruction). For samples that fit one machine."""
    rng = np.random.default_rng(seed)
    sizes = [x.shape[1], hidden, features, hidden, x.shape[1]]
    w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
    b = [np.zeros(s) for s in sizes[1:]]
    gw, gb = [np.full_like(m, 1e-8) for m in w], [np.full_like(v, 1e-8) for v in b]

    def forward(batch):
        acts = [batch]
        for i, (m, v) in enumerate(zip(w, b)):
            z = acts[-1] @ m + v
            acts.append(np.maximum(z, 0) if i in (0, 2) else z)
        return acts

    last = np.inf
    for _ in range(epochs):
        order, loss = rng.permutation(len(x)), 0.0
        for s in range(0, len(x), 32):
            acts = forward(x[order[s : s + 32]])
            delta = 2 * (acts[-1] - acts[0]) / acts[0].size
            loss += ((acts[-1] - acts[0]) ** 2).mean() * len(acts[0])
            for i in reversed(range(4)):
                dw, db = acts[i].T @ delta, delta.sum(0)
                delta = delta @ w[i].T
                if i in (1, 3):
                    delta = delta * (acts[i] > 0)
                gw[i] += dw * dw
                gb[i] += db * db
                w[i] -= rate * dw / np.sqrt(gw[i])
                b[i] -= rate * db / np.sqrt(gb[i])
        if loss >= last:
            break
        last = loss

    def run(rows):
        acts = forward(rows)
        return acts[2], acts[-1]

    return run


def tsne(x: np.ndarray, dimensions: int = 3, perplexity: float = 30.0, rounds: int = 300, seed: int = 17) -> np.ndarray:
    """Exact t-SNE of a sample of some thousand rows at most."""
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    p = np.zeros((n, n))
    goal = np.log(min(perplexity, max((n - 1) / 3, 1.0)))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        di = np.delete(d[i], i)
        for _ in range(50):
            e = np.exp(-(di - di.min()) * beta)
            h = np.log(e.sum()) + beta * ((di - di.min()) * e).sum() / e.sum()
            if abs(h - goal) < 1e-4:
                break
            lo, hi = (beta, hi) if h > goal else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = e / e.sum()
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, dimensions))
    step = np.zeros_like(y)
    for t in range(rounds):
        q = 1 / (1 + ((y[:, None, :] - y[None, :, :]) ** 2).sum(-1))
        np.fill_diagonal(q, 0)
        g = ((p * (4 if t < 60 else 1) - q / q.sum()) * q)
        grad = 4 * (np.diag(g.sum(1)) - g) @ y
        step = (0.5 if t < 60 else 0.8) * step - 100.0 * grad
        y = y + step
    return y - y.mean(0)


# --- manifolds of one cluster ---------------------------------------------------------------------


def shortest_paths(d: np.ndarray) -> np.ndarray:
    """All shortest paths of a dense matrix of edge lengths (inf: none)."""
    out = d.copy()
    np.fill_diagonal(out, 0)
    for k in range(len(out)):
        out = np.minimum(out, out[:, k, None] + out[None, k, :])
    return out


class Links:
    """The graph of points where two are linked that are at most the greater of their own reaches apart: an
    own reach is that to the last of some nearest points, or `multiplier` times the percentile of all those
    distances if that is more. Half a matrix, 8 bytes a pair; paths are sought from one point at a time."""

    def __init__(self, x: np.ndarray, percentile: float, multiplier: float, neighbours: int) -> None:
        n = len(x)
        self.d, self.start = condensed(x)
        self.before = self.start - np.arange(n) - 1
        self.near = np.empty((n, max(min(neighbours, n - 1), 0)))
        for i in range(n):
            row = self.row(i)
            row[i] = np.inf
            self.near[i] = np.sort(np.partition(row, self.near.shape[1] - 1)[: self.near.shape[1]]) if n > 1 else 0
        reach = np.percentile(self.near, percentile) * multiplier if n > 1 else 0.0
        reach = np.maximum(reach, self.near.max(1, initial=0))
        for i in range(n - 1):
            part = self.d[self.start[i] : self.start[i] + n - 1 - i]
            part[part > np.maximum(reach[i], reach[i + 1 :])] = np.inf

    def row(self, i: int) -> np.ndarray:
        n = len(self.start)
        out = np.empty(n)
        out[:i], out[i] = self.d[self.before[:i] + i], 0
        out[i + 1 :] = self.d[self.start[i] : self.start[i] + n - 1 - i]
        return out

    def paths(self, source: int) -> np.ndarray:
        """The lengths of the shortest paths from a point (inf: none), by Dijkstra's algorithm."""
        out = self.row(source)
        todo = out.copy()
        todo[source] = np.inf
        while True:
            k = int(todo.argmin())
            if not todo[k] < np.inf:
                return out
            way = self.row(k) + out[k]
            better = np.flatnonzero(way < out)
            out[better] = todo[better] = way[better]
            todo[k] = np.inf

    def longest(self) -> float:
        """The longest of all shortest paths between points that have one. Paths from a point bound those of
        the points that it reaches; points that can't have a longer one are passed over."""
        n, best = len(self.start), 0.0
        upper, lower, high = np.full(n, np.inf), np.zeros(n), True
        while (left := np.flatnonzero(upper > best * (1 + 1e-12))).size:
            fresh = left[np.isinf(upper[left])]
            i = int(fresh[0] if len(fresh) else left[upper[left].argmax() if high else lower[left].argmin()])
            high = not high
            way = self.paths(i)
            at = np.flatnonzero(np.isfinite(way))
            far = way[at].max()
            best = max(best, float(far))
            lower[at] = np.maximum(lower[at], np.maximum(way[at], far - way[at]))
            upper[at] = np.minimum(upper[at], way[at] + far)
            upper[i] = -1.0
        return best


def nearest_rows(x: np.ndarray, k: int, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(at, d) of the k nearest other rows of each, ties by place, a block of rows at a time."""
    at, d = np.empty((len(x), k), int), np.empty((len(x), k))
    for s in range(0, len(x), block):
        e = np.concatenate([distance_block(x[s : s + block], x[c : c + 2048]) for c in range(0, len(x), 2048)], 1)
        e[np.arange(len(e)), np.arange(s, s + len(e))] = np.inf
        row, col = np.nonzero(e <= np.partition(e, k - 1, axis=1)[:, k - 1 : k])
        order = np.lexsort((col, e[row, col], row))
        first = order[np.searchsorted(row, np.arange(len(e)))[:, None] + np.arange(k)]
        at[s : s + block], d[s : s + block] = col[first], e[row[first], col[first]]
    return at, d


def manifold(x: np.ndarray, percentile: float = Manifold.scale_percentile, multiplier: float = Manifold.scale_multiplier, neighbours: int = Manifold.min_neighbors, gain: float = Manifold.error) -> tuple[float, list[int], float]:
    """(dimension, anchors, error) of a cluster's points: geodesic anchors, each farthest from those before
    in the sum of root distances, as long as the reconstruction gains `gain`; 1 + (anchors - 2) / 2. Points
    without a path are twice the longest path apart. 8 bytes a pair of points; paths from the anchors alone,
    and, where not all points are linked, from as many more as the longest path takes."""
    n = len(x)
    links = Links(x, percentile, multiplier, neighbours)
    edge = links.near.mean() if n > 1 else 1.0
    known: dict[int, np.ndarray] = {}
    none: list[float] = []

    def paths(i: int) -> np.ndarray:
        if i not in known:
            way = links.paths(i)
            if np.isinf(way).any():
                if not none:
                    none.append(links.longest() * 2)
                way[np.isinf(way)] = none[0]
            known[i] = way
        return known[i]

    first = int(paths(0).argmax())
    anchors = [first, int(paths(first).argmax())]

    def error(anchors: list[int]) -> float:
        inner = np.stack([paths(a) for a in anchors], 1)
        inner = inner / np.maximum(inner.sum(1, keepdims=True), 1e-12)
        at, dist = nearest_rows(inner, min(max(neighbours, 1), n - 1))
        w = np.cos(np.pi / 2 * dist / np.maximum(dist.max(1, keepdims=True) * 1.0001, 1e-12))
        rec = (x[at] * w[..., None]).sum(1) / np.maximum(w.sum(1), 1e-12)[:, None]
        return float(np.median(np.sqrt(((rec - x) ** 2).sum(1))) / max(edge, 1e-12))

    best = error(anchors) if n > 2 else 0.0
    while n > len(anchors):
        score = np.sqrt(np.stack([paths(a) for a in anchors], 1)).sum(1) ** 2
        score[anchors] = -1
        more = [*anchors, int(score.argmax())]
        e = error(more)
        if best - e <= gain:
            break
        anchors, best = more, e
    return 1 + (len(anchors) - 2) / 2, anchors, best


def manifolds(points: DataFrame, group: str) -> DataFrame:
    """(group, dimension, anchors, error) of each group of points (group, id, vec), a task a group, in which
    10,000 points take 400 MB."""
    measure = manifold

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("id", kind="stable")
        dim, anchors, error = measure(np.stack(pdf["vec"]).astype(float))
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"g": [key[0]], "dimension": [dim], "anchors": [[int(ids[a]) for a in anchors]], "error": [error]})

    return points.select(group, "id", "vec").groupBy(group).applyInPandas(run, f"g {dict(points.dtypes)[group]}, dimension double, anchors array<long>, error double").withColumnRenamed("g", group)
