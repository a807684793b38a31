"""Nested multi-scale clusters of a group's points, and ways to choose among them.

A group's clusters are a table, one row a cluster: id, parent (-1: none), n points, size (n - 1 edges),
scale (the edge that closed it), and the statistics of FIELDS, with its points in `vertices`. Groups are
independent, and each is one task, whose time grows with the square of the group. Clusters that gain a
point at a time hold some n² / 2 points together, so the lists are made only where they are wanted: without
them a group's table is as small as the group.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, tree_of_points

FIELDS = ["n", "size", "scale", "mean", "internal", "external", "quality", "soft_quality", "edge_quality", "isolation_mean", "core_size", "dominance", "adjusted_quality", "coherence", "obviousness", "mixed_quality", "adjusted_mixed"]
SCHEMA = "id long, parent long, " + ", ".join(f"{f} {'long' if f in ('n', 'size', 'core_size') else 'double'}" for f in FIELDS) + ", vertices array<long>, isolation array<double>, outlier array<boolean>"
BARE = SCHEMA[: SCHEMA.index(", vertices")]


def merge_table(tree: list[tuple[int, int, float]], n: int) -> list[tuple]:
    """(left, right, d) of the merges in the order of the tree's edges; nodes 0..n-1 are points, n.. merges."""
    top, root = list(range(n)), list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k, (a, b, d) in enumerate(sorted(tree, key=lambda e: (e[2], e[0], e[1]))):
        a, b = find(a), find(b)
        out.append((top[a], top[b], d))
        root[b] = a
        top[a] = n + k
    return out


def spans(merges: list[tuple], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of each node, points and merges, in an order in which each has its points together."""
    count = np.ones(n + len(merges), int)
    for k, (a, b, _) in enumerate(merges):
        count[n + k] = count[a] + count[b]
    first, todo = np.full(n + len(merges), -1), 0
    for k in range(len(merges) - 1, -1, -1):
        a, b, _ = merges[k]
        if first[n + k] < 0:
            first[n + k], todo = todo, todo + count[n + k]
        first[a], first[b] = first[n + k], first[n + k] + count[a]
    alone = np.flatnonzero(first < 0)
    first[alone] = todo + np.arange(len(alone))
    return first, first + count


def dendrogram(ids: np.ndarray, tree: list[tuple[int, int, float]], least: int = 6, lists: set[int] | None = None) -> pd.DataFrame:
    """The table of all clusters of `least` edges and more, from a spanning tree on positions of `ids`.

    With c(v, w) the longest edge of the tree's path: internal is the sum of c over pairs, a point's
    isolation the mean of c to all points (itself included), quality the ratio of (mean edge x pairs) to
    internal, and outliers are points over mean + deviation of isolation. With `lists`, only the clusters
    of these ids get theirs. `node` is a cluster's id, `lo` and `hi` its span (see `spans`).
    """
    n = len(ids)
    points = [np.array([i]) for i in range(n)]
    isolation = np.zeros(n)
    stats = [{"n": 1, "size": 0, "total": 0.0, "squares": 0.0, "internal": 0.0, "quality": 1.0} for _ in range(n)]
    parent, rows, largest = {}, {}, 1
    merges = merge_table(tree, n)
    lo, hi = spans(merges, n)
    for k, (a, b, d) in enumerate(merges):
        x, y, at = points[a], points[b], n + k
        isolation[x] += len(y) * d
        isolation[y] += len(x) * d
        few, many = sorted((x, y), key=len)
        members = np.insert(many, np.searchsorted(many, few), few)
        points.append(members)
        points[a] = points[b] = x[:0]
        m, size = len(members), len(members) - 1
        p, q = stats[a], stats[b]
        total, squares = p["total"] + q["total"] + d, p["squares"] + q["squares"] + d * d
        internal = p["internal"] + q["internal"] + d * len(x) * len(y)
        mean, pairs = total / size, m * (m - 1) / 2
        spread = np.sqrt(max(squares / size - mean * mean, 0.0))
        quality = mean * pairs / internal if internal else 1.0
        below = p["size"] + q["size"]
        joined = (p["quality"] * p["size"] + q["quality"] * q["size"]) / below if below else 0.0
        stats.append({"n": m, "size": size, "total": total, "squares": squares, "internal": internal, "quality": quality})
        parent[a] = parent[b] = at
        largest = max(largest, size)
        for c in (a, b):
            if c in rows:
                rows[c]["external"] = d
        if size >= least:
            iso = isolation[members] / m
            out = iso > iso.mean() + iso.std()
            core = size - int(out.sum())
            dominance = (1 + log(size)) / (1 + log(largest))
            coherence = mean / iso.mean() if iso.mean() > 0 else 1.0
            rows[at] = {
                "id": at - n, "n": m, "size": size, "scale": d, "mean": mean, "internal": internal, "external": -1.0, "quality": quality,
                "soft_quality": (mean + spread) * pairs / internal if internal else 1.0, "edge_quality": quality / joined if below and joined else 2.0,
                "isolation_mean": float(iso.mean()), "core_size": core, "dominance": dominance, "adjusted_quality": quality * (1 + log(max(core, 1))),
                "coherence": coherence, "mixed_quality": coherence * dominance, "adjusted_mixed": coherence * dominance * log(size),
                "node": k, "lo": lo[at], "hi": hi[at],
            }
            if lists is None or k in lists:
                rows[at] |= {"vertices": ids[members], "isolation": iso, "outlier": out}
    for at, r in rows.items():
        up = parent.get(at)
        r["parent"] = up - n if up is not None else -1
        bound = r["external"] if r["external"] >= 0 else r["scale"]
        r["obviousness"] = 1 - r["isolation_mean"] / bound if bound > 0 else 1.0
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    return pd.DataFrame(list(rows.values()), columns=[*columns, "node", "lo", "hi"])


def multiscale(points: DataFrame, group: str, least: int = 6, metric: str = "euclidean", lists: bool = True, tops: bool = False) -> DataFrame:
    """The cluster table of each group of points (group, id, vec), beside the group's column. Without
    `lists` the columns of BARE alone; with `tops` only the clusters that no other holds."""

    def choose(t: pd.DataFrame) -> pd.DataFrame:
        return t[t["parent"] == -1] if tops else t

    return per_group(points, group, _cluster_group(least, metric, choose, lists), SCHEMA if lists else BARE)


def _cluster_group(least: int, metric: str, choose: Callable[[pd.DataFrame], pd.DataFrame], lists: bool):
    """choose sees a group's table without lists; those that it keeps get theirs afterwards."""
    tree, table = tree_of_points, dendrogram
    named = [c.split()[0] for c in SCHEMA[len(BARE) + 2 :].split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, edges = pdf["id"].to_numpy(), tree(np.stack(pdf["vec"]), metric)
        out = choose(table(ids, edges, least, set()))
        if not lists:
            return out
        kept = set(out["node"])
        whole = table(ids, edges, least, kept).set_index("node")
        return out.assign(**{c: whole[c].reindex(out["node"]).to_numpy() for c in named})

    return run


def per_group(df: DataFrame, group: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str = SCHEMA) -> DataFrame:
    """f of each group's rows, with the group's column before the result's."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, pdf):
        out = f(pdf.drop(columns=[group]))
        out = out.reindex(columns=names)
        out.insert(0, "g", [key[0]] * len(out))
        return out

    return df.groupBy(group).applyInPandas(run, f"g {dict(df.dtypes)[group]}, {schema}").withColumnRenamed("g", group)


# --- selection: each takes and returns a group's table -------------------------------------------


def retain_best(t: pd.DataFrame, on: str = "mixed_quality") -> pd.DataFrame:
    """Clusters not under the mean of a property, under their nearest retained ancestors."""
    return relink(t, t[t[on] >= t[on].mean()])


def retain_above(t: pd.DataFrame, threshold: float = 0.5, on: str = "mixed_quality") -> pd.DataFrame:
    return t[t[on] >= threshold]


def relink(whole: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    """`kept` with parents replaced by the nearest kept ancestors in `whole`."""
    up, alive = dict(zip(whole["id"], whole["parent"])), set(kept["id"])

    def ancestor(p: int) -> int:
        while p != -1 and p not in alive:
            p = up.get(p, -1)
        return p

    return kept.assign(parent=[ancestor(p) for p in kept["parent"]])


def renumber(t: pd.DataFrame, by: str = "id", whole: pd.DataFrame | None = None) -> pd.DataFrame:
    """Ids 0, 1, ... in the order of a property (ties by old id), parents along with them."""
    t = relink(whole if whole is not None else t, t).sort_values([by, "id"], kind="stable")
    new = {old: i for i, old in enumerate(t["id"])}
    return t.assign(id=[new[i] for i in t["id"]], parent=[new.get(p, -1) for p in t["parent"]])


def sift_children(t: pd.DataFrame, threshold: float = 1.0, quality: str = "mixed_quality") -> pd.DataFrame:
    """From the roots down: a child is kept if its quality is `threshold` of that of the last kept cluster
    above it, or more."""
    below: dict = {}
    rows = {r.id: r for r in t.itertuples()}
    for r in t.itertuples():
        below.setdefault(r.parent if r.parent in rows else -1, []).append(r.id)
    keep, todo = set(), [(i, None) for i in below.get(-1, [])]
    while todo:
        i, q = todo.pop()
        mine = getattr(rows[i], quality)
        if q is None or mine >= q * threshold:
            keep.add(i)
            q = mine
        todo += [(c, q) for c in below.get(i, [])]
    return relink(t, t[t["id"].isin(keep)])


def _greedy(t: pd.DataFrame, quality: str, admit: Callable) -> pd.DataFrame:
    """Rows in the order of falling quality (ties by id) that `admit` against those taken that overlap, as
    their spans or, where a table has none, their vertices tell."""
    t = t.sort_values([quality, "id"], ascending=[False, True], kind="stable")
    holders: dict = {}
    taken = []
    spanned = "lo" in t.columns
    lo, hi = np.zeros(len(t), int), np.zeros(len(t), int)
    for r in t.itertuples():
        if spanned:
            rivals = np.flatnonzero((lo[: len(taken)] < r.hi) & (hi[: len(taken)] > r.lo))
        else:
            rivals = {k for v in r.vertices for k in holders.get(v, ())}
        if all(admit(r, taken[k]) for k in rivals):
            if spanned:
                lo[len(taken)], hi[len(taken)] = r.lo, r.hi
            else:
                for v in r.vertices:
                    holders.setdefault(v, []).append(len(taken))
            taken.append(r)
    return t[t["id"].isin([r.id for r in taken])]


def condense_best(t: pd.DataFrame, discriminant: str = "mean", quality: str = "quality", distinction: float = 0.3, tolerance: float = 0.8) -> pd.DataFrame:
    """Best first; an overlap with a better cluster is borne if both differ enough in the discriminant and
    the quality falls off little."""

    def admit(r, s) -> bool:
        a, b = getattr(r, discriminant), getattr(s, discriminant)
        apart = abs(a - b) / max(a, b) if max(a, b) > 0 else 0
        return apart > distinction and getattr(r, quality) > tolerance * getattr(s, quality)

    return _greedy(t, quality, admit)


def decant_best(t: pd.DataFrame, quality: str = "quality") -> pd.DataFrame:
    """Best first, without overlaps."""
    return _greedy(t, quality, lambda r, s: False)


def find_largest(t: pd.DataFrame) -> pd.DataFrame:
    return t.sort_values(["size", "id"], ascending=[False, True], kind="stable").head(1)


def find_all_largest(t: pd.DataFrame) -> pd.DataFrame:
    """Largest first, without overlaps."""
    return _greedy(t, "size", lambda r, s: False)


def children_of(t: pd.DataFrame) -> dict:
    out: dict = {}
    for r in t.itertuples():
        out.setdefault(r.parent, []).append(r)
    return out


def quality_vs_coverage(size: str = "size", quality: str = "quality") -> Callable:
    return lambda cl, ch: sum(getattr(c, size) for c in ch) / getattr(cl, size) * max(getattr(c, quality) for c in ch) / getattr(cl, quality)


def quality_vs_outliers(quality: str = "quality") -> Callable:
    return lambda cl, ch: np.mean([c.size / max(c.core_size, 1) for c in ch]) / (cl.size / max(cl.core_size, 1)) * max(getattr(c, quality) for c in ch) / getattr(cl, quality)


def generational(feature: str = "quality") -> Callable:
    return lambda cl, ch: np.mean([getattr(c, feature) for c in ch]) / getattr(cl, feature)


def product(*criteria: Callable) -> Callable:
    return lambda cl, ch: float(np.prod([f(cl, ch) for f in criteria]))


def satisfaction(quality: str = "quality") -> Callable:
    return lambda cl, ch: sum(c.core_size * getattr(c, quality) for c in ch) / max(cl.core_size * getattr(cl, quality), 1e-300)


def scale_quality(quality: str = "quality") -> Callable:
    return lambda cl, ch: np.mean([getattr(c, quality) for c in ch]) / getattr(cl, quality) * cl.scale / max(np.mean([c.scale for c in ch]), 1e-300)


def decant_split(t: pd.DataFrame, threshold: float = 1.0, criterion: Callable = lambda cl, ch: 2.0) -> pd.DataFrame:
    """From the largest disjoint clusters down, replace those over `threshold` by their children, as long as
    the set grows."""
    below = children_of(t)
    now, after = [], list(find_all_largest(t).itertuples())
    while len(after) > len(now):
        now, after = after, []
        for cl in now:
            ch = below.get(cl.id, [])
            after += ch if ch and criterion(cl, ch) > threshold else [cl]
    return t[t["id"].isin([c.id for c in now])]


def vote_refine(t: pd.DataFrame, points: int, allowance: float = 0.75, outlier_penalty: float = 1.0, decay: float = 0.8, quality: str = "quality") -> pd.DataFrame:
    """Points vote for the clusters that hold them, in proportion to quality; the cluster of most votes an
    edge is elected, its points' later votes weigh less, and so on until the mean weight has fallen."""
    weight: dict = {}
    left = {r.id: r for r in t.itertuples()}
    elected = []
    while left and (sum(weight.values()) + points - len(weight)) / points > allowance:
        total: dict = {}
        for r in left.values():
            for v, out in zip(r.vertices, r.outlier):
                total[v] = total.get(v, 0.0) + getattr(r, quality) * (outlier_penalty if out else 1.0)
        votes = {k: sum(getattr(r, quality) * (outlier_penalty if out else 1.0) / total[v] * weight.get(v, 1.0) for v, out in zip(r.vertices, r.outlier) if total[v]) / max(r.size, 1) for k, r in left.items()}
        best = max(votes, key=lambda k: (votes[k], -k))
        for v in left[best].vertices:
            weight[v] = weight.get(v, 1.0) * decay
        elected.append(best)
        del left[best]
    return t[t["id"].isin(elected)]


def erode(ids: np.ndarray, tree: list[tuple[int, int, float]], threshold: float = 0.9, least: int = 1) -> list[list[int]]:
    """Components of the tree without its edges of quality under `threshold`, largest first, single points
    included."""
    t = dendrogram(ids, tree, least)
    weak = {(r.n, r.scale) for r in t.itertuples() if r.edge_quality < threshold}
    merges = merge_table(tree, len(ids))
    n = len(ids)
    count = [1] * n
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    first = list(range(n))
    for a, b, d in merges:
        size = count[a] + count[b]
        count.append(size)
        first.append(first[a])
        if (size, d) not in weak:
            root[find(first[b])] = find(first[a])
    groups: dict = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(int(ids[i]))
    return sorted(groups.values(), key=lambda g: (-len(g), g))


def condensed(points: DataFrame, group: str, interesting: int = 10, metric: str = "euclidean", lists: bool = True) -> DataFrame:
    """Clusters of `interesting` edges or more, condensed, numbered by size; `lists` as in `multiscale`."""
    above, best, number = retain_above, condense_best, renumber

    def choose(t: pd.DataFrame) -> pd.DataFrame:
        return number(best(above(t, interesting, "size"), "mean", "adjusted_mixed", 0.3, 0.8), "size", t)

    return per_group(points, group, _cluster_group(6, metric, choose, lists), SCHEMA if lists else BARE)


def separated(points: DataFrame, group: str, interesting: int = 10, metric: str = "euclidean", lists: bool = True) -> DataFrame:
    """Sifted clusters of `interesting` edges or more, best first without overlaps; `lists` as in
    `multiscale`."""
    sift, above, best = sift_children, retain_above, decant_best

    def choose(t: pd.DataFrame) -> pd.DataFrame:
        return best(above(sift(t, 1.0, "mixed_quality"), interesting, "size"), "quality")

    return per_group(points, group, _cluster_group(6, metric, choose, lists), SCHEMA if lists else BARE)


# --- clusters as DataFrames ----------------------------------------------------------------------


def members(clusters: DataFrame, group: str) -> DataFrame:
    """(group, cluster, vertex, isolation, outlier)."""
    return clusters.select(group, F.col("id").alias("cluster"), F.explode(F.arrays_zip("vertices", "isolation", "outlier")).alias("m")).select(group, "cluster", F.col("m.vertices").alias("vertex"), F.col("m.isolation").alias("isolation"), F.col("m.outlier").alias("outlier"))


def assignments(points: DataFrame, clusters: DataFrame, group: str) -> DataFrame:
    """(group, id, cluster): the smallest cluster that holds the point, else -1."""
    inside = clusters.select(group, F.col("id").alias("cluster"), "size", F.explode("vertices").alias("id"))
    least = inside.groupBy(group, "id").agg(F.min_by("cluster", F.struct("size", "cluster")).alias("cluster"))
    return points.select(group, "id").join(least, [group, "id"], "left").select(group, "id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def smallest_condensed(points: DataFrame, group: str, interesting: int = 10, metric: str = "euclidean") -> DataFrame:
    """`assignments` to the `condensed` clusters of each group of points (group, id, vec), found by spans where
    the clusters are: as many rows as points, however many clusters hold each."""
    tree, table, above, best, number, link, place = tree_of_points, dendrogram, retain_above, condense_best, renumber, merge_table, spans

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, edges = pdf["id"].to_numpy(), tree(np.stack(pdf["vec"]), metric)
        t = table(ids, edges, 6, set())
        t = number(best(above(t, interesting, "size"), "mean", "adjusted_mixed", 0.3, 0.8), "size", t)
        at = np.full(len(ids), -1)
        for c, lo, hi in t.sort_values(["size", "id"], ascending=False)[["id", "lo", "hi"]].itertuples(index=False):
            at[lo:hi] = c
        return pd.DataFrame({"id": ids, "cluster": at[place(link(edges, len(ids)), len(ids))[0][: len(ids)]]})

    found = per_group(points.select(group, "id", "vec"), group, run, "id long, cluster long")
    return found.withColumn("cluster", F.when(F.col(group).isNotNull(), F.col("cluster")).otherwise(-1))  # as null is equal to nothing


def isolation(points: DataFrame, clusters: DataFrame, group: str) -> DataFrame:
    """(group, id, isolation): in the largest cluster of the point, (isolation x n + scale x (all - n)) / all,
    scaled to 0..1 over the group; 2 for points in none."""
    w = Window.partitionBy(group, "id").orderBy(F.col("size").desc(), "cluster")
    one = clusters.select(group, F.col("id").alias("cluster"), "n", "size", "scale", F.explode(F.arrays_zip("vertices", "isolation")).alias("m")).select(group, "cluster", "n", "size", "scale", F.col("m.vertices").alias("id"), F.col("m.isolation").alias("iso"))
    one = one.withColumn("r", F.row_number().over(w)).where("r = 1")
    total = points.groupBy(group).agg(F.count("*").alias("all"))
    raw = one.join(total, group).select(group, "id", ((F.col("iso") * F.col("n") + F.col("scale") * (F.col("all") - F.col("n"))) / F.col("all")).alias("raw"))
    g = Window.partitionBy(group)
    lo, hi = F.min("raw").over(g), F.max("raw").over(g)
    scaled = raw.select(group, "id", F.coalesce((F.col("raw") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)).alias("isolation"))
    return points.select(group, "id").join(scaled, [group, "id"], "left").select(group, "id", F.coalesce("isolation", F.lit(2.0)).alias("isolation"))


def overlaps(clusters: DataFrame, group: str, held: int = 1_000_000) -> DataFrame:
    """(group, a, b, shared) of clusters that share points, a < b; by their vertices, or in a table without
    lists by the links to their parents, which must be complete: clusters of one tree share points where one
    holds the other, and those are all points of the smaller.

    There may be as many pairs as half the square of a group's clusters. Every task gets a group's links and
    writes the pairs of some of its clusters, about `held` at most.
    """
    if "vertices" in clusters.columns:
        m = clusters.select(group, F.col("id").alias("c"), F.explode("vertices").alias("v"))
        return m.select(group, F.col("c").alias("a"), "v").join(m.select(group, F.col("c").alias("b"), "v"), [group, "v"]).where("a < b").groupBy(group, "a", "b").agg(F.count("*").alias("shared"))
    t = checkpointed(clusters.select(group, "id", "parent", "n"))
    most = t.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most * most // (2 * held)))

    def run(tab):
        import pyarrow as pa

        ids, parent, n = (tab.column(c).to_numpy() for c in ("id", "parent", "n"))
        at = {int(c): k for k, c in enumerate(ids)}
        up = np.array([at.get(int(p), -1) for p in parent], int)
        part = tab.column("part")[0].as_py()
        up, depth, low, high, shared = up.tolist(), [0] * len(ids), [], [], []
        for k in np.argsort(-n, kind="stable").tolist():  # whoever holds a cluster is larger
            depth[k] = depth[up[k]] + 1 if up[k] >= 0 else 0
        for k in np.argsort(depth, kind="stable")[part::parts].tolist():
            above, x = [], up[k]
            while x >= 0:
                above.append(x)
                x = up[x]
            other = ids[np.array(above, int)]
            low.append(np.minimum(other, ids[k]))
            high.append(np.maximum(other, ids[k]))
            shared.append(np.full(len(above), n[k]))
        a, b, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (low, high, shared))
        return pa.table({"g": pa.array([tab.column(group)[0].as_py()] * len(a), tab.schema.field(group).type), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "shared": pa.array(c, pa.int64())})

    dealt = t.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.groupBy(group, "part").applyInArrow(run, f"g {dict(t.dtypes)[group]}, a long, b long, shared long").withColumnRenamed("g", group)


def from_labels(labels: DataFrame, label: str) -> DataFrame:
    """(label, n, size) of a flat clustering; label -1 is none."""
    return labels.where(F.col(label) != -1).groupBy(label).agg(F.count("*").alias("n")).withColumn("size", F.col("n") - 1)


def lineage(clusters: DataFrame, group: str) -> DataFrame:
    """(group, id, root, level) from the roots (level 0) down."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        up = dict(zip(t["id"], t["parent"]))
        known: dict = {}
        for i in up:
            path = []
            while i not in known and up.get(i, -1) in up:
                path.append(i)
                i = up[i]
            root, level = known.setdefault(i, (i, 0))
            for k, node in enumerate(reversed(path)):
                known[node] = (root, level + k + 1)
        return pd.DataFrame([(i, *known[i]) for i in up], columns=["id", "root", "level"])

    return per_group(clusters.select(group, "id", "parent"), group, run, "id long, root long, level int")


def stat_series(clusters: DataFrame, group: str, stats: list[str], sort_by: str = "size") -> DataFrame:
    """(group, rank, stat ...): statistics divided by their greatest in the group, in the order of one."""
    g, o = Window.partitionBy(group), Window.partitionBy(group).orderBy(sort_by, "id")
    return clusters.select(group, F.row_number().over(o).alias("rank"), *[(F.col(s) / F.nullif(F.max(s).over(g), F.lit(0))).alias(s) for s in stats])


def quality_cuts(ids: np.ndarray, tree: list[tuple[int, int, float]]) -> tuple[pd.DataFrame, np.ndarray]:
    """The merges with their diagnostics, and the labels of the partition before the most significant cut.

    A merge is a cut if its quality (mean edge x pairs / internal) is under one half and under that of the
    better side; its significance is half its impact (the smaller side's share of all points, in tenths) and
    half its local growth (edge over the sides' means, against six merges before it), over 1.4.
    """
    n = len(ids)
    stats = [(1, 0.0, 0.0)] * n
    rows = []
    for a, b, d in merge_table(tree, n):
        (x, tx, ix), (y, ty, iy) = stats[a], stats[b]
        m, total, internal = x + y, tx + ty + d, ix + iy + d * x * y
        stats.append((m, total, internal))
        quality = [t / (k - 1) * k * (k - 1) / 2 / i if i else 1.0 for k, t, i in ((m, total, internal), (x, tx, ix), (y, ty, iy))]
        growth = [max(k - 1, 1) * (d / (t / (k - 1)) if t else 1.0) for k, t in ((x, tx), (y, ty))]
        rows.append((m, d, total / (m - 1), internal, quality[0], quality[0] - min(quality[1:]), sum(growth) / max(x + y - 2, 2), min(x, y) / n))
    t = pd.DataFrame(rows, columns=["n", "d", "mean", "internal", "quality", "change", "local", "share"])
    before = t["local"].rolling(6, min_periods=1).mean().clip(lower=1)
    t["significance"] = (0.5 * t["share"] / 0.1 + 0.5 * t["local"] / (before * 1.5)) / 1.4
    t["cut"] = (t["quality"] < 0.5) & (t["change"] < 0)
    upto = int(t[t["cut"]]["significance"].idxmax()) if t["cut"].any() else len(t)
    root = list(range(2 * n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, b, _) in enumerate(merge_table(tree, n)[:upto]):
        root[a] = root[b] = n + k
    return t, np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def level_sequence(clusters: DataFrame, group: str) -> DataFrame:
    """(group, level, clusters): the ids of each level, from the roots down."""
    return lineage(clusters, group).groupBy(group, "level").agg(F.array_sort(F.collect_list("id")).alias("clusters"))
