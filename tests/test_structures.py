import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.functions.vectors import distance_block
from skeinwork.operators import clusters as K
from skeinwork.operators import filters as S
from skeinwork.operators import graph as G
from skeinwork.operators import layout as W
from skeinwork.operators import learn as L
from skeinwork.operators import neighbours as N
from skeinwork.operators import ranking as R

EIGHT = [(0, 0), (1, 0), (0, 0.9), (1.1, 1.1), (3, 3.1), (4.1, 3), (3, 4), (4, 4.1)]


def cloud(seed=17, n=60):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 1, (n // 2, 2)), rng.normal(8, 1, (n - n // 2, 2))])


def frame(spark, x, label=0):
    return spark.createDataFrame([(i, [float(v) for v in p], label) for i, p in enumerate(x)], "id long, vec array<double>, label int")


def chain(tree, n):
    c = np.full((n, n), np.inf)
    np.fill_diagonal(c, 0)
    for a, b, d in tree:
        c[a, b] = c[b, a] = d
    for k in range(n):
        c = np.minimum(c, np.maximum(c[:, k, None], c[None, k, :]))
    return c


def test_neighbours_in_blocks(spark):
    x = np.concatenate([cloud(), cloud()[:3]])
    want = N.nearest(frame(spark, x), 4).orderBy("i", "rank").collect()
    got = N.nearest(frame(spark, x), 4, block=16).orderBy("i", "rank").collect()
    assert [(r.i, r.j) for r in want] == [(r.i, r.j) for r in got]
    d = distance_block(x, x)
    np.fill_diagonal(d, np.inf)
    assert all(abs(r.d - np.sort(d[r.i])[r["rank"] - 1]) < 1e-12 for r in got)
    edges = N.neighbour_edges(N.nearest(frame(spark, x), 4))
    assert N.edge_faults(edges, frame(spark, x)).count() == 0
    pairs = {(r.i, r.j) for r in N.band_pairs(frame(spark, x), 1.0).collect()}
    assert pairs == {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if d[i, j] <= 1.0}


@pytest.mark.parametrize("local", [0, 10_000])
def test_spanning_forest(spark, local):
    x = cloud(3, 24)
    d = distance_block(x, x)
    edges = spark.createDataFrame([(i, j, float(d[i, j])) for i, j in itertools.combinations(range(len(x)), 2)], "fr long, to long, d double")
    got = {(r.fr, r.to) for r in G.minimum_spanning_forest(edges, local).collect()}
    assert got == {(int(a), int(b)) for a, b, _ in G.tree_of(np.arange(len(x)), d)}


def test_chains_and_closed_forms(spark):
    x = cloud(5, 20)
    tree = G.tree_of(np.arange(len(x)), distance_block(x, x))
    c = chain(tree, len(x))
    got = G.chain_distances(G.group_trees(frame(spark, x), "label"), "label").collect()
    assert len(got) == 190 and all(abs(r.c - c[r.i, r.j]) < 1e-12 for r in got)
    for r in K.dendrogram(np.arange(len(x)), tree, 1).itertuples():
        v = r.vertices
        internal = c[np.ix_(v, v)].sum() / 2
        assert abs(r.internal - internal) < 1e-9 and abs(r.isolation_mean - 2 * internal / r.n**2) < 1e-9
        assert np.allclose(r.isolation, c[np.ix_(v, v)].mean(1)) and abs(r.coherence - r.quality * r.n / (r.n - 1)) < 1e-9


def test_selection():
    x = cloud(7, 60)
    tree = G.tree_of(np.arange(len(x)), distance_block(x, x))
    t = K.dendrogram(np.arange(len(x)), tree)
    best = K.decant_best(t)
    used = [v for r in best.itertuples() for v in r.vertices]
    assert len(used) == len(set(used)) and t.loc[t["quality"].idxmax(), "id"] in set(best["id"])
    assert len(K.find_largest(t)) == 1 and K.find_largest(t)["n"].iloc[0] == len(x)
    sifted = K.sift_children(t)
    up = dict(zip(sifted["id"], sifted["parent"]))
    q = dict(zip(sifted["id"], sifted["mixed_quality"]))
    assert all(p == -1 or q[i] >= q[p] for i, p in up.items())
    assert (K.retain_best(t)["mixed_quality"] >= t["mixed_quality"].mean()).all()
    new = K.renumber(K.condense_best(t), "size", t)
    assert sorted(new["id"]) == list(range(len(new))) and set(new["parent"]) <= {-1, *new["id"]}
    assert len(K.decant_split(t, 0.5, K.product(K.generational(), K.quality_vs_coverage()))) >= 1
    for f in (K.quality_vs_outliers(), K.satisfaction(), K.scale_quality()):
        assert len(K.decant_split(t, 1.0, f)) >= 1
    assert len(K.vote_refine(t, len(x))) >= 1
    parts = K.erode(np.arange(len(x)), tree)
    assert sorted(v for p in parts for v in p) == list(range(len(x)))


def test_condensed_finds_both_clouds(spark):
    p = frame(spark, cloud())
    a = K.assignments(p, K.condensed(p, "label"), "label").toPandas()
    assert a[a["id"] < 30]["cluster"].mode()[0] != a[a["id"] >= 30]["cluster"].mode()[0]
    iso = K.isolation(p, K.multiscale(p, "label"), "label").toPandas()["isolation"]
    assert iso.between(0, 2).all()


def test_smallest_condensed_makes_no_lists(spark):
    """The same as by the clusters' lists, without making them."""
    from skeinwork.plans import catalog

    r = np.random.default_rng(8)
    for x in (cloud(), r.normal(size=(150, 3)).round(1), np.repeat(r.normal(size=(12, 2)), 6, 0), np.zeros((1, 2)), np.cumsum(r.uniform(1, 2, (70, 1)), 0) ** 2):
        p = frame(spark, x)
        want = sorted(K.assignments(p, K.condensed(p, "label"), "label").collect())
        assert sorted(K.smallest_condensed(p, "label").collect()) == want and len(want) == len(x)
    plan = catalog.QUERIES["assignments"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "vertices" not in plan


def test_simple_representatives_by_brute_force(spark, monkeypatch):
    """The greedy walk in small batches, over lists that are never written."""
    r = np.random.default_rng(12)
    monkeypatch.setattr(G, "BALL_LINKS", 300)
    monkeypatch.setattr(N, "radius_lists", None)
    monkeypatch.setattr(G, "radius_lists", None, raising=False)
    for x, density in ((r.normal(size=(300, 3)), 0.05), (np.repeat(r.normal(size=(20, 2)), 8, 0), 0.1), (r.normal(size=(40, 2)), 0.01), (np.zeros((1, 2)), 0.5)):
        n, d = len(x), distance_block(x, x)
        k = max(1, int(n * density))
        near = np.sort(d + np.diag([np.inf] * n), axis=1)[:, :k]
        radius = np.median(near[:, -1]) if n > 1 else -1.0
        covered, want = np.zeros(n, bool), []
        s = [sum(row[np.isfinite(row)]) for row in near]
        for i in sorted(range(n), key=lambda i: (round(s[i], 9), i)):
            at = np.flatnonzero(((d[i] <= radius) | (np.arange(n) == i)) & ~covered)
            if not covered[i] and len(at) >= int(0.15 * k):
                covered[at] = True
                want.append((i, at.tolist()))
        assert G.simple_representatives(frame(spark, x), density) == want


def test_fixed_graph(spark):
    p = frame(spark, EIGHT)
    tree = G.group_trees(p, "label")
    path = G.tree_path(tree, 0, 7)
    assert path[0][0] == 0 and path[-1][0] == 7 and G.midpoint(path) not in (0, 7)
    assert G.tree_path(tree, 0, 0) == [(0, 0.0)] and G.midpoint([(3, 0.0), (4, 1.0)]) == 3
    reps = G.group_representatives(p, "label").toPandas()
    assert sorted(reps["id"]) == list(range(8))
    assert all(set(g["id"]) <= set(range(4)) or set(g["id"]) <= set(range(4, 8)) for _, g in reps.groupby("rep"))


def test_density(spark):
    x = np.concatenate([cloud(), [[100.0, 100.0]]])
    out, eps = G.dbscan(frame(spark, x), 3)
    got = {r.id: r.label for r in out.collect()}
    assert eps > 0 and got[60] == -1 and not {got[i] for i in range(30)} & {got[i] for i in range(30, 60)} - {-1}
    reps = G.simple_representatives(frame(spark, x), 0.1)
    covered = [v for _, c in reps for v in c]
    assert len(covered) == len(set(covered)) and len(reps) >= 2


def test_typicality_and_watersheds(spark):
    x = np.concatenate([cloud(), [[30.0, 30.0]]])
    p = frame(spark, x)
    near = N.nearest(p, 15)
    t = {r.id: r.typicality for r in G.typicality(near, p.select("id")).collect()}
    assert max(t.values()) == 1.0 and max(t, key=t.get) == 60
    c = spark.createDataFrame([(i, float(np.hypot(*v))) for i, v in enumerate(x)], "id long, c double")
    root = {r.id: r.root for r in G.watersheds(near, c).collect()}
    assert root[min(range(61), key=lambda i: np.hypot(*x[i]))] == min(range(61), key=lambda i: np.hypot(*x[i]))


def test_trees_of_all_labels(spark):
    from skeinwork.plans.catalog import QUERIES

    d = "/root/testdata/sf0.001"
    groups = {}
    for r in sorted(spark.read.parquet(f"{d}/embeddings.parquet").collect(), key=lambda r: r.vec_id):
        groups.setdefault(r.label, []).append(r)
    edges, links, roots = ({}, {}, {})
    for name, out in (("mst_by_label", edges), ("chain_distance", links), ("dendrogram_root", roots)):
        for r in QUERIES[name](spark, d).collect():
            out.setdefault(r.label, []).append(r)
    assert set(roots) == set(groups) and max(groups) >= 3
    for label, rows in groups.items():
        ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
        c = distance_block(x, x)
        for k in range(len(x)):
            c = np.minimum(c, np.maximum(c[:, k][:, None], c[k][None, :]))
        pairs = {(ids[a], ids[b]): c[a, b] for a in range(len(x)) for b in range(a + 1, len(x))}
        got = {(r.i, r.j): r.c for r in links.get(label, [])}
        assert set(got) == set(pairs) and all(abs(got[p] - pairs[p]) < 1e-5 for p in pairs)
        assert len(edges.get(label, [])) == len(x) - 1
        assert all(abs(r.d - pairs[min(r.fr, r.to), max(r.fr, r.to)]) < 1e-5 for r in edges.get(label, []))
        assert roots[label][0].n == len(x) and abs(roots[label][0].internal - sum(pairs.values())) < 1e-3


def test_alternative_exemplars_keep_apart(spark):
    """Passing over the nearest k / 2 of each one taken, by a plain loop over the ranked points."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, [float(v) for v in rng.normal(i % 2, 1, 2)]) for i in range(60)]
    p = spark.createDataFrame(rows, "id long, category int, vec array<double>")
    near, cats = N.nearest(p, 12).cache(), p.select("id", "category")
    close = {}
    for r in near.where("rank <= 6").collect():
        close.setdefault(r.i, set()).add(r.j)
    every = {}
    for r in R.alternative_exemplars(near, cats, 12, 60).orderBy("place").collect():
        every.setdefault(r.category, []).append(r.id)
    got = {}
    for r in R.alternative_exemplars(near, cats, 12, 5, exclude=True).orderBy("place").collect():
        got.setdefault(r.category, []).append(r.id)
    for c, ids in every.items():
        taken, hidden = [], set()
        for i in ids:
            if i not in hidden and len(taken) < 5:
                taken.append(i)
                hidden |= close[i]
        assert got[c] == taken


def test_exemplars(spark):
    x = cloud()
    p = frame(spark, x).withColumn("category", (F.col("id") >= 30).cast("int"))
    near = N.nearest(p, 59)
    s = {r.id: r for r in R.exemplar_scores(near, p.select("id", "category")).collect()}
    d = distance_block(x, x)
    for i in range(60):
        foreign = d[i][np.arange(60) // 30 != i // 30].min()
        assert abs(s[i].separation - foreign) < 1e-12 and s[i].centrality == (d[i][np.arange(60) // 30 == i // 30] < foreign).sum() - 1
    out = R.exemplars(near, p.select("id", "category"), 4).toPandas()
    assert set(out.groupby("category")["place"].max()) <= {1, 2, 3, 4}


def test_exemplars_beyond_long_shadows(spark):
    """The best point hides the next 149; two more remain, and all of them are found."""
    n = 152
    near = spark.createDataFrame([(0, r, r, r / 1000) for r in range(1, 150)] + [(0, 150, n, 1.0)] + [(i, 1, n, 1.0 / (1 + i)) for i in range(1, n)], "i long, rank int, j long, d double")
    cats = spark.createDataFrame([(i, int(i == n)) for i in range(n + 1)], "id long, category int")
    out = R.exemplars(near, cats, 2).where("category = 0").orderBy("place").collect()
    assert [r.id for r in out] == [0, 150]


def test_multiobjective(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 30), rng.integers(0, 9, 30)
    df = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b))], "id long, a int, b int")
    got = [r.id for r in R.multiobjective_rank(df, [F.col("a"), F.col("b")], "id").orderBy("place").collect()]
    orders = [sorted(range(30), key=lambda i: (v[i], i)) for v in (a, b)]
    seen, want = [set(), set()], []
    for step in range(30):
        for k in (0, 1):
            seen[k].add(orders[k][step])
        for k in (0, 1):
            i = orders[k][step]
            if i in seen[0] and i in seen[1] and i not in want:
                want.append(i)
    assert got == want


def test_filters(spark):
    df = spark.createDataFrame([(i, i % 2 == 0, i % 3 == 0, float(i)) for i in range(30)], "id long, a boolean, b boolean, v double")
    assert {r.id for r in df.where(S.condition(["!a|b"])).collect()} == {i for i in range(30) if i % 2 and i % 3}
    one = {r.id for r in S.subset(df, "id", 7).collect()}
    assert len(one) == 7 and one == {r.id for r in S.subset(df.repartition(5), "id", 7).collect()}
    assert {r.id for r in S.extremes(df, "v", "id", 2).collect()} == {0, 1, 28, 29}


def test_features(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 6))
    model = L.fit_pca(frame(spark, x), 2)
    err = L.reconstruct(frame(spark, x), model).select(L.rmse("vec", "reconstruction").alias("e")).toPandas()["e"]
    assert err.max() < 1e-6
    features, rec = L.autoencoder(x, 16, 3, 40)(x)
    assert features.shape == (80, 3) and ((rec - x) ** 2).mean() < (x**2).mean()
    assert L.tsne(x[:20], rounds=30).shape == (20, 3)
    ring = np.array([[np.cos(a), np.sin(a)] for a in np.linspace(0, 6, 40)])
    dim, anchors, _ = L.manifold(ring)
    assert dim >= 1 and len(set(anchors)) == len(anchors)


def test_manifolds_keep_no_matrix():
    """Paths from single points are those of the whole matrix, the longest too, and a group keeps half a matrix."""
    import tracemalloc

    r = np.random.default_rng(21)
    for x in (r.normal(size=(90, 3)), np.concatenate([r.normal(size=(30, 2)), r.normal(size=(25, 2)) + 40, [[200.0, 0.0]]]), np.repeat(r.normal(size=(12, 2)), 6, 0), np.cumsum(r.uniform(0, 1, (60, 2)), 0)):
        links = L.Links(x, 75, 1.5, 3)
        d = distance_block(x, x)
        reach = np.sort(d, axis=1)[:, 1:4]
        reach = np.maximum(np.percentile(reach, 75) * 1.5, reach.max(1))
        whole = L.shortest_paths(np.where(d <= np.maximum(reach[:, None], reach[None, :]), d, np.inf))
        assert np.allclose([links.paths(i) for i in range(len(x))], whole)
        assert np.isclose(links.longest(), whole[np.isfinite(whole)].max())
        e = d + np.diag([np.inf] * len(x))
        at = np.argsort(e, axis=1, kind="stable")[:, :3]
        got = L.nearest_rows(x, 3, 16)
        assert (got[0] == at).all() and (got[1] == np.take_along_axis(e, at, 1)).all()
    assert L.manifold(np.zeros((1, 2)))[0] == 1 and L.manifold(np.zeros((5, 2)))[0] == 1
    x = r.normal(size=(700, 3))
    tracemalloc.start()
    L.manifold(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700 * 700 * 8 * 2  # with all paths: 5 matrices and more


def test_affinity_messages_take_the_place_of_those_before():
    """Blocks of rows give what whole matrices do, in three of them."""
    import tracemalloc

    r = np.random.default_rng(31)
    for x in (r.normal(size=(70, 3)), np.repeat(r.normal(size=(9, 2)), 5, 0), np.zeros((1, 2)), np.arange(6.0)[:, None]):
        d = distance_block(x, x)
        assert (G.similarities(x, block=7) == -(d**2)).all()
        for block in (1, 16, 1000):
            assert (G.exemplars_of(G.similarities(x), rounds=50, block=block) == G.affinity_propagation(d, rounds=50)).all()
    x = r.normal(size=(900, 2))
    tracemalloc.start()
    G.exemplars_of(G.similarities(x), rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 900 * 900 * 8 * 3.6


def test_affinity_holds_the_pairs_that_count(spark):
    """Held messages give the labels of whole matrices, ties and copies too, in less than one matrix."""
    import tracemalloc

    r = np.random.default_rng(41)
    far = np.concatenate([r.normal(size=(60, 4)), r.normal(size=(20, 4)) * 0.01 + 5, [[1e4] * 4]])
    for x in (r.normal(size=(130, 3)), np.repeat(r.normal(size=(9, 2)), 5, 0), np.zeros((40, 2)), np.arange(70.0)[:, None], r.integers(0, 3, (66, 2)).astype(float), far, np.zeros((1, 2)), r.normal(size=(2, 2)), r.normal(size=(3, 2))):
        x = np.asarray(x, np.float32)
        for damping, rounds in ((0.5, 0), (0.5, 45), (0.9, 110)):
            want = G.exemplars_of(G.similarities(x), damping, rounds)
            for near, crowd in ((1, 2.0), (6, 2.0), (6, 0.2), (128, 0.5)):
                assert (G.exemplars_of_points(x, damping=damping, rounds=rounds, near=near, crowd=crowd) == want).all()
    x = r.normal(size=(1800, 24))
    tracemalloc.start()
    got = G.exemplars_of_points(x, rounds=12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == G.exemplars_of(G.similarities(x), rounds=12)).all()
    assert peak < 1800 * 1800 * 8  # with matrices: 3.2 of them
    rows = [(i, i % 2, x[i].tolist()) for i in range(1200)]
    labels = {e.id: e.label for e in G.group_labels(spark.createDataFrame(rows, "id long, part int, vec array<double>"), "part", G.affinity_propagation).collect()}
    for part in (0, 1):
        assert [labels[i] for i in range(part, 1200, 2)] == G.affinity_propagation(distance_block(x[part:1200:2], x[part:1200:2])).tolist()


def test_stream(spark, tmp_path):
    from skeinwork.streaming.scores import score_stream, to_parquet

    p = frame(spark, cloud())
    p.write.parquet(f"file://{tmp_path}/in")
    model = L.fit_pca(p, 1)
    stream = score_stream(spark.readStream.schema(p.schema).parquet(f"file://{tmp_path}/in"), model, (0.0, 2.0))
    to_parquet(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(60)
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert got.count() == 60 and got.where("abs(novelty * 2 - error) > 1e-9").count() == 0


def test_layout(spark):
    df = spark.createDataFrame([(i, float(i // 4)) for i in range(16)], "id long, v double")
    assert {r.bin for r in W.equal_depth_lineup(df, "v", 4).collect()} == {0, 1, 2, 3}
    imgs = [W.blank(3, 2, (i / 5, 0, 0)) for i in range(5)]
    assert W.montage(imgs, 1).shape == (2 * 2 + 1, 3 * 3 + 2, 3)
    assert W.pad_crop(imgs[0], 5, 5).shape == (5, 5, 3) and W.framed(imgs[0], 2).shape == (6, 7, 3)
    assert W.joined(imgs[:2], True).shape == (4, 3, 3)


def test_other_clusterings(spark):
    x = cloud()
    d = distance_block(x, x)
    side = np.arange(60) // 30
    a = G.agglomerative(d)
    assert (a == side).all() or (a == 1 - side).all()
    ap = G.affinity_propagation(d)
    assert all(side[e] == side[i] for i, e in enumerate(ap))
    tree = G.tree_of(np.arange(60), d)
    forest = G.modified_forest([(i, j, float(d[i, j])) for i, j in itertools.combinations(range(60), 2)])
    assert len(forest) < 59 and all(side[i] == side[j] for i, j, _ in forest)
    table, labels = K.quality_cuts(np.arange(60), tree)
    assert len(table) == 59 and len(labels) == 60
    levels = K.level_sequence(K.multiscale(frame(spark, x), "label"), "label").collect()
    assert min(r.level for r in levels) == 0


def test_samplers_and_figures(spark):
    from skeinwork.functions import samplers
    from skeinwork.plans import figures

    for kind in ("uniform", "gaussian", "exponential", "pareto"):
        assert samplers.blob(spark, 20, (1.0, 2.0), 0.5, kind, 2.0).count() == 20
    assert samplers.ring(spark, 9, (0, 0), 3, 0.1).count() == 9 and samplers.line(spark, 9, (0, 0), (1, 1), 0.1).count() == 9
    df = spark.range(100).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 2 == 0).alias("b"), F.col("id").cast("double").alias("y"))
    assert figures.correlation_series(df, "b", "x", 9).agg(F.sum("n")).first()[0] == 100
    assert figures.reversed_series(df, "b", "y").count() == 2
    assert [r.passed for r in figures.gated_correlations(df, ["x", "y"], "y").collect()] == [False, True]


def test_group_forests_and_labels(spark):
    """Two separate rings of points a group: labels tell the halves, and a forest joins halves only by what
    is shorter than the greater mean edge."""
    rows, at = [], 0
    for g in (0, 1):
        for half in (0.0, 50.0):
            for k in range(8):
                rows.append((at, g, [half + float(np.cos(k)), float(np.sin(k)) + g]))
                at += 1
    p = spark.createDataFrame(rows, "id long, part int, vec array<double>")
    for method in (G.agglomerative, G.affinity_propagation):
        got = {r.id: (r.part, r.label) for r in G.group_labels(p, "part", method).collect()}
        assert set(got) == set(range(32)) and all(got[i][0] == i // 16 for i in got)
        halves = [{got[i][1] for i in range(s, s + 8)} for s in (0, 8, 16, 24)]
        assert halves[0].isdisjoint(halves[1]) and halves[2].isdisjoint(halves[3])
    edges = N.pairwise(p, "part").select("part", F.col("i").alias("fr"), F.col("j").alias("to"), "d")
    got, every = G.group_modified_forests(edges, "part").collect(), edges.collect()
    for g in (0, 1):
        want = G.modified_forest([(r.fr, r.to, r.d) for r in every if r.part == g])
        assert sorted((r.fr, r.to) for r in got if r.part == g) == sorted((a, b) for a, b, _ in want)
        assert all(r.fr // 8 == r.to // 8 for r in got)
    reps = G.simple_representatives(p.withColumnRenamed("part", "label"), 0.3)
    assert len({i for _, ids in reps for i in ids}) == sum(len(ids) for _, ids in reps) <= 32


def test_trees_of_points_keep_no_matrix():
    """Prim's rows give Kruskal's tree, ties and copies too, in memory far under a distance matrix."""
    import tracemalloc

    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(120, 5)), rng.integers(0, 3, (90, 3)).astype(float), np.zeros((20, 2)), np.repeat(rng.normal(size=(30, 4)), 3, 0), rng.normal(size=(1, 4))):
        assert G.tree_of_points(x) == G.tree_of(np.arange(len(x)), distance_block(x, x))
    x = rng.normal(size=(1500, 8))
    tracemalloc.start()
    G.tree_of_points(x)
    assert tracemalloc.get_traced_memory()[1] < 1500 * 1500 * 8 / 4
    tracemalloc.stop()


def test_tables_without_lists(spark):
    """Links alone give the pairs, statistics and choices that whole lists of points give."""
    x = np.concatenate([cloud(), np.cumsum(np.linspace(1, 2, 40))[:, None] * [9.0, 0.0]])
    p = frame(spark, x)
    whole = K.multiscale(p, "label")
    bare = K.multiscale(p, "label", lists=False)
    assert "vertices" not in bare.columns and sorted(bare.collect()) == sorted(whole.select(bare.columns).collect())
    got = sorted(K.overlaps(bare, "label", held=50).collect())
    assert got and got == sorted(K.overlaps(whole, "label").collect())
    assert sorted(K.isolation(p, K.multiscale(p, "label", tops=True), "label").collect()) == sorted(K.isolation(p, whole, "label").collect())
    t = K.dendrogram(np.arange(len(x)), G.tree_of_points(x))
    for choose in (K.decant_best, K.condense_best, K.find_all_largest):
        assert list(choose(t)["id"]) == list(choose(t.drop(columns=["lo", "hi"]))["id"])


def test_search_in_chunks(spark, monkeypatch):
    """Neighbours, radii and exemplars are those of whole matrices, with copies and far from the origin."""
    monkeypatch.setattr(N, "CHUNK", 32)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(90, 3)), rng.integers(0, 2, (60, 3)).astype(float)]) + 1e4
    p = frame(spark, x).withColumn("label", (F.col("id") % 3).cast("int"))
    d = distance_block(x, x)
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(150), d.shape), d), axis=1)
    got = {(r.i, r["rank"]): (r.j, r.d) for r in N.nearest(p, 7, block=40).collect()}
    assert got == {(i, k + 1): (order[i, k], d[i, order[i, k]]) for i in range(150) for k in range(7)}
    got = {(r.i, r["rank"]): r.j for r in N.nearest(p, 7, within="label", block=40).collect()}
    assert got == {(i, k + 1): [j for j in order[i] if j % 3 == i % 3][k] for i in range(150) for k in range(7)}
    assert {(r.i, r.j) for r in N.radius_pairs(p, 1.0, block=40).collect()} == {(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= 1.0}
    assert {r.i: sorted(np.frombuffer(r.js, "<i8").tolist()) for r in N.radius_lists(p, 1.0).collect()} == {i: np.flatnonzero(d[i] <= 1.0).tolist() for i in range(150)}
    cats = p.select("id", F.col("label").alias("category"))
    near, named = N.nearest(p, 20).cache(), p.withColumnRenamed("label", "category")
    for skip in (0, 2):
        assert sorted(R.exemplars_of(named, 20, 5, skip).collect()) == sorted(R.exemplars(near, cats, 5, skip).collect())
    a, b = (sorted(t.collect()) for t in (R.alternative_exemplars_of(named, 20, 5), R.alternative_exemplars(near, cats, 20, 5, exclude=True)))
    assert [r[:3] for r in a] == [r[:3] for r in b] and np.allclose([r[3:] for r in a], [r[3:] for r in b])


def test_chains_of_a_forest_in_parts(spark):
    """Many parts give each pair once, of one tree alone, without a group too."""
    edges = [(0, 5, 2.0), (5, 3, 1.0), (3, 9, 4.0), (20, 21, 1.0), (21, 22, 1.0)]
    got = G.chain_distances(spark.createDataFrame(edges, "fr long, to long, d double"), held=2).collect()
    assert sorted(map(tuple, got)) == [(0, 3, 2.0), (0, 5, 2.0), (0, 9, 4.0), (3, 5, 1.0), (3, 9, 4.0), (5, 9, 4.0), (20, 21, 1.0), (20, 22, 1.0), (21, 22, 1.0)]


def test_pairs_in_blocks(spark):
    x = cloud(4, 50)
    p = frame(spark, np.concatenate([x, [[0.0, 0.0]]])).withColumn("label", (F.col("id") % 3).cast("int"))
    for metric in ("euclidean", "cosine"):
        d = distance_block(np.concatenate([x, [[0.0, 0.0]]]), np.concatenate([x, [[0.0, 0.0]]]), metric)
        got = {(r.i, r.j): r.d for r in N.pairwise(p, "label", metric, block=7).collect()}
        assert set(got) == {(i, j) for i, j in itertools.combinations(range(51), 2) if i % 3 == j % 3}
        assert all((v is None and np.isnan(d[k])) or abs(v - d[k]) < 1e-12 for k, v in got.items())


def test_labels_and_forests_of_half_matrices():
    """Average linkage against the plain search of the whole matrix, and forests against a plain walk; ties too."""

    def plain_linkage(d, clusters=2):
        d = d.copy()
        np.fill_diagonal(d, np.inf)
        label, count = np.arange(len(d)), np.ones(len(d))
        for _ in range(len(d) - clusters):
            a, b = sorted(np.unravel_index(d.argmin(), d.shape))
            d[a] = d[:, a] = (count[a] * d[a] + count[b] * d[b]) / (count[a] + count[b])
            d[b] = d[:, b] = d[a, a] = np.inf
            count[a] += count[b]
            label[label == b] = a
        return np.unique(label, return_inverse=True)[1]

    def plain_forest(edges):
        tree = {}
        out = []
        for a, b, d in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
            x, y = tree.setdefault(a, [{a}, 0.0]), tree.setdefault(b, [{b}, 0.0])
            m, n = len(x[0]), len(y[0])
            if x is y or (m > 1 and n > 1 and d >= max(x[1], y[1])):
                continue
            new = [x[0] | y[0], (d + (m - 1) * x[1] + (n - 1) * y[1]) / (m + n - 1)]
            tree.update(dict.fromkeys(new[0], new))
            out.append((a, b, d))
        return out

    rng = np.random.default_rng(9)
    for x in (rng.normal(size=(70, 3)), rng.integers(0, 3, (60, 2)).astype(float), np.repeat(rng.normal(size=(20, 2)), 2, 0), rng.normal(size=(2, 2)), rng.normal(size=(1, 2))):
        d = distance_block(x, x)
        for clusters in (2, 5):
            want = plain_linkage(d, clusters)
            assert (G.agglomerative(d, clusters) == want).all() and (G.average_linkage(*G.condensed(x), clusters) == want).all()
        edges = [(i, j, float(d[i, j])) for i, j in itertools.combinations(range(len(x)), 2)]
        assert G.modified_forest(edges) == plain_forest(edges) == G.modified_forest_of_points(x, held=50)


def test_growth_offers_one_neighbour_at_a_time():
    """Typicality by a heap of all outside neighbours, on a graph with ties."""
    import heapq

    rng = np.random.default_rng(2)
    near = {i: sorted((float(rng.integers(1, 6)), int(j)) for j in rng.choice(40, 6, False) if j != i) for i in range(40)}
    for src in range(40):
        inside, heap, longest, total, steps = {src}, list(near[src]), 0.0, 0.0, 0
        heapq.heapify(heap)
        while heap and len(inside) < 15:
            d, j = heapq.heappop(heap)
            if j not in inside:
                inside.add(j)
                longest, steps = max(longest, d), steps + 1
                total += longest
                for e in near[j]:
                    heapq.heappush(heap, e)
        assert G.prim_typicality(src, near, 15) == total / steps
