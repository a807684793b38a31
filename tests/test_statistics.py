import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.functions import tails
from skeinwork.operators import aggregates as A
from skeinwork.operators import inference as I



def test_pearson_tail_of_recorded_result():
    ns = np.arange(90_055, 90_166)
    p = tails.pearson_p(np.full(len(ns), 0.1118), ns)
    assert p.min() < 1.56e-248 < p.max() or abs(np.log10(p).mean() - np.log10(1.56e-248)) < 1.5


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 10, 0.0733880), (0.0, 5, 1.0), (-3.5, 30, 0.0014776), (1.96, 1e6, 0.0499958)])
def test_t(t, df, p):
    assert abs(float(tails.t_two_sided(t, df)[0]) - p) < 1e-6


def test_quantiles_invert():
    assert np.allclose(tails.t_quantile([0.975, 0.025, 0.5], 10), [2.2281389, -2.2281389, 0], atol=1e-6)
    assert np.allclose(tails.beta_quantile([0.5], 2.0, 2.0), [0.5])
    assert np.allclose(tails.normal_quantile([0.975]), [1.959964], atol=1e-6)
    assert np.allclose(tails.chi2_tail([3.841459, 18.307038], [1, 10]), [0.05, 0.05], atol=1e-6)
    assert abs(tails.fisher_exact(1, 9, 11, 3) - 0.002759456) < 1e-8


def test_holm(spark):
    ps = [0.01, 0.04, 0.03, 0.005]
    got = {r.col: r.rejected for r in I.holm(spark.createDataFrame([(str(i), p) for i, p in enumerate(ps)], "col string, p double")).collect()}
    assert got == {"0": True, "1": False, "2": False, "3": True}
    edge = I.holm(spark.createDataFrame([("a", 0.025), ("b", 0.05)], "col string, p double"))
    assert all(r.rejected for r in edge.collect())


def test_registry(spark):
    reg = I.TestRegistry()
    for c, p in (("a", 0.001), ("b", 0.5)):
        reg.register(spark.createDataFrame([(c, p)], "col string, p double"))
    assert {r.col: r.rejected for r in reg.resolve().collect()} == {"a": True, "b": False}


def test_associations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    rows = [(float(v), bool(v + rng.normal() > 0), float(2 * v + rng.normal()), "s") for v in x]
    df = spark.createDataFrame(rows, "y double, flag boolean, num double, txt string")
    got = {r.col: r for r in I.association_tests(df, ["flag", "num", "txt"], "y").collect()}
    assert got["num"].test == "r" and abs(got["num"].effect - np.corrcoef(x, [r[2] for r in rows])[0, 1]) < 1e-9
    assert got["flag"].test == "δμ" and got["flag"].p < 1e-20 and got["txt"].p == 1.0
    one = I.welch(df, F.col("flag"), F.col("y")).first()
    assert abs(one.t - got["flag"].statistic) < 1e-9 and abs(one.df - got["flag"].df) < 1e-6


def test_agreement_and_ratings(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "x"), (3, None), (3, None), (4, "q"), (4, "q")], "i long, v string")
    assert {r.i: r.agreement for r in A.percent_agreement(df, "i", "v").collect()} == {1: 1 / 3, 2: None, 3: 0.0, 4: 1.0}
    r = A.null_rating_summary(spark.createDataFrame([(1, 3), (1, None), (1, 5), (2, None), (2, None), (2, 1)], "i long, v int"), ["i"], "v")
    got = {x.i: x for x in r.collect()}
    assert (got[1].median, got[1].mean, got[1].intensity) == (4.0, 4.0, 2.0) and abs(float(got[1].neutral) - 1 / 3) < 1e-9
    assert got[2].median is None and got[2].mean is None


def test_bins(spark):
    df = spark.createDataFrame([(0.0, 1.0), (50.0, 3.0), (10.0, None)], "x double, v double")
    got = A.binned(df, "x", F.col("v"), A.linear_bins(0, 50, 5)).orderBy("bin").collect()
    assert [(r.n, r.mean) for r in got] == [(1, 1.0), (1, None), (0, None), (0, None), (1, 3.0)]
    assert [round(b[2], 4) for b in A.log_bins(4)[:2]] == [-0.6931, 0.4055]
    assert {r.bin: r.n for r in A.histogram(df, "x", 10).collect()} == {0: 1, 2: 1, 9: 1}


def test_bootstrap_and_fit():
    lo, hi = I.bootstrap_interval(np.arange(12.0), samples=2000)
    assert 3 < lo < 5.5 < hi < 8
    assert I.bootstrap_interval(np.ones(4)) == (1.0, 1.0)
    x = np.linspace(0, 5, 30)
    assert np.allclose(I.exponential_fit(x, 3 * np.exp(-0.7 * x) + 1), (3, -0.7, 1), atol=1e-3)


def test_strength(spark):
    s = lambda c, v: spark.range(1).select(I.strength(c, F.lit(v)).alias("x")).first().x
    assert s("genres(Music)", 0.0255) == "+0.26% Music" and s("log_posts", 1.0) == "×1.11" and s("plain", 2.5) == "2.5"


def test_bootstrap_query_takes_the_default(spark):
    from skeinwork.plans.catalog import QUERIES

    d = "/root/testdata/sf0.01"
    values = {}
    for r in spark.read.parquet(f"{d}/supplier.parquet").select("s_nationkey", "s_acctbal").collect():
        values.setdefault(r.s_nationkey, []).append(float(r.s_acctbal))
    got = {r.g: (r.low, r.high) for r in QUERIES["bootstrap_ci"](spark, d).collect()}
    assert got
    for g, ci in got.items():
        assert ci == I.bootstrap_interval(np.sort(values[g]))


def test_cluster_significance_of_all_kinds(spark):
    """Each verdict against the interval and test of its own kind; one group is out of line in everything."""
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 4}" if i < 400 else "few" if i < 410 else None, bool(rng.random() < (0.9 if i < 400 and i % 4 == 0 else 0.3)), "ab"[int(rng.random() < (0.95 if i < 400 and i % 4 == 0 else 0.4))], float(rng.normal(5.0 if i < 400 and i % 4 == 0 else 0.0))) for i in range(420)]
    df = spark.createDataFrame(rows, "g string, flag boolean, cat string, x double")
    got = {(r.g, r.column, r.value): r for r in I.cluster_significance(df, "g", ["flag", "cat", "x"]).collect()}
    assert set(got) == {(f"g{k}", c, v) for k in range(4) for c, v in (("flag", None), ("cat", "a"), ("cat", "b"), ("x", None))}
    shared = 1 - 0.95 ** (1 / 12)
    for column, test in (("flag", I.fisher_by_group), ("cat", I.chi2_by_group), ("x", I.welch_by_group)):
        p = {r.g: r.p for r in test(df, "g", column).collect()}
        assert all(abs(r.p - p[g]) < 1e-12 and r.diff == (p[g] < shared) for (g, c, _), r in got.items() if c == column)
    low = {r.g: (r.low, r.high) for r in I.jeffreys_intervals(df.where("g IS NOT NULL"), "g", "flag", shared).collect()}
    assert all((got[g, "flag", None].low, got[g, "flag", None].high) == low[g] for g in ("g0", "g1", "g2", "g3"))
    assert got["g0", "flag", None].side == got["g0", "cat", "b"].side == got["g0", "x", None].side == "large" and got["g0", "cat", "a"].side == "small"
    assert all(got["g0", c, v].diff for c, v in (("flag", None), ("cat", "a"), ("x", None)))
    assert abs(got["g1", "cat", "a"].mean + got["g1", "cat", "b"].mean - 1) < 1e-12


def test_intervals_by_type(spark):
    df = spark.createDataFrame([("s", float(i % 5)) for i in range(9)] + [("l", float(i % 7)) for i in range(40)], "g string, x double")
    got = {r.g: (r.low, r.high) for r in I.value_intervals(df, "g", "x").collect()}
    small, wide = I.bootstrap_intervals(df, "g", "x").first(), {r.g: r for r in I.mean_intervals(df, "g", "x").collect()}["l"]
    assert got["s"] == (small.low, small.high) and got["l"] == (wide.mean - wide.half, wide.mean + wide.half)
