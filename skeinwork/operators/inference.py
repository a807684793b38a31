"""Tests, intervals and corrections for many tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from skeinwork.functions import tails
from skeinwork.params import Items

TESTS = "col string, against string, test string, effect double, statistic double, df double, slope double, intercept double, p double"


def t_p(t: Column, df: Column) -> Column:
    two_sided = tails.t_two_sided

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(two_sided(t.to_numpy(float), df.to_numpy(float))).where(t.notna().to_numpy() & df.notna().to_numpy())

    return p(t, df)


def welch(df: DataFrame, flag: Column, value: Column) -> DataFrame:
    """One row: n, means and variances by flag, the difference of means, t and its degrees of freedom;
    one aggregation for all."""
    v = value.cast("double")
    stats = [f(F.when(flag == b, v)).alias(f"{k}{i}") for i, b in ((1, True), (0, False)) for k, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    s0, s1 = F.col("var0") / F.col("n0"), F.col("var1") / F.col("n1")
    spread = s0 + s1
    out = df.agg(*stats)
    return out.select(
        "n1", "n0", (F.col("mean1") - F.col("mean0")).alias("effect"), ((F.col("mean1") - F.col("mean0")) / F.sqrt(F.nullif(spread, F.lit(0.0)))).alias("t"),
        (spread * spread / F.nullif(s0 * s0 / (F.col("n0") - 1) + s1 * s1 / (F.col("n1") - 1), F.lit(0.0))).alias("df"),
    )


def pearson(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: n, r, t and the least-squares line of y on x."""
    a, b = x.cast("double"), y.cast("double")
    out = df.where(a.isNotNull() & b.isNotNull()).agg(F.count("*").alias("n"), F.corr(a, b).alias("r"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))
    r = F.col("r")
    return out.withColumn("t", r * F.sqrt((F.col("n") - 2) / F.greatest(1 - r * r, F.lit(1e-300))))


def association_tests(df: DataFrame, columns: list[str], against: str) -> DataFrame:
    """One row of TESTS a column: Welch's t of `against` by a boolean column, Pearson's r with a numeric
    one, and for others no test and p = 1. All columns are aggregated in one pass."""
    kinds, y = dict(df.dtypes), F.col(against).cast("double")
    aggs, rows = [], []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        if kinds[c] == "boolean":
            for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)):
                aggs += [f(F.when(x, y)).alias(f"{k}1_{i}"), f(F.when(~x, y)).alias(f"{k}0_{i}")]
        elif kinds[c] in ("double", "float", "bigint", "int", "smallint", "tinyint") or kinds[c].startswith("decimal"):
            both = x.isNotNull() & y.isNotNull()
            aggs += [F.count(F.when(both, 1)).alias(f"n_{i}"), F.corr(x.cast("double"), y).alias(f"r_{i}")]
            x = F.when(both, x.cast("double"))
        else:
            rows.append(F.struct(F.lit(c).alias("col"), F.lit("?").alias("test"), *[F.lit(None).cast("double").alias(k) for k in ("effect", "statistic", "df", "slope", "intercept")]))
            continue
        number = F.when(x, 1.0).when(~x, 0.0) if kinds[c] == "boolean" else x
        aggs += [F.regr_slope(number, y).alias(f"slope_{i}"), F.regr_intercept(number, y).alias(f"icpt_{i}")]
        if kinds[c] == "boolean":
            n1, n0, v1, v0 = (F.col(f"{k}_{i}") for k in ("n1", "n0", "v1", "v0"))
            effect, s1, s0 = F.col(f"m1_{i}") - F.col(f"m0_{i}"), v1 / F.nullif(n1, F.lit(0)), v0 / F.nullif(n0, F.lit(0))
            stat = effect / F.sqrt(F.nullif(s1 + s0, F.lit(0.0)))
            dof = (s1 + s0) * (s1 + s0) / F.nullif(s1 * s1 / F.nullif(n1 - 1, F.lit(0)) + s0 * s0 / F.nullif(n0 - 1, F.lit(0)), F.lit(0.0))
            name = "δμ"
        else:
            effect, dof = F.col(f"r_{i}"), F.col(f"n_{i}").cast("double") - 2
            stat, name = effect * F.sqrt(dof / F.greatest(1 - effect * effect, F.lit(1e-300))), "r"
        rows.append(F.struct(F.lit(c).alias("col"), F.lit(name).alias("test"), effect.alias("effect"), stat.alias("statistic"), dof.alias("df"), F.col(f"slope_{i}").alias("slope"), F.col(f"icpt_{i}").alias("intercept")))
    out = df.agg(*(aggs or [F.count("*")])).select(F.explode(F.array(*rows)).alias("t")).select(F.lit(against).alias("against"), "t.*")
    p = F.when(F.col("test") == "?", F.lit(1.0)).otherwise(t_p(F.col("statistic"), F.col("df")))
    return out.withColumn("p", p).select(*[c.split()[0] for c in TESTS.split(", ")])


def strength(col: str, slope: Column) -> Column:
    """Text of what ten units of the other column do to a boolean (percent, with the unit in the
    parentheses of its name) or to a logarithmic column (a factor); else the plain slope."""
    if col.startswith("log_"):
        return F.concat(F.lit("×"), significant(F.exp(slope / 10), 3))
    if "(" in col:
        unit = col[col.index("(") + 1 : col.rindex(")")] if ")" in col else ""
        return F.concat(F.when(slope >= 0, "+").otherwise(""), significant(slope * 10, 2), F.lit(f"% {unit}"))
    return slope.cast("string")


def significant(x: Column, digits: int) -> Column:
    """x rounded to so many significant digits, as text."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.nullif(F.abs(x), F.lit(0.0)))))
    return F.coalesce((F.rint(x * scale) / scale).cast("string"), F.lit("0.0"))


def holm(tests: DataFrame, alpha: float = 0.05, p: str = "p", ties: str = "col") -> DataFrame:
    """`tests` plus rank and rejected: in the order of p, all up to the first p > alpha / (m - rank + 1).
    The table has one row a test, so one task may order it."""
    order = Window.orderBy(F.col(p), F.col(ties))
    ranked = tests.crossJoin(F.broadcast(tests.agg(F.count("*").alias("_m")))).withColumn("rank", F.row_number().over(order))
    passed = F.col(p) <= alpha / (F.col("_m") - F.col("rank") + 1)
    return ranked.withColumn("_ok", passed).withColumn("rejected", F.bool_and("_ok").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_ok", "_m")


class TestRegistry:
    """Collects test tables of a whole run, and resolves them at once."""

    __test__ = False

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def register(self, tests: DataFrame) -> None:
        self.tables.append(tests)

    def resolve(self, alpha: float = 0.05) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return holm(out, alpha)


def sidak(alpha: Column | float, tests: Column) -> Column:
    return 1.0 - F.pow(1.0 - (alpha if isinstance(alpha, Column) else F.lit(alpha)), 1.0 / tests)


def mean_intervals(df: DataFrame, group: str, value: str, bound: float = 0.05) -> DataFrame:
    """(group, n, mean, half): the mean's confidence interval is mean ± half, of the population's
    standard deviation and the t distribution."""
    quantile = tails.t_quantile

    @F.pandas_udf("double")
    def t_q(df: pd.Series) -> pd.Series:
        return pd.Series(quantile(np.full(len(df), 1 - bound / 2), np.maximum(df.to_numpy(float), 1)))

    s = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return s.select(group, "n", "mean", "sd", F.when(F.col("n") > 1, t_q((F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt("n")).alias("half"))


def with_jeffreys(counts: DataFrame, bound: float = 0.05) -> DataFrame:
    """`counts` (with columns n and hits) plus low and high of the proportion hits / n."""
    quantile = tails.beta_quantile

    @F.pandas_udf("low double, high double")
    def ci(x: pd.Series, n: pd.Series) -> pd.DataFrame:
        a, b = x.to_numpy(float) + 0.5, (n - x).to_numpy(float) + 0.5
        return pd.DataFrame({"low": quantile(np.full(len(x), bound / 2), a, b), "high": quantile(np.full(len(x), 1 - bound / 2), a, b)})

    return counts.withColumn("_ci", ci("hits", "n")).select(*counts.columns, "_ci.low", "_ci.high")


def jeffreys_intervals(df: DataFrame, group: str, flag: str, bound: float = 0.05) -> DataFrame:
    """(group, n, hits, low, high) of a proportion."""
    s = df.groupBy(group).agg(F.count(flag).alias("n"), F.sum(F.col(flag).cast("long")).alias("hits"))
    return with_jeffreys(s.select(group, "n", "hits"), bound)


def bootstrap_interval(x: np.ndarray, statistic=np.mean, bound: float = Items.alpha, samples: int = Items.bootstrap_samples, seed: int = 17) -> tuple[float, float]:
    """Bias-corrected and accelerated bootstrap; if all values are alike, that value twice."""
    x = np.asarray(x, float)
    if len(x) == 0:
        return float("nan"), float("nan")
    if np.all(x == x[0]):
        return float(statistic(x)), float(statistic(x))
    rng = np.random.default_rng(seed)
    draws = np.sort(np.array([statistic(x[i]) for i in rng.integers(0, len(x), (max(samples, int(2 / bound)), len(x)))]))
    z0 = tails.normal_quantile(np.clip(np.mean(draws < statistic(x)), 1e-6, 1 - 1e-6))[0]
    jack = np.array([statistic(np.delete(x, i)) for i in range(len(x))])
    d = jack.mean() - jack
    a = (d**3).sum() / max(6 * (d**2).sum() ** 1.5, 1e-300)
    z = z0 + tails.normal_quantile([bound / 2, 1 - bound / 2])
    q = tails.normal_cdf(z0 + z / (1 - a * z))
    return tuple(float(v) for v in np.quantile(draws, q))


def bootstrap_intervals(df: DataFrame, group: str, value: str, cutoff: int = Items.bootstrap_cutoff, bound: float = Items.alpha, samples: int = Items.bootstrap_samples) -> DataFrame:
    """(group, n, low, high) of the mean, for groups of fewer than `cutoff` values; only those are gathered."""
    interval = bootstrap_interval
    small = df.groupBy(group).agg(F.count(value).alias("n"), F.count("*").alias("_rows")).where((F.col("n") < cutoff) & (F.col("n") > 0))
    values = df.where(F.col(value).isNotNull()).join(small.select(group, "n"), group).groupBy(group, "n").agg(F.collect_list(F.col(value).cast("double")).alias("x"))

    @F.pandas_udf("low double, high double")
    def ci(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([interval(np.sort(v), bound=bound, samples=samples) for v in x], columns=["low", "high"])

    return values.withColumn("ci", ci("x")).select(group, "n", "ci.low", "ci.high")


def fisher_by_group(df: DataFrame, group: str, flag: str) -> DataFrame:
    """(group, a, b, c, d, p): true and false rows in the group, and in all rows (members included)."""
    exact = tails.fisher_exact

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([exact(*map(int, r)) for r in zip(a, b, c, d)])

    f = F.col(flag)
    counts = df.groupBy(group).agg(F.count(F.when(f, 1)).alias("a"), F.count(F.when(~f, 1)).alias("b"))
    overall = df.agg(F.count(F.when(f, 1)).alias("c"), F.count(F.when(~f, 1)).alias("d"))
    return counts.crossJoin(F.broadcast(overall)).withColumn("p", p("a", "b", "c", "d"))


def chi2_by_group(df: DataFrame, group: str, category: str) -> DataFrame:
    """(group, chi2, df, p) of a group's category counts against those of all rows; each group's counts
    are raised by 1 / (rows of the group), and one degree of freedom gets Yates's correction."""
    tail = tails.chi2_tail

    @F.pandas_udf("double")
    def p(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(np.where(df > 0, tail(x.to_numpy(float), np.maximum(df.to_numpy(float), 1)), 1.0))

    rows = df.where(F.col(category).isNotNull())
    overall = rows.groupBy(F.col(category).alias("cat")).agg(F.count("*").alias("all_n"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("gn"))
    cells = rows.groupBy(F.col(group).alias("g"), F.col(category).alias("cat")).agg(F.count("*").alias("k"))
    grid = sizes.withColumnRenamed(group, "g").crossJoin(F.broadcast(overall)).join(cells, ["g", "cat"], "left")
    grid = grid.withColumn("o1", F.coalesce("k", F.lit(0)) + 1.0 / F.col("gn")).withColumn("o2", F.col("all_n").cast("double"))
    w = Window.partitionBy("g")
    s1, s2, col = F.sum("o1").over(w), F.sum("o2").over(w), F.col("o1") + F.col("o2")
    grid = grid.select("g", "o1", "o2", (s1 * col / (s1 + s2)).alias("e1"), (s2 * col / (s1 + s2)).alias("e2"), (F.count("*").over(w) - 1).alias("df"))

    def cell(o: str, e: str) -> Column:
        off = F.abs(F.col(o) - F.col(e))
        off = F.when(F.col("df") == 1, F.greatest(off - F.least(F.lit(0.5), off), F.lit(0.0))).otherwise(off)
        return off * off / F.col(e)

    out = grid.groupBy("g", "df").agg(F.sum(cell("o1", "e1") + cell("o2", "e2")).alias("chi2"))
    return out.select(F.col("g").alias(group), "chi2", "df", p("chi2", F.col("df").cast("double")).alias("p"))


def welch_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, t, df, p) of a group's values against those of all rows (members included)."""
    v = F.col(value).cast("double")
    s = df.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))
    wide = s.crossJoin(F.broadcast(df.agg(F.count(v).alias("all_n"), F.avg(v).alias("all_mean"), F.var_samp(v).alias("all_var"))))
    a, b = F.col("var") / F.col("n"), F.col("all_var") / F.col("all_n")
    t = (F.col("mean") - F.col("all_mean")) / F.sqrt(F.nullif(a + b, F.lit(0.0)))
    dof = (a + b) * (a + b) / F.nullif(a * a / F.nullif(F.col("n") - 1, F.lit(0)) + b * b / (F.col("all_n") - 1), F.lit(0.0))
    return wide.select(group, "n", "mean", t.alias("t"), dof.alias("df")).withColumn("p", t_p(F.col("t"), F.col("df")))


def cluster_report(df: DataFrame, group: str, value: str, least: int = Items.significant_size, alpha: float = Items.alpha, columns: int = 1) -> DataFrame:
    """Verdicts on a numeric column in groups of `least` rows and more: small or large if the group's
    interval lies under or over that of all rows, diff if Welch's p is under the shared alpha."""
    big = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(group)
    m = max(1, big.count() * columns)
    shared = 1 - (1 - alpha) ** (1 / m)
    overall = mean_intervals(df.withColumn("_all", F.lit(0)), "_all", value, shared).select(F.col("mean").alias("all_mean"), F.col("half").alias("all_half"))
    own = mean_intervals(df.join(big, group, "left_semi"), group, value, shared)
    p = welch_by_group(df, group, value).select(group, "p")
    out = own.join(p, group).crossJoin(F.broadcast(overall))
    side = F.when(F.col("mean") + F.col("half") < F.col("all_mean") - F.col("all_half"), "small").when(F.col("mean") - F.col("half") > F.col("all_mean") + F.col("all_half"), "large")
    return out.select(group, "n", "mean", "half", "p", side.alias("side"), (F.col("p") < shared).alias("diff"))


def kind_of(df: DataFrame, column: str) -> str:
    """boolean, number or category, by the column's type."""
    t = df.schema[column].dataType
    return "boolean" if isinstance(t, BooleanType) else "number" if isinstance(t, NumericType) else "category"


def value_intervals(df: DataFrame, group: str, column: str, bound: float = Items.alpha, cutoff: int = Items.bootstrap_cutoff) -> DataFrame:
    """(group, value, n, mean, low, high) with the interval that suits the column's type: Jeffreys's of a
    boolean's share and of each category's share (`value` names it; of the group's rows that have a
    category), the t interval of a number's mean, or the bootstrap's for groups of under `cutoff` numbers."""
    kind, none = kind_of(df, column), F.lit(None).cast("string").alias("value")
    known = df.where(F.col(column).isNotNull()).select(F.col(group).alias("_g"), F.col(column).alias("_v"))
    if kind == "boolean":
        out = jeffreys_intervals(known, "_g", "_v", bound)
        return out.select(F.col("_g").alias(group), none, "n", (F.col("hits") / F.col("n")).alias("mean"), "low", "high")
    if kind == "category":
        values = F.broadcast(known.select(F.col("_v").cast("string").alias("value")).distinct())
        sizes = known.groupBy("_g").agg(F.count("*").alias("n"))
        hits = known.groupBy("_g", F.col("_v").cast("string").alias("value")).agg(F.count("*").alias("hits"))
        cells = sizes.crossJoin(values).join(hits, ["_g", "value"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
        cells = with_jeffreys(cells, bound)
        return cells.select(F.col("_g").alias(group), "value", "n", (F.col("hits") / F.col("n")).alias("mean"), "low", "high")
    wide = mean_intervals(known, "_g", "_v", bound)
    small = bootstrap_intervals(known, "_g", "_v", cutoff, bound).select(F.col("_g").alias("_s"), F.col("low").alias("_l"), F.col("high").alias("_h"))
    out = wide.join(small, wide["_g"] == small["_s"], "left")
    low, high = F.when(F.col("_s").isNotNull(), F.col("_l")).otherwise(F.col("mean") - F.col("half")), F.when(F.col("_s").isNotNull(), F.col("_h")).otherwise(F.col("mean") + F.col("half"))
    return out.select(F.col("_g").alias(group), none, "n", "mean", low.alias("low"), high.alias("high"))


def cluster_significance(df: DataFrame, group: str, columns: list[str], least: int = Items.significant_size, alpha: float = Items.alpha) -> DataFrame:
    """(group, column, kind, value, n, mean, low, high, all_mean, all_low, all_high, p, side, diff) of each
    column in each group of `least` rows and more; a category has a row for each of its values.

    side is small or large if the group's interval lies under or over that of all rows; diff tells whether
    the group differs from all rows (members included) by Fisher's test of a boolean, the smoothed chi
    square of a category or Welch's t of a number. Intervals and tests share alpha by Šidák's correction
    among all columns and groups. Groups are told by their own ids; a null group takes no part.
    """
    named = df.where(F.col(group).isNotNull())
    big = named.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(group)
    shared = 1 - (1 - alpha) ** (1 / max(1, big.count() * len(columns)))
    out = None
    for column in columns:
        kind = kind_of(df, column)
        test = {"boolean": fisher_by_group, "category": chi2_by_group, "number": welch_by_group}[kind]
        p = test(df, group, column).select(group, "p")
        own = value_intervals(named.join(F.broadcast(big), group, "left_semi"), group, column, shared)
        overall = value_intervals(df.withColumn("_all", F.lit(0)), "_all", column, shared)
        overall = overall.select(F.col("value").alias("_value"), *[F.col(c).alias(f"all_{c}") for c in ("mean", "low", "high")])
        rows = own.join(F.broadcast(overall), F.col("value").eqNullSafe(F.col("_value"))).join(p, group)
        side = F.when(F.col("high") < F.col("all_low"), "small").when(F.col("low") > F.col("all_high"), "large")
        rows = rows.select(group, F.lit(column).alias("column"), F.lit(kind).alias("kind"), "value", "n", "mean", "low", "high", "all_mean", "all_low", "all_high", "p", side.alias("side"), (F.col("p") < shared).alias("diff"))
        out = rows if out is None else out.unionByName(rows)
    return out


def residual_deviation(df: DataFrame, stat: str, against: str) -> DataFrame:
    """`df` plus `<stat>_<against>_deviation`, what the least-squares line leaves."""
    x, y = F.col(against).cast("double"), F.col(stat).cast("double")
    fit = df.agg(F.regr_slope(y, x).alias("_m"), F.regr_intercept(y, x).alias("_b"))
    return df.crossJoin(F.broadcast(fit)).withColumn(f"{stat}_{against}_deviation", y - (F.col("_m") * x + F.col("_b"))).drop("_m", "_b")


def exponential_fit(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float, float]:
    """a, b, c of a·exp(b·x) + c with a, c ≥ 0 and b ≤ 0, by damped Gauss-Newton, for small tables."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.array([max(np.ptp(y), 1e-6), -1.0 / max(np.ptp(x), 1e-6), max(y.min(), 0.0)])
    damp = 1e-2
    loss = lambda w: ((w[0] * np.exp(w[1] * x) + w[2] - y) ** 2).sum()
    for _ in range(rounds):
        e = np.exp(w[1] * x)
        j = np.column_stack([e, w[0] * x * e, np.ones_like(x)])
        step = np.linalg.solve(j.T @ j + damp * np.eye(3), j.T @ (y - w[0] * e - w[2]))
        new = np.array([max(w[0] + step[0], 0.0), min(w[1] + step[1], 0.0), max(w[2] + step[2], 0.0)])
        if loss(new) < loss(w):
            w, damp = new, damp / 3
        else:
            damp *= 4
    return tuple(w)
