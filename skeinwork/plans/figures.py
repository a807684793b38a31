"""The rows behind each figure: what a plot of one column against another would show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.aggregates import binned, group_quantiles, linear_bins
from skeinwork.operators.inference import pearson, sidak


def correlation_series(df: DataFrame, col: str, against: str, bins: int = 50) -> DataFrame:
    """(bin, centre, n, mean, overall): proportions of a boolean or means of a number by bins of `against`."""
    lo, hi = df.agg(F.min(against), F.max(against)).first()
    return binned(df, against, F.col(f"`{col}`"), linear_bins(float(lo), float(hi), bins))


def reversed_series(df: DataFrame, col: str, against: str, bins: int = 50) -> DataFrame:
    """Quantiles of `against` by a boolean's or category's values, or its means by bins of a number."""
    if dict(df.dtypes)[col] in ("boolean", "string"):
        return group_quantiles(df, col, against)
    return correlation_series(df, against, col, bins)


def gated_correlations(df: DataFrame, columns: list[str], against: str, alpha: float = 0.05) -> DataFrame:
    """(col, n, r, t, p, passed): Pearson's r with each column against the shared level of them all."""
    from skeinwork.operators.inference import t_p

    out = None
    for c in columns:
        one = pearson(df, F.col(f"`{c}`").cast("double"), F.col(against)).select(F.lit(c).alias("col"), "n", "r", "t")
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("p", t_p(F.col("t"), (F.col("n") - 2).cast("double")))
    return out.withColumn("passed", F.col("p") < sidak(alpha, F.lit(float(len(columns)))))
