"""Filters, subsets, top lists and strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.columns import any_of
from skeinwork.params import Items


def condition(entries: list[str]) -> Column:
    """All entries hold; an entry `a|b` is an OR of boolean columns, and `!a|b` the contrary of it."""
    terms = [~any_of(e[1:].split("|")) if e.startswith("!") else any_of(e.split("|")) for e in entries]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def subset(df: DataFrame, id_col: str, k: int, seed: int = 17) -> DataFrame:
    """k rows at most, chosen by a hash of the id and the seed: the same on every run and partitioning."""
    return df.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(k)


def extremes(df: DataFrame, by: str, id_col: str, k: int) -> DataFrame:
    """The k least and k greatest rows by a column, in a column `pool`."""
    low = df.orderBy(F.col(by), F.col(id_col)).limit(k).withColumn("pool", F.lit("least"))
    high = df.orderBy(F.col(by).desc(), F.col(id_col)).limit(k).withColumn("pool", F.lit("greatest"))
    return low.unionByName(high)


def percentile_pools(df: DataFrame, col: str) -> DataFrame:
    """`df` plus `pool`: 0 under the 10th percentile, 1 and 2 strictly between the 30th and 40th and the
    60th and 70th, 3 over the 90th; NULL elsewhere."""
    p = F.percentile(col, F.array(*map(F.lit, (0.1, 0.3, 0.4, 0.6, 0.7, 0.9))))
    x, q = F.col(col), (lambda i: F.get("_q", i))
    pool = F.when(x < q(0), 0).when((x > q(1)) & (x < q(2)), 1).when((x > q(3)) & (x < q(4)), 2).when(x > q(5), 3)
    return df.crossJoin(F.broadcast(df.agg(p.alias("_q")))).withColumn("pool", pool).drop("_q")


def pool_counts(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows of each pool, and those with each flag."""
    return df.where("pool IS NOT NULL").groupBy("pool").agg(F.count("*").alias("n"), *[F.sum(F.col(f"`{f}`").cast("long")).alias(f) for f in flags])


def per_group_sample(df: DataFrame, group: str, id_col: str, k: int, at_least: int = 1, seed: int = 17) -> DataFrame:
    """Up to k rows of each group that has `at_least` rows, by a hash of the id."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col)
    large = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= at_least).select(group)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r").join(large, group, "left_semi")


def feature_variety(df: DataFrame, vec: str) -> DataFrame:
    """(feature, distinct, modal, n) for each place of an array column, counted before the shuffle."""
    each = df.select(F.posexplode(vec).alias("feature", "v")).groupBy("feature", "v").agg(F.count("*").alias("c"))
    return each.groupBy("feature").agg(F.count("*").alias("distinct"), F.max("c").alias("modal"), F.sum("c").alias("n"))


def varied_features(df: DataFrame, vec: str, max_monotony: float = Items.max_monotony) -> DataFrame:
    """Features with more than one value of which none is more frequent than `max_monotony`, with the
    range that scales them."""
    keep = feature_variety(df, vec).where((F.col("distinct") > 1) & (F.col("modal") <= F.col("n") * max_monotony))
    span = df.select(F.posexplode(vec).alias("feature", "v")).groupBy("feature").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    return keep.join(span, "feature")
