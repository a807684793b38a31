"""Descriptive aggregates."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent_agreement(df: DataFrame, item: str, value: str) -> DataFrame:
    """Share of an item's pairs of observations that agree; NULL agrees with nothing, and fewer than
    two observations have no share. Counts of values take the place of pairs."""
    c = df.groupBy(item, value).agg(F.count("*").alias("c"))
    agree = F.sum(F.when(F.col(value).isNotNull(), F.col("c") * (F.col("c") - 1) / 2).otherwise(0.0))
    n = F.sum("c")
    return c.groupBy(item).agg(n.alias("n"), (agree / F.nullif(n * (n - 1) / 2, F.lit(0.0))).alias("agreement"))


def proportion(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def ordinal_summary(df: DataFrame, keys: list[str], rank: str, neutral: int = 4) -> DataFrame:
    """Per key: median and mean of the ranks above 0, share at `neutral`, sum of distances from it, and n.
    Rank 0 stands for "doesn't apply" and counts in the share's denominator alone."""
    r, real = F.col(rank), F.when(F.col(rank) > 0, F.col(rank))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.percentile(real, F.lit(0.5)).alias("median"), F.avg(real).alias("mean"),
        F.avg((r == neutral).cast("double")).alias("neutral"), F.sum(F.when(r > 0, F.abs(r - neutral)).otherwise(0)).cast("double").alias("intensity"),
    )


def rank_distribution(df: DataFrame, keys: list[str], rank: str, top: int) -> DataFrame:
    """Per key: observations of each rank from 0 to `top` as an array, and the share of pairs that agree."""
    counts = [F.count_if(F.col(rank) == i).alias(f"_{i}") for i in range(top + 1)]
    c = df.groupBy(*keys).agg(*counts, F.count(rank).alias("_n"))
    pairs = sum((F.col(f"_{i}") * (F.col(f"_{i}") - 1) / 2 for i in range(1, top + 1)), F.col("_0") * (F.col("_0") - 1) / 2)
    share = pairs / F.nullif(F.col("_n") * (F.col("_n") - 1) / 2, F.lit(0.0))
    return c.select(*keys, F.array(*[F.col(f"_{i}") for i in range(top + 1)]).alias("distribution"), share.alias("agreement"))


def expression_summary(df: DataFrame, item: str, scale: str, rank: str, scales: int, neutral: int = 4, top: int = 7) -> DataFrame:
    """Per item, over its scales: mean of 1 - the share at `neutral`, of the intensities, and of the shares
    of pairs that agree. Sums are divided by the number of scales that there are, rated or not; a scale
    with one rating has no agreement, and then neither has the item."""
    one = ordinal_summary(df, [item, scale], rank, neutral).join(rank_distribution(df, [item, scale], rank, top), [item, scale])
    agreement = F.when(F.count("agreement") == F.count("*"), F.sum("agreement") / scales)
    return one.groupBy(item).agg((F.sum(1 - F.col("neutral")) / scales).alias("simple"), (F.sum("intensity") / scales).alias("intensity"), agreement.alias("agreement"))


def null_rating_summary(df: DataFrame, keys: list[str], value: str, top: int = 5) -> DataFrame:
    """The same for ratings 1 to `top` with NULLs: they count in the neutral share's denominator, and a
    key with more NULLs than half has no median, mean or intensity."""
    v, n = F.col(value), F.count("*")
    neutral = 1 + top // 2
    enough = F.sum(v.isNull().cast("int")) * 2 <= n
    return df.groupBy(*keys).agg(
        n.alias("n"), F.sum(v.isNull().cast("long")).alias("missing"),
        F.when(enough, F.percentile(v, F.lit(0.5))).alias("median"), F.when(enough, F.avg(v)).alias("mean"),
        (F.sum(F.when(v == neutral, 1.0).otherwise(0.0)) / n).alias("neutral"), F.when(enough, F.sum(F.abs(v - neutral))).cast("double").alias("intensity"),
    )


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """(bin, n) of equal-width bins from the least to the greatest value, the last bin closed."""
    wide = df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))))
    place = F.floor((F.col(col) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins)
    return wide.groupBy(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def log_bins(top: float) -> list[tuple[float, float, float]]:
    """(from, to, centre) of bins for ln(x + 0.5): centres 0, 1, 2, 3 and then half as much again until
    `top`; edges halfway between centres, half a unit beyond the ends."""
    centres = [0.0, 1.0, 2.0, 3.0]
    while centres[-1] < top:
        centres.append(centres[-1] * 1.5)
    c = [log(x + 0.5) for x in centres]
    edges = [c[0] - 0.5, *[(a + b) / 2 for a, b in zip(c, c[1:])], c[-1] + 0.5]
    return list(zip(edges, edges[1:], c))


def linear_bins(lo: float, hi: float, bins: int = 50) -> list[tuple[float, float, float]]:
    w = (hi - lo) / bins
    return [(lo + i * w, lo + (i + 1) * w, lo + i * w + w / 2) for i in range(bins)]


def binned(df: DataFrame, against: str, value: Column, bins: list[tuple[float, float, float]]) -> DataFrame:
    """(bin, centre, n, mean, overall) of `value` by bins of `against`; the last bin is closed, empty bins
    have NULL means. Booleans give proportions."""
    spark = df.sparkSession
    x, v = F.col(against).cast("double"), value.cast("double")
    edges = F.array(*[F.lit(b[0]) for b in bins])
    # edges rise, so the number of those not above x is its bin
    place = F.when((x >= bins[0][0]) & (x <= bins[-1][1]), F.size(F.filter(edges, lambda e: e <= x)) - 1)
    sums = df.select(place.alias("bin"), v.alias("v")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    table = spark.createDataFrame([(i, float(b[2])) for i, b in enumerate(bins)], "bin int, centre double")
    overall = df.agg(F.avg(v).alias("overall"))
    return table.join(sums, "bin", "left").crossJoin(F.broadcast(overall)).select("bin", "centre", F.coalesce("n", F.lit(0)).alias("n"), "mean", "overall")


def duplicates(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """(representative, multiplicity) of rows that are alike in `key`."""
    return df.groupBy(key).agg(F.min(id_col).alias("representative"), F.count("*").alias("multiplicity")).drop(key)


def group_quantiles(df: DataFrame, group: str, value: str, at: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    q = F.percentile(value, F.array(*map(F.lit, at)))
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("q")).select(group, "n", "mean", *[F.get("q", i).alias(f"q{round(100 * p)}") for i, p in enumerate(at)])


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """(truth, predicted, n, share of the truth's rows)."""
    from pyspark.sql import Window

    c = df.select(truth.alias("truth"), predicted.alias("predicted")).groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def active_features(df: DataFrame, vec: str) -> DataFrame:
    """(feature, active): whether any row has a value other than 0 there."""
    return df.select(F.posexplode(vec).alias("feature", "v")).groupBy("feature").agg(F.bool_or(F.col("v") != 0).alias("active"))


def monotony(df: DataFrame, col: str) -> DataFrame:
    """One row: distinct values, and the share of the most frequent."""
    return df.groupBy(col).agg(F.count("*").alias("c")).agg(F.count("*").alias("distinct"), (F.max("c") / F.sum("c")).alias("modal_share"))
