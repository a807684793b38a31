"""Scalar functions and column derivation (all of them column expressions)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPERSCRIPT_FROM, SUPERSCRIPT_TO = "0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ"


def first_group(x: Column, pattern: str) -> Column:
    """Group 1 of a match at the string's start; NULL without one."""
    return F.when(x.rlike("^(?:" + pattern + ")"), F.regexp_extract(x, "^(?:" + pattern + ")", 1))


def int_or_sentinel(x: Column) -> Column:
    """The integer that x spells, else -1."""
    return F.coalesce(F.trim(x).try_cast("bigint"), F.lit(-1).cast("bigint"))


def path_id(url: Column) -> Column:
    """The name that stands before `_normal_face.png` at a URL's end."""
    return first_group(url, ".*/([^/]+)_normal_face\\.png")


def limited_count(x: Column) -> Column:
    """The count of a text like `17 / 100`; -1 for `- / 100` and all else."""
    return int_or_sentinel(first_group(x, "(-|[0-9]+) / 100"))


def file_name_parts(name: Column, pattern: str = "([^_]+)_([^_]+)_.*") -> tuple[Column, Column]:
    """(country, id) of an image's file name; NULL if it has another form."""
    full = f"^(?:{pattern})"
    return tuple(F.when(name.rlike(full), F.regexp_extract(name, full, i)) for i in (1, 2))


def tokens(x: Column, separator: str = "|") -> Column:
    """The distinct values of a multi-value field; NULL and '' hold the empty value."""
    return F.array_distinct(F.split(F.coalesce(x, F.lit("")), re.escape(separator)))


def categories(df: DataFrame, col: str, separator: str = "|") -> list[str]:
    """The sorted values that a multi-value column has (a column of few values: they become columns)."""
    return sorted(r[0] for r in df.select(F.explode(tokens(F.col(col), separator))).distinct().collect())


def has_substring(x: Column, category: str) -> Column:
    """The category stands anywhere in the field, be it within another; the empty one only as all of it."""
    x = F.coalesce(x, F.lit(""))
    return x.contains(category) if category else x == ""


def has_token(x: Column, category: str, separator: str = "|") -> Column:
    """The category is one of the field's values."""
    return F.array_contains(tokens(x, separator), category)


def indicators(df: DataFrame, col: str, values: list[str], substring: bool = False, separator: str = "|") -> DataFrame:
    """`df` plus a boolean column `col(value)` for each value."""
    test = has_substring if substring else (lambda x, v: has_token(x, v, separator))
    return df.select("*", *[test(F.col(col), v).alias(f"{col}({v})") for v in values])


def dictionary(df: DataFrame, col: str, order_by: str | None = None) -> DataFrame:
    """(value, code): codes from 0 by value, or by first appearance in the order of `order_by`."""
    from pyspark.sql import Window

    values = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.min(order_by or col).alias("first"))
    return values.select("value", (F.row_number().over(Window.orderBy("first", "value")) - 1).alias("code"))


def encode(df: DataFrame, col: str, order_by: str | None = None) -> DataFrame:
    """`df` plus `<col>_code`; NULL has none."""
    codes = dictionary(df, col, order_by).select(F.col("value").alias(col), F.col("code").alias(f"{col}_code"))
    return df.join(codes, col, "left")


def one_hot(df: DataFrame, col: str, values: list) -> DataFrame:
    """`df` plus `<col>_onehot`, an array with 1.0 at the value's place."""
    return df.withColumn(f"{col}_onehot", F.array(*[F.coalesce((F.col(col) == v).cast("double"), F.lit(0.0)) for v in values]))


def with_stats(df: DataFrame, **stats: Column) -> DataFrame:
    """`df` beside one row of aggregates over all of it, which is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in stats.items()])))


def min_max(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """`df` plus (x - min) / (max - min); NULL if all are alike."""
    x = F.col(col).cast("double")
    wide = with_stats(df, _lo=F.min(x), _hi=F.max(x))
    return wide.withColumn(out or f"{col}_norm", (x - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).drop("_lo", "_hi")


def max_share(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """`df` plus x / max."""
    x = F.col(col).cast("double")
    return with_stats(df, _hi=F.max(x)).withColumn(out or f"{col}-norm", x / F.nullif(F.col("_hi"), F.lit(0.0))).drop("_hi")


def log_half(x: Column) -> Column:
    """ln(x + 0.5); NULL where that has no value."""
    return F.when(x > -0.5, F.ln(x + 0.5))


def log_one(x: Column) -> Column:
    """ln(x + 1); NULL where that has no value."""
    return F.when(x > -1, F.ln(x + 1.0))


def binarize(df: DataFrame, col: str, names: dict | None = None) -> DataFrame:
    """`df` plus one boolean column a value: `col(value)` for all values, or those of `names` as named."""
    if names is None:
        names = {v: f"{col}({v})" for v in sorted(r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().collect())}
    return df.select("*", *[F.coalesce(F.col(col) == v, F.lit(False)).alias(n) for v, n in names.items()])


def components(df: DataFrame, col: str, size: int, name: str = "feature") -> DataFrame:
    """`df` plus one column `name(i)` for each place of the array column."""
    return df.select("*", *[F.get(F.col(col), i).alias(f"{name}({i})") for i in range(size)])


def assembled(*cols: str) -> Column:
    """An array of the columns as doubles."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th ...; 11 to 19 take th (111 takes st)."""
    last = F.pmod(n, F.lit(10))
    tail = F.when((n > 10) & (n < 20), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def superscript(x: Column) -> Column:
    return F.translate(x, SUPERSCRIPT_FROM, SUPERSCRIPT_TO)


def tick_label(x: Column, tolerance: float = 1e-9) -> Column:
    """x with the fewest of up to three decimals that come within `tolerance`."""
    out = F.format_string("%.3f", x)
    for d in (2, 1, 0):
        out = F.when(F.abs(F.round(x, d) - x) <= tolerance, F.format_string(f"%.{d}f", F.round(x, d))).otherwise(out)
    return out


def log_ticks(top: int) -> list[tuple[float, str]]:
    """(place, label) at 0, 1, 2, 4 ... up to `top` on an axis of ln(x + 0.5)."""
    from math import log

    ticks, x = [0], 1
    while x <= top:
        ticks.append(x)
        x *= 2
    return [(log(t + 0.5), str(t)) for t in ticks]


def linear_ticks(lo: float, hi: float, steps: int) -> list[float]:
    return [lo + (hi - lo) * i / steps for i in range(steps + 1)]


def discrete_ticks(df: DataFrame, col: str) -> DataFrame:
    """(value, count) of a column of few values."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("count"))


def scale_rank(label: Column, scale: list[str]) -> Column:
    """Place of a label in an ordered scale, from 0; NULL if it isn't there."""
    return F.nullif(F.array_position(F.array(*map(F.lit, scale)), label) - 1, F.lit(-1).cast("bigint"))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """struct(h, s, v) of channels in [0, 1]."""
    v, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = F.nullif(v - lo, F.lit(0.0))
    h = F.when(v == r, (g - b) / d).when(v == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0) / 6.0
    return F.struct(F.coalesce(F.pmod(h, F.lit(1.0)), F.lit(0.0)).alias("h"), F.coalesce((v - lo) / F.nullif(v, F.lit(0.0)), F.lit(0.0)).alias("s"), v.alias("v"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """struct(r, g, b) of hue, saturation and value in [0, 1]."""
    def channel(n: float) -> Column:
        k = F.pmod(h * 6.0 + n, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4.0 - k, F.lit(1.0)))

    return F.struct(channel(5.0).alias("r"), channel(3.0).alias("g"), channel(1.0).alias("b"))


def mean_vector(df: DataFrame, col: str) -> DataFrame:
    """One row: the mean of an array column, place by place."""
    places = df.select(F.posexplode(col).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return places.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def deviations(df: DataFrame, col: str) -> DataFrame:
    """`df` plus `<col>_deviation`, the array less the mean array."""
    wide = df.crossJoin(F.broadcast(mean_vector(df, col)))
    return wide.withColumn(f"{col}_deviation", F.zip_with(F.col(col), F.col("mean"), lambda a, m: a.cast("double") - m)).drop("mean")


def corrupted(x: Column, amount: float = 0.1) -> Column:
    """An array with Gaussian noise added to each place (another on each run)."""
    return F.transform(x, lambda a: a + amount * F.randn())


def any_of(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{n}`") for n in names])
