"""Orderings, smoothing, lineups and image layout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def previous_difference(df: DataFrame, value: str, order: str, out: str = "change") -> DataFrame:
    w = Window.orderBy(order)
    return df.withColumn(out, F.col(value) - F.lag(value).over(w))


def moving_average(df: DataFrame, value: str, order: str, taps: int = 11, group: str | None = None, out: str = "smooth") -> DataFrame:
    """Mean over `taps` rows around each; beyond the ends are zeros, as in a convolution of equal length."""
    half = taps // 2
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(order).rowsBetween(-half, half)
    return df.withColumn(out, F.sum(value).over(w) / taps)


#: Weights of smoothing kernels from the row furthest ahead to the one furthest behind. Fixed values.
WIDE_KERNEL = (0.75, 0.75, 1.0, 1.0, 1.0, 1.0, 1.0, 0.75, 0.75)
TRAILING_KERNEL = (0.0,) * 5 + (1.0,) * 6


def convolved(df: DataFrame, value: str, order: str, kernel: tuple[float, ...] = WIDE_KERNEL, group: str | None = None, out: str = "smooth") -> DataFrame:
    """Weighted mean over the rows about each, the kernel centred on it; beyond the ends are zeros."""
    w, half = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(order), len(kernel) // 2
    at = [F.lag(value, k - half, 0.0).over(w) * (x / sum(kernel)) for k, x in enumerate(kernel) if x]
    return df.withColumn(out, sum(at[1:], at[0]))


def bin_means(df: DataFrame, bin_col: str, vec: str) -> DataFrame:
    """(bin, n, mean): rows of each bin and the mean of their vectors; rows without a bin count in none."""
    each = df.where(F.col(bin_col).isNotNull()).select(F.col(bin_col).alias("bin"), F.posexplode(vec).alias("at", "x"))
    means = each.groupBy("bin", "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy("bin").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))


def equal_depth_lineup(df: DataFrame, by: str, bins: int) -> DataFrame:
    """`df` plus `bin` (from 0) of about equal depth; rows of one value stay together, in the bin of the
    first of them. Values are counted before they are ordered."""
    c = df.groupBy(by).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    c = c.select(by, F.coalesce(before, F.lit(0)).alias("_b")).crossJoin(F.broadcast(df.agg(F.count(by).alias("_n"))))
    place = c.select(F.col(by).alias("_v"), F.floor(F.col("_b") * bins / F.col("_n")).cast("int").alias("bin"))
    return df.join(place, F.col(by) == F.col("_v")).drop("_v")


def percentile_edge_lineup(df: DataFrame, by: str, edges: int) -> DataFrame:
    """`df` plus `bin` of edges - 1 half-open bins between equally spaced percentiles; the greatest value
    falls in none."""
    at = F.array(*[F.lit(float(p)) for p in np.linspace(0, 1, edges)])
    wide = df.crossJoin(F.broadcast(df.agg(F.percentile(by, at).alias("_e"))))
    place = F.size(F.filter("_e", lambda e: e <= F.col(by))) - 1
    return wide.withColumn("bin", F.when(place < edges - 1, place)).drop("_e")


def lineup_samples(df: DataFrame, bin_col: str, id_col: str, width: int, seed: int = 17) -> DataFrame:
    """(bin, slot, id): up to `width` rows of each bin, by a hash of the id."""
    w = Window.partitionBy(bin_col).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col)
    return df.where(F.col(bin_col).isNotNull()).select(F.col(bin_col).alias("bin"), (F.row_number().over(w) - 1).alias("slot"), F.col(id_col).alias("id")).where(F.col("slot") < width)


def montage_grid(df: DataFrame, order: str) -> DataFrame:
    """`df` plus `row` and `col` of a grid with as many columns as the root of the count, rounded up."""
    wide = df.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1).crossJoin(F.broadcast(df.agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("_side"))))
    return wide.withColumn("row", F.floor(F.col("_i") / F.col("_side")).cast("long")).withColumn("col", F.col("_i") % F.col("_side")).drop("_i", "_side")


def blank(width: int, height: int, color=(0.0, 0.0, 0.0)) -> np.ndarray:
    return np.tile(np.asarray(color, float), (height, width, 1))


def paste(src: np.ndarray, onto: np.ndarray, at=(0, 0)) -> np.ndarray:
    out = onto.copy()
    x, y = at
    h, w = min(src.shape[0], out.shape[0] - y), min(src.shape[1], out.shape[1] - x)
    out[y : y + h, x : x + w] = src[:h, :w]
    return out


def framed(img: np.ndarray, size: int = 2, color=(0.0, 0.0, 0.0)) -> np.ndarray:
    return paste(img, blank(img.shape[1] + 2 * size, img.shape[0] + 2 * size, color), (size, size))


def pad_crop(img: np.ndarray, width: int | None = None, height: int | None = None, center: bool = True, color=(0.0, 0.0, 0.0)) -> np.ndarray:
    """The image cut or padded to a size, around its centre or from its origin."""
    width, height = width or img.shape[1], height or img.shape[0]
    out = blank(width, height, color)
    dy, dx = ((img.shape[0] - height) // 2, (img.shape[1] - width) // 2) if center else (0, 0)
    sy, sx, ty, tx = max(dy, 0), max(dx, 0), max(-dy, 0), max(-dx, 0)
    h, w = min(img.shape[0] - sy, height - ty), min(img.shape[1] - sx, width - tx)
    out[ty : ty + h, tx : tx + w] = img[sy : sy + h, sx : sx + w]
    return out


def joined(images: list[np.ndarray], vertical: bool = False, padding: int = 0, center: bool = True, color=(0.0, 0.0, 0.0)) -> np.ndarray:
    """Images side by side (or one under the other), padded to one height (or width)."""
    other = max(i.shape[1 if vertical else 0] for i in images)
    parts = []
    for k, i in enumerate(images):
        if k and padding:
            parts.append(blank(other, padding, color) if vertical else blank(padding, other, color))
        parts.append(pad_crop(i, other, None, center, color) if vertical else pad_crop(i, None, other, center, color))
    return np.concatenate(parts, axis=0 if vertical else 1)


def montage(images: list[np.ndarray], padding: int = 2, color=(0.0, 0.0, 0.0)) -> np.ndarray:
    """A grid of ceil(sqrt(n)) columns, without empty rows."""
    side = int(np.ceil(np.sqrt(len(images))))
    h, w = max(i.shape[0] for i in images), max(i.shape[1] for i in images)
    cells = [pad_crop(i, w, h, True, color) for i in images]
    rows = [joined(cells[r : r + side], False, padding, True, color) for r in range(0, len(cells), side)]
    return joined([pad_crop(r, rows[0].shape[1], None, False, color) for r in rows], True, padding, True, color)
