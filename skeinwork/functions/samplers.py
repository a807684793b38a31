"""Seeded point sets (id, vec) for experiments: shapes and distributions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _radius(kind: str, shape: float, seed: int) -> Column:
    u = F.rand(seed)
    if kind == "uniform":
        return F.sqrt(u)
    if kind == "gaussian":
        return F.abs(F.randn(seed)) * shape
    if kind == "exponential":
        return -F.ln(1 - u) * shape
    if kind == "pareto":
        return F.pow(1 - u, F.lit(-1.0 / shape)) - 1
    raise ValueError(kind)


def blob(spark: SparkSession, n: int, centre: tuple[float, float], size: float, kind: str = "gaussian", shape: float = 1.0, seed: int = 17) -> DataFrame:
    """Points around a centre at radii of a distribution."""
    angle = F.rand(seed + 1) * (2 * pi)
    polar = spark.range(n).select("id", (_radius(kind, shape, seed) * size).alias("r"), angle.alias("a"))
    return polar.select("id", F.array(centre[0] + F.col("r") * F.cos("a"), centre[1] + F.col("r") * F.sin("a")).alias("vec"))


def ring(spark: SparkSession, n: int, centre: tuple[float, float], size: float, width: float, seed: int = 17) -> DataFrame:
    polar = spark.range(n).select("id", (size + F.randn(seed) * width).alias("r"), (F.rand(seed + 1) * (2 * pi)).alias("a"))
    return polar.select("id", F.array(centre[0] + F.col("r") * F.cos("a"), centre[1] + F.col("r") * F.sin("a")).alias("vec"))


def line(spark: SparkSession, n: int, fr: tuple[float, float], to: tuple[float, float], spread: float, seed: int = 17) -> DataFrame:
    t = spark.range(n).select("id", F.rand(seed).alias("t"), (F.randn(seed + 1) * spread).alias("e"), (F.randn(seed + 2) * spread).alias("f"))
    return t.select("id", F.array(fr[0] + (to[0] - fr[0]) * F.col("t") + F.col("e"), fr[1] + (to[1] - fr[1]) * F.col("t") + F.col("f")).alias("vec"))
