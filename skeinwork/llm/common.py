"""Small helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt anew if it is read in fewer tasks than there are cores (a small table in one row group),
    for steps that cost far more than a shuffle of their input; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Only on a single machine, where the session names no such folder, a temporary one is made; on a
    cluster that is an error, as each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skeinwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends there, and a lost
    executor costs only a reread."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def positional(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns `names` of `df` under the names c0, c1, ..., which no name can clash with."""
    return df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(quoted(name), F.lit(""))


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows, else unchanged (a shuffled join)."""
    return F.broadcast(df) if df.count() <= limit else df


def gapless(df: DataFrame, group: list[str], order: list[str], slot: str, tag: str) -> DataFrame:
    """Number rows 0, 1, 2, ... within `group` in the order of `order`, without one task per group.

    Rows are dealt to ranges of `order`, counted by (group, range), and numbered inside each
    (group, range) from the running total of the ranges before it. The running totals are a
    table of groups x ranges rows.
    """
    placed = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), tag)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    starts = starts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_range").orderBy(*order)
    ranked = placed.withColumn("_rank", F.row_number().over(within) - 1)
    out = ranked.join(starts, [*group, "_range"])
    return out.withColumn(slot, (F.col("_start") + F.col("_rank")).cast("long")).drop("_range", "_start", "_rank")
