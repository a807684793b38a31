"""Readers of item and rating tables, the repair of broken records, and CSV sinks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.functions.columns import int_or_sentinel, limited_count, path_id

#: Fields of a raw profile record, in order. Fixed values.
PROFILE_FIELDS = [
    "user-url", "avi-url", "country-code", "display-name", "username", "friends-with-limit", "following-raw", "followers-raw", "posts-raw", "yeahs-raw",
    "msg", "full-country", "birthdate", "competence", "platforms", "genres", "games",
]


def read_items(spark: SparkSession, path: str, schema: str | T.StructType, separator: str = ",") -> DataFrame:
    """A CSV with a header and a stated schema (no inference pass)."""
    return spark.read.csv(path, schema=schema, header=True, sep=separator)


def read_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The same, but a record that doesn't fit the schema ends the job."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def unpivot_ratings(df: DataFrame, ids: list[str], scales: list[str]) -> DataFrame:
    """Long form (ids, scale, value) of a wide rating table."""
    return df.unpivot(ids, scales, "scale", "value")


def with_ratings(items: DataFrame, ratings: DataFrame, item_id: str, rated_id: str, how: str = "inner") -> DataFrame:
    """`items` with the columns of a summary of ratings by item (one row an item), which take a suffix
    where names clash. `how` is inner (rated items alone) or left (all)."""
    clash = {c: f"{c}_rating" for c in ratings.columns if c in items.columns and c != rated_id}
    right = ratings.withColumnsRenamed(clash).withColumnRenamed(rated_id, "_rated")
    return items.join(right, items[item_id] == right["_rated"], how).drop("_rated")


def repair_records(lines: DataFrame, fields: list[str] = PROFILE_FIELDS, order: str = "pos", file: str = "file") -> DataFrame:
    """Records of tab-separated lines (file, pos, line) of which some were broken by newlines in a field.

    Lines are joined until a full set of fields is there: the first piece of a line that continues a
    record belongs to the last field so far. A record that gets too many fields is dropped, and the next
    line begins anew; so is one that its file ends in. Each file is read in order by one task, which
    holds the open record alone; files are repaired apart from each other.
    """
    n = len(fields)

    def run(batches):
        import pandas as pd

        at, open_ = None, []
        for pdf in batches:
            done = []
            for name, line in zip(pdf["f"], pdf["l"]):
                if name != at:
                    at, open_ = name, []
                pieces = line.split("\t")
                if open_:
                    open_[-1] += "\n" + pieces[0]
                    open_ += pieces[1:]
                else:
                    open_ = pieces
                if len(open_) == n:
                    done.append(open_)
                if len(open_) >= n:
                    open_ = []
            yield pd.DataFrame(done, columns=fields, dtype=object)

    rows = lines.select(F.col(file).alias("f"), F.col(order).alias("o"), F.col("line").alias("l")).where("l IS NOT NULL")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in fields])
    return rows.repartition("f").sortWithinPartitions("f", "o").select("f", "l").mapInPandas(run, schema)


def read_broken_tsv(spark: SparkSession, path: str, fields: list[str] = PROFILE_FIELDS) -> DataFrame:
    """Repaired records of text files, whose lines are ordered by their block of the file and their place in it."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("pos"), F.col("value").alias("line"))
    return repair_records(lines.where("line <> ''"), fields)


def clean_profiles(raw: DataFrame) -> DataFrame:
    """The columns that analyses use: id from the picture's URL, counts with -1 for what isn't a number."""
    c = lambda n: F.col(f"`{n}`")
    return raw.select(
        path_id(c("avi-url")).alias("avi-id"), c("country-code"), limited_count(c("friends-with-limit")).alias("friends"),
        *[int_or_sentinel(c(f"{n}-raw")).alias(n) for n in ("following", "followers", "posts", "yeahs")], c("competence"), c("genres"),
    )


def write_once(df: DataFrame, path: str) -> None:
    """CSV with a header; refuses a path that exists."""
    df.write.mode("errorifexists").csv(path, header=True)


def weighted_union(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Bag union with each part repeated."""
    out = None
    for df, w in parts:
        rep = df.withColumn("_w", F.explode(F.sequence(F.lit(1), F.lit(w)))).drop("_w")
        out = rep if out is None else out.unionByName(rep)
    return out


def sample_files(files: DataFrame, share: float, extensions: list[str] | None = None, path: str = "path", seed: int = 17) -> DataFrame:
    """About a share of the files of some extensions, by a hash of the path: the same on every run."""
    keep = F.pmod(F.xxhash64(path, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    if extensions:
        keep = keep & F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions])
    return files.where(keep)


def cached(spark: SparkSession, root: str, name: str, inputs: str, build, use_cache: bool = True) -> DataFrame:
    """What `build()` gives, kept as parquet under `root` by name and a digest of what it was built from;
    a cache that was not written to the end is built anew."""
    path = f"{root.rstrip('/')}/{name}-{hashlib.sha256(inputs.encode()).hexdigest()[:16]}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (use_cache and fs.exists(done)):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cluster_outlier_report(report: DataFrame, group: str) -> DataFrame:
    """(verdict, clusters): sorted ids of the clusters found small, large or different."""
    rows = report.select(F.col(group), F.explode(F.array_compact(F.array("side", F.when(F.col("diff"), F.lit("diff"))))).alias("verdict"))
    return rows.groupBy("verdict").agg(F.array_sort(F.collect_list(group)).alias("clusters"))


def cluster_sizes(assignment: DataFrame, label: str) -> DataFrame:
    return assignment.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), label)
