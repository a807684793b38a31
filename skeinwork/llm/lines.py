"""Line de-duplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import positional, quoted, small_side, stored, table

RATIO, MIN_PAGES = 0.01, 5
#: Hosts (or drop-list rows) up to this many are broadcast; beyond it the join shuffles.
BROADCAST_HOSTS, BROADCAST_DROPS = 500_000, 200_000


def _line_key(line: Column) -> Column:
    return F.md5(F.trim(line).cast("binary"))


def boilerplate_lines(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_key) of lines that stand in more than `ratio` of their host's pages, and in at
    least `min_pages` of them.

    A line counts once a page; blanks at its ends are ignored, blank lines never count. Counts are
    combined before the shuffle, so a hot host or line sends one row a task. A host has at most
    (lines a page) / ratio such lines.
    """
    lines = F.array_distinct(F.transform(F.split(quoted(text), "\n", -1), F.trim))
    each = pages.select(quoted(host).alias("host"), F.explode(lines).alias("line")).where("line <> ''").select("host", _line_key(F.col("line")).alias("line_key"))
    found = each.groupBy("host", "line_key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = stored(pages.groupBy(quoted(host).alias("host")).agg(F.count("*").alias("pages")), "line-hosts")
    return found.join(small_side(totals, BROADCAST_HOSTS), found["host"].eqNullSafe(totals["host"])).where(F.col("n") > F.col("pages") * ratio).select(found["host"], "line_key")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All rows and columns of `pages`, `text` without its host's boilerplate lines, plus n_lines and
    n_dropped (long).

    A null text stays null with 0 lines; a null host is a host of its own; other texts keep every
    remaining line and its spaces, joined by newlines. No row goes, though a text may become empty.
    Input columns called n_lines or n_dropped give way to the results; others may have any name.
    """
    drops = stored(boilerplate_lines(pages, host, text, ratio, min_pages), "line-drops")
    by_host = drops.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line_key").alias("_drop"))
    # stored, so that where it isn't broadcast the join deals both sides itself and can split a hot host
    by_host = F.broadcast(by_host) if drops.count() <= BROADCAST_DROPS else stored(by_host, "line-lists")
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    at = {c: f"c{i}" for i, c in enumerate(names)}
    rows = positional(pages, names).withColumn("_lines", F.split(F.col(at[text]), "\n", -1))
    joined = rows.join(by_host, F.col(at[host]).eqNullSafe(F.col("_host")), "left")
    kept = F.when(F.col("_drop").isNotNull(), F.filter("_lines", lambda x: ~F.array_contains(F.col("_drop"), _line_key(x))))
    joined = joined.select(*at.values(), "_lines", kept.alias("_kept"))
    n_lines = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    n_dropped = F.when(F.col("_kept").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long")
    new = F.when(n_dropped == 0, F.col(at[text])).otherwise(F.array_join("_kept", "\n"))
    return joined.select(*[(new if c == text else F.col(at[c])).alias(c) for c in names], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`source` is the host of a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, source, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM d),
h AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
f AS (SELECT source, trim(line, ' ') AS k, count(DISTINCT r) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL),
x AS (SELECT f.source, k FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE n >= {MIN_PAGES} AND n > pages * {RATIO}),
m AS (SELECT l.r, l.i, l.line, x.k IS NOT NULL AS gone FROM l LEFT JOIN x ON l.source IS NOT DISTINCT FROM x.source AND trim(l.line, ' ') = x.k),
t AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM m GROUP BY r)
SELECT d.doc_id, d.source, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_dropped, 0) AS n_dropped, t.text FROM d LEFT JOIN t USING (r)
"""
