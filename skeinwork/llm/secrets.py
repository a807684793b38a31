"""Secret scans over an incremental ledger of blobs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored, table
from .tokens import lean, slices, text_bytes

#: kind: (pattern, group whose length counts, its least length). Fixed values.
RULES = {
    "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: Recorded with each scanned blob: a change of the rules calls for a new version, and for new scans.
RULES_VERSION = 1
#: A text without these (in lower case) has no match of the rule; purely to save time.
HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",)}
FOUND = "array<struct<kind:string,start:bigint,end:bigint>>"
BATCH_BYTES = 4 << 20


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, in code points, by start and then by kind as listed.

    Matches of a kind are leftmost and don't overlap; those whose counted group is too short are
    dropped after matching. A run of hex digits is maximal, so its least length may stand in the
    pattern itself.
    """
    out, low = [], text.lower()
    for rank, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        if kind in HINTS and not any(h in low for h in HINTS[kind]):
            continue
        if kind == "hex":
            pattern = f"[0-9a-f]{{{least},}}"
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def _scan(batches: Iterable) -> Iterable:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for b in slices(batches, lambda x: text_bytes(x.column(1)), BATCH_BYTES):
        found = [[dict(zip(("kind", "start", "end"), s)) for s in spans_of(t.decode("utf-8", "replace"))] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["blob", "found"])


class Ledger:
    """Parquet folder of (blob, rules_version, found), one row for each scanned pair.

    Each scan appends a folder of its own at once, so that writers don't meet; a folder that a broken run
    left without its success mark is not read, so its blobs are scanned again.
    """

    schema = f"blob binary, rules_version int, found {FOUND}"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        runs = [x.getPath() for x in fs.listStatus(root)]
        return sorted(p.toString() for p in runs if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def rows(self) -> DataFrame:
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*runs)

    def append(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/run-{uuid.uuid4().hex}")


def scan_versions(versions: DataFrame, ledger: Ledger, path_col: str = "path", text_col: str = "text", rules_version: int = RULES_VERSION) -> DataFrame:
    """(path, blob, found) for every row of `versions`; found is an array of (kind, start, end).

    A version's blob is the SHA-256 of its text. Of the blobs at hand, those that the ledger lacks
    for `rules_version` are scanned, each from one path however many hold it, and recorded;
    then findings are joined back to all paths. Only blobs with findings take part in that join.

    A null text is the empty blob, which has no findings; rows that repeat a path are joined each by
    itself; empty tables give empty results; further columns are ignored.
    """
    rows = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("blob", F.unhex(F.sha2("body", 256)))
    paths = stored(rows.select("path", "blob"), "blob-paths")
    seen = ledger.rows().where(F.col("rules_version") == rules_version).select("blob").distinct()
    unseen = paths.groupBy("blob").agg(F.min("path").alias("_path")).join(seen, "blob", "left_anti").withColumnRenamed("blob", "_blob")
    # one path of each unseen blob brings its text
    todo = rows.join(unseen, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path"))).select("blob", "body")
    scanned = todo.mapInArrow(lean(_scan), f"blob binary, found {FOUND}").select("blob", F.lit(rules_version).alias("rules_version"), "found")
    ledger.append(scanned)
    hits = ledger.rows().where((F.col("rules_version") == rules_version) & (F.size("found") > 0)).select("blob", "found").dropDuplicates(["blob"])
    joined = paths.join(hits, "blob", "left")
    return joined.select(F.col("path").alias(path_col), "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def op5_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two instalments, documents of even and of odd ids, so that the second scans only the blobs that
    the first one lacked."""
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), Ledger(spark, shared_path(spark, "ledger"))
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    found = scan_versions(docs.where(even), ledger, "doc_id").unionByName(scan_versions(docs.where(~even), ledger, "doc_id"))

    def n(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.withColumn("spans", spans).select("doc_id", *map(n, RULES), F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans")
