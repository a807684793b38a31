"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, small_side, stored, table, text_or_empty

#: Surviving (length, prefix) keys up to this many are broadcast; beyond it a bitmap of their hashes is, of
#: SLOTS bits in at most SLOTS / 64 rows.
BROADCAST_KEYS, SLOTS = 1_000_000, 1 << 26


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_bytes: int = 256, broadcast_keys: int = BROADCAST_KEYS, with_digest: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept (and text_sha256 on request).

    1. rows by byte length; a length that only one row has cannot hold a duplicate;
    2. rows of shared lengths by a hash of their first bytes;
    3. the full SHA-256 of rows whose (length, prefix) is shared: equal digests are equal texts.
    Only lengths, hashes and ids are shuffled, never texts. Where the shared keys are too many to be
    broadcast, a bitmap stands for them, and some rows without a copy are hashed for nothing.

    A null text counts as empty. The row with the largest id of a group stays; rows that repeat
    an id share that id's verdict (all of them are kept or none), and null ids lose to any other.
    An empty table gives an empty result. Columns beyond id and text are ignored.
    """
    rows = docs.select(quoted(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    sized = rows.select("id", "body", F.octet_length("body").alias("len"))
    shared_len = stored(sized.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len"), "exact-len")
    prefix = F.xxhash64(F.substring(F.col("body").cast("binary"), 1, prefix_bytes)).alias("pre")
    level2 = sized.join(small_side(shared_len, broadcast_keys), "len").select("len", prefix)
    shared_pre = stored(level2.groupBy("len", "pre").agg(F.count("*").alias("n")).where("n > 1").select("len", "pre", F.lit(True).alias("hit")), "exact-pre")
    if shared_pre.count() <= broadcast_keys:
        marked = sized.select("id", "body", "len", prefix).join(F.broadcast(shared_pre), ["len", "pre"], "left")
    else:  # a bitmap of the keys' hashes is broadcast: texts needn't move, and a false hit costs one digest
        slot = F.pmod(F.xxhash64("len", "pre"), F.lit(SLOTS))
        bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
        bits = shared_pre.select(slot.alias("_slot")).groupBy(F.expr("_slot div 64").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
        marked = sized.select("id", "body", "len", prefix).withColumn("_slot", slot).withColumn("_word", F.expr("_slot div 64"))
        marked = marked.join(F.broadcast(stored(bits, "exact-bits")), "_word", "left").withColumn("hit", F.col("_bits").bitwiseAND(bit) != 0)
    digest = F.sha2(F.col("body").cast("binary"), 256)
    hashed = marked.select("id", F.when(F.col("hit"), digest).alias("digest"), *([digest.alias("text_sha256")] if with_digest else []))
    hashed = stored(hashed, "exact-hash")
    # stored, so that where it isn't broadcast the join below deals both sides itself and can split a hot group
    groups = stored(hashed.where("digest is not null").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "exact-groups")
    # rows without a digest get a key of their own, so that they do not meet in one null partition
    keyed = hashed.withColumn("key", F.coalesce("digest", F.concat(F.lit("#"), F.col("id").cast("string")), F.lit("#")))
    joined = keyed.join(small_side(groups.withColumnRenamed("digest", "key"), broadcast_keys), "key", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), *(["text_sha256"] if with_digest else []),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), with_digest=True)


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""
