"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless, quoted, table, text_or_empty

#: region -> rack -> shard number -> weight. A node weighs as much as the shards below it.
Tree = dict[str, dict[str, dict[int, float]]]


def balanced_tree(shards: int) -> Tree:
    """Shards of weight one in racks of two and regions of two racks; the tree of n + 1 shards is that of n
    with one more leaf."""
    tree: Tree = {}
    for s in range(shards):
        tree.setdefault(f"r{s // 4}", {}).setdefault(f"r{s // 4}k{s // 2 % 2}", {})[s] = 1.0
    return tree


def _draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential draw of rate `weight`, fixed by key and shard."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(f"s{shard}"), key).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.struct((-F.ln(u) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard"))


def _least(draws: list[Column]) -> Column:
    return draws[0] if len(draws) == 1 else F.array_min(F.array(*draws))


def tree_shard(key: Column, tree: Tree) -> Column:
    """The shard that `key` (a string column) reaches: the least draw among regions, then among the racks
    of that region, then among the shards of that rack.

    A node's draw is the least of the draws below it, which is an exponential draw of the node's weight; so
    each level is chosen by weight, and as only leaves draw by themselves, a changed or added weight changes
    the draws of its own branch alone: keys move only into or out of the shards whose weights change.
    """
    return _least([_least([_least([_draw(key, s, w) for s, w in shards.items()]) for shards in racks.values()]) for racks in tree.values()])["shard"]


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The law is `key`: id and shard count decide alone. Size is the text's UTF-8 bytes plus one
    (null: none). Slots number a shard's rows from 0 in id order; rows that repeat an id go to one
    shard and get consecutive slots in the order of (size, checksum). A null id is a key like any
    other. An empty table gives an empty result; further columns are ignored.
    """
    key = F.coalesce(quoted(id_col).cast("string"), F.lit("null"))
    placed = docs.select(
        quoted(id_col).alias("doc_id"),
        (F.octet_length(text_or_empty(text_col)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        tree_shard(key, balanced_tree(shards)).cast("int").alias("shard"),
        tree_shard(key, balanced_tree(shards + 1)).cast("int").alias("grown_shard"),
    )
    out = gapless(placed, ["shard"], ["doc_id", "size", "text_crc32"], "slot", "shards")
    return out.select(F.col("doc_id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 8)
