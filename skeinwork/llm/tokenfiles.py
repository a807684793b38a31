"""Token ids in parquet list columns, in id order, with page indexes for selective reads."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, table
from .tokens import encoder, lean, slices, text_bytes, tokenizer_path

#: Bytes of a row group, bytes and rows of a page: what a selective read fetches at least.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 1 << 20, 500
BATCH_BYTES = 4 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS) -> None:
    """Write (doc_id, n_tokens, part, part_start, ids) rows to parquet at `path`.

    Rows are dealt to ranges of the id and sorted in them, so files follow one another in id order
    (rows that repeat an id: in text order; null ids first). `ids` ends with `end_id`; a null text is
    empty. part_start counts the ids before the document in its part. `ids` is dictionary encoded, or
    delta encoded with encoding="delta"; the other columns are delta encoded. Row groups and pages are
    of the stated sizes, and parquet's page indexes let a reader of a few ids or of the metadata
    columns skip all other pages. A task holds about BATCH_BYTES of text, or one document.
    """
    schema = "doc_id long, n_tokens long, part_start long, ids array<int>"

    def encode(batches: Iterable) -> Iterable:
        import pyarrow as pa

        enc, before = encoder(tokenizer), 0
        for b in slices(batches, lambda x: text_bytes(x.column(1)), BATCH_BYTES):
            flat, at = enc.encode_column(b.column(1))
            n, offsets = np.diff(at) + 1, at + np.arange(len(at))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.insert(flat, at[1:], end_id).view("<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(offsets[:-1] + before), ids], ["doc_id", "n_tokens", "part_start", "ids"])
            before += int(offsets[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(lean(encode, encodes=True), schema)
    rows = rows.withColumn("part", F.spark_partition_id())
    element = "ids.list.element"
    options = {
        "compression": "snappy", "parquet.writer.version": "v2", "parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "false", f"parquet.enable.dictionary#{element}": str(encoding == "dictionary").lower(), "parquet.dictionary.page.size": 1 << 20,
    }
    rows.select("doc_id", "n_tokens", "part", "part_start", "ids").write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before. Selecting
    columns or filtering by doc_id reads only the pages concerned."""
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), 2)

    def digest(batches: Iterable) -> Iterable:
        import pyarrow as pa

        for b in batches:
            ids = b.column(3)
            flat, ends = ids.flatten().to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            crc = [zlib.crc32(flat[s:e]) for s, e in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).mapInArrow(lean(digest), "doc_id long, start long, n_tokens long, ids_crc32 long")
