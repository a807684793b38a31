"""A training corpus from raw documents: toxicity, boilerplate lines, near copies, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import decontam, lines, neardup, packing, toxicity
from skeinwork.llm.common import small_side, stored, table
from skeinwork.llm.tokens import tokenizer_path

#: Verdicts on rows up to this many are broadcast; beyond it the join shuffles.
VERDICTS = 1_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; models learn from the labelled ones among `docs`.

    Rows are judged one by one by their texts, so rows that repeat a text share its verdict, whatever their
    ids; a null or empty text has no words and stays unless documents without words are toxic on the
    whole; a row of null id never teaches. Texts are read in bounded batches, however long. Without labels
    nothing can be told and all rows stay. Columns beyond those of documents go, whatever their names.
    """
    labels = table(spark, sf_dir, "labels")
    if labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").isEmpty():
        return docs.select(COLUMNS)
    model, weights = toxicity.fit(docs, labels)
    return toxicity.score(docs.select(COLUMNS), model, weights).where("toxic_score < 0.5").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text.

    No row goes, though a text may become empty; a null text stays null, a null source is a source of its
    own, rows that repeat an id or a text are pages of their own, and a line counts once a page. Columns
    beyond those of documents go.
    """
    out = lines.drop_boilerplate(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a similarity of 0.8 or more.

    Rows get numbers in the order of (id, null last; text), and of a group the row of the least number
    stays, so exactly one does, also where ids repeat or are null. Documents without words, null texts
    among them, are copies of nothing and stay. Columns beyond those of documents go.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(COLUMNS).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    rows = stored(rows, "near-rows")  # numbers must stay as they are
    gone = stored(neardup.near_duplicates(rows, 5, 80, 100, id_col="_row").where("NOT kept").select("_row"), "near-gone")
    return rows.join(small_side(gone, VERDICTS), "_row", "left_anti").select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark.

    The verdict is that of the text, and rows are told by their texts' digests, so ids may be null or
    repeat. Null and empty texts share nothing and stay; an empty benchmark or table drops nothing.
    Columns beyond those of documents go.
    """
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    found = decontam.contamination(docs.select(digest.alias("digest"), "text"), table(spark, sf_dir, "benchmark"), doc_id="digest")
    leaks = stored(found.where("n_hit > 0").select("digest").distinct(), "leaks")
    return docs.select(COLUMNS).join(small_side(leaks, VERDICTS), digest == F.col("digest"), "left_anti").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids. Workers that served other stages hold memory of
    theirs, so the tokenizer's caches are small, and texts come to it 1 MB at a time.

    A null or empty text is its end id alone; rows that repeat an id or a text are packed each by
    itself, a null id stays null; a very long text fills windows of its own and one piece more; an empty
    table gives no piece. Columns beyond id and text go.
    """
    return packing.pack_documents(docs, tokenizer_path(), 1, cache=(25_000, 125_000), batch_bytes=1 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language-model scores, MinHash and the tokenizer have no SQL form.
ORACLE_SQL = None
