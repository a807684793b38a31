"""Benchmark decontamination by winnowing: shared fingerprints first, then exact windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, spread, stored, table

#: Between words, after lower-casing A-Z: ASCII punctuation, spaces and controls. (Splitting is linear in a
#: text's length; regexp_extract_all copies the whole text for each match.)
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A shared span of SPAN words is guaranteed to be found: its SPAN - GRAM + 1 k-grams fill one
#: winnowing window, and both sides keep the least hash of it.
SPAN, GRAM = 10, 5
#: Benchmark fingerprints (of some 300 bytes with the words about them) up to this many are broadcast;
#: beyond it both sides' fingerprints meet by shuffle.
BROADCAST_MARKS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; a text of ASCII bytes can take the faster general function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def _grams(k: int) -> Column:
    """Hashes of all k-grams, from the words' hashes in the column `hashes`."""
    n = F.size("hashes")
    gram = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(k)]))
    return F.when(n >= k, gram).otherwise(F.array().cast("array<bigint>"))


def _fingerprinted(rows: DataFrame, spans: list[int]) -> DataFrame:
    """`rows` (with a column `words`) plus `marks`, an array of (span, at, fp).

    Of SPAN words: the least hash of each window's GRAM-grams, leftmost of equals, once for all windows
    that share it; `at` is the word where it begins. A window shares it with the one before unless the
    least hash changes or stood on the word that the window leaves behind. Of a shorter span: the hash
    of each run of so many words.
    """
    keep, grams = list(rows.columns), SPAN - GRAM + 1
    kind = "array<struct<span:int,at:int,fp:bigint>>"
    rows = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    rows = rows.select("*", *[_grams(GRAM if s == SPAN else s).alias(f"_g{s}") for s in spans])
    if SPAN in spans:
        n = F.size(f"_g{SPAN}")
        least = F.transform(F.sequence(F.lit(0), n - grams), lambda i: F.least(*[F.get(f"_g{SPAN}", i + j) for j in range(grams)]))
        rows = rows.select("*", F.when(n >= grams, least).otherwise(F.array().cast("array<bigint>")).alias("_least"))

    def fresh(i: Column) -> Column:
        before = F.get("_least", i - 1)
        return (i == 0) | (F.get("_least", i) != before) | (F.get(f"_g{SPAN}", i - 1) == before)

    def mark(i: Column) -> Column:
        fp = F.get("_least", i)
        at = i + F.array_position(F.slice(f"_g{SPAN}", i + 1, grams), fp).cast("int") - 1
        return F.struct(F.lit(SPAN).alias("span"), at.alias("at"), fp.alias("fp"))

    def run_marks(s: int) -> Column:
        return F.transform(f"_g{s}", lambda fp, i: F.struct(F.lit(s).alias("span"), i.alias("at"), fp.alias("fp")))

    marks = []
    for s in spans:
        if s == SPAN:
            places = F.filter(F.sequence(F.lit(0), F.size("_least") - 1), fresh)
            marks.append(F.when(F.size("_least") > 0, F.transform(places, mark)).otherwise(F.array().cast(kind)))
        else:
            marks.append(run_marks(s))
    return rows.select(*keep, (F.concat(*marks) if len(marks) > 1 else marks[0]).alias("marks"))


def _gram(span: Column | str, at: Column | str) -> Column:
    """The words of a mark's gram, joined."""
    return F.concat_ws(" ", F.slice("words", F.col(at) + 1, F.when(F.col(span) == SPAN, GRAM).otherwise(F.col(span))))


def item_marks(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(span, fp, gram, before, after, items) of the benchmark's marks: the gram's words, and the words
    before it (nearest first) and after it that a window of SPAN words with the gram may hold."""
    rows = items.select(quoted(item_id).cast("string").alias("item"), words_of(quoted(text)).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    spans = [r.n for r in rows.select(F.least("n", F.lit(SPAN)).alias("n")).distinct().collect()]  # at most SPAN values
    if not spans:
        return rows.sparkSession.createDataFrame([], "span int, fp bigint, gram string, before array<string>, after array<string>, items array<string>")
    marked = _fingerprinted(rows, sorted(spans)).select("item", "n", "words", F.explode_outer("marks").alias("m")).select("item", "n", "words", "m.*")
    marked = marked.where(F.col("span") == F.least("n", F.lit(SPAN)))
    more = SPAN - GRAM
    before = F.reverse(F.slice("words", F.greatest(F.col("at") - more, F.lit(0)) + 1, F.least(F.col("at"), F.lit(more))))
    none = F.array().cast("array<string>")
    whole = F.col("span") < SPAN
    flat = marked.select("item", "span", "fp", _gram("span", "at").alias("gram"), F.when(whole, none).otherwise(before).alias("before"), F.when(whole, none).otherwise(F.slice("words", F.col("at") + GRAM + 1, more)).alias("after"))
    return flat.groupBy("span", "fp", "gram", "before", "after").agg(F.collect_set("item").alias("items"))


def _agreeing(theirs: str, place) -> Column:
    """How many of the words in the array `theirs` (SPAN - GRAM at most) stand one after another in the
    document, the first at place(0), the next at place(1), ..."""
    out = None
    for k in range(SPAN - GRAM):
        ends = ~F.coalesce(F.get("words", place(k)) == F.get(theirs, F.lit(k)), F.lit(False))
        out = F.when(ends, k) if out is None else out.when(ends, k)
    return out.otherwise(SPAN - GRAM)


def _extended(found: DataFrame) -> DataFrame:
    """Marks that a document shares with the benchmark, with `start` and `length` of the run of words that
    agree: the gram, and what agrees before and after it."""
    left, right = _agreeing("before", lambda k: F.col("at") - 1 - k), _agreeing("after", lambda k: F.col("at") + GRAM + k)
    found = found.withColumn("_l", F.when(F.col("span") == SPAN, left).otherwise(0)).withColumn("_r", F.when(F.col("span") == SPAN, right).otherwise(0))
    return found.select("*", (F.col("at") - F.col("_l")).alias("start"), (F.col("_l") + F.col("_r") + F.when(F.col("span") == SPAN, GRAM).otherwise(F.col("span"))).alias("length"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_marks: int = BROADCAST_MARKS) -> DataFrame:
    """n_words, n_hit, n_items, items (sorted array of item ids as strings) and spans (sorted array of
    start, length of the runs that documents share with an item) for each row of `docs`, beside its id.

    Both sides are winnowed: of each window of SPAN words the least hash of its GRAM-grams is kept. A
    shared window has one such gram at the same place on both sides, so joining fingerprints finds it;
    each hit is then extended word by word to the run about it, and runs of SPAN words count. The words
    about a benchmark gram travel with it. Where the benchmark's fingerprints are few enough to be
    broadcast, document words are never shuffled; else the fingerprints of both sides are, once, and
    the documents that share any are joined to their words. A document's hits meet in one row, so
    their number is bounded by its own words.

    Null or wordless texts have no words and no hits; wordless items hit nothing; an item of fewer
    than SPAN words is one window. Items that share an id count once. Rows that repeat an id are
    scored one by one. Very long texts are one row's arrays. Empty tables give empty results or no hits;
    columns beyond id and text are ignored.
    """
    bench = stored(item_marks(items, item_id, item_text), "bench-marks")
    stats = bench.agg(F.count("*").alias("n"), F.collect_set("span").alias("spans")).first()
    spans = sorted(stats.spans) or [SPAN]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), quoted(doc_id).alias("id"), quoted(text).alias("text"))
    side = bench.withColumnsRenamed({"span": "_span", "fp": "_fp"})
    same = (F.col("fp") == F.col("_fp")) & (F.col("span") == F.col("_span"))
    is_gram = _gram("span", "at") == F.col("gram")
    # explode_outer (marks are never empty): for explode() the optimizer adds a filter on the array's size,
    # and pushing that below the projections would compute every array anew for each of its elements
    if stats.n <= broadcast_marks:
        rows = _fingerprinted(rows.select("row", "id", words_of(F.col("text")).alias("words")), spans)
        # one mark of span 0 a row carries the row itself through the join
        self_mark = F.struct(F.lit(0).alias("span"), F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("fp"))
        rows = rows.select("row", "id", "words", F.concat(F.array(self_mark), "marks").alias("marks"))
        rows = rows.select("row", "id", "words", F.explode_outer("marks").alias("m"))
        rows = rows.select("row", "id", F.size("words").cast("long").alias("n_words"), "words", "m.span", "m.at", "m.fp")
        own = docs.sparkSession.createDataFrame([(0, 0, "", [], [], [])], "_span int, _fp bigint, gram string, before array<string>, after array<string>, items array<string>")
        hits = _extended(rows.join(F.broadcast(side.unionByName(own)), same & ((F.col("span") == 0) | is_gram)))
    else:
        rows = stored(rows, "bench-rows")  # numbers must stay as they are
        marked = _fingerprinted(rows.select("row", words_of(F.col("text")).alias("words")), spans)
        marked = marked.select("row", F.explode_outer("marks").alias("m")).select("row", "m.*").where("span IS NOT NULL")
        shared = stored(marked.join(side, same).select("row", "span", "at", "gram", "before", "after", "items"), "bench-shared")
        words = rows.select("row", words_of(F.col("text")).alias("words")).join(shared.select("row").distinct(), "row")
        runs = _extended(shared.join(words, "row").where(is_gram)).select("row", "span", "start", "length", "items")
        hits = rows.select("row", "id", F.size(words_of(F.col("text"))).cast("long").alias("n_words")).join(runs, "row", "left")
    is_run = (F.col("span") > 0) & ((F.col("span") < SPAN) | (F.col("length") >= SPAN))
    hits = hits.select("row", "id", "n_words", F.when(is_run, F.struct("start", "length")).alias("run"), F.when(is_run, F.col("items")).alias("items"))
    out = hits.groupBy("row", "id", "n_words").agg(F.array_sort(F.collect_set("run")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))

    def cover(acc: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        return F.struct((acc["hit"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("hit"), F.greatest(acc["end"], end).alias("end"))

    n_hit = F.when(F.size("spans") == 0, F.lit(0)).otherwise(F.aggregate("spans", zero, cover, lambda a: a["hit"]))
    return out.select(F.col("id").alias(doc_id), "n_words", n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
