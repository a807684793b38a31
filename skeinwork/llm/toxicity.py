"""Toxicity by class-conditional Kneser-Ney bigram models."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .common import positional, spread, stored, table
from .labelled import held_out, logistic, teaching_rows
from .tokens import lean, slices, text_bytes

#: The shared distribution keeps half a count for each of 2^BITS words, or of all words there are if more.
BITS = 20
#: Entries of a block of the model that is broadcast; of more blocks each takes a pass over the texts.
BLOCK = 2_000_000
#: Pairs that a counting task holds before it hands their counts on.
HELD = 500_000
#: Rows to which the left neighbours of a hot word are dealt, the share of sampled documents that makes a
#: word hot, and documents sampled for that; results don't depend on them.
SALTS, HOT_SHARE, HOT_SAMPLE = 32, 0.02, 2_000
#: Discounts (in documents) of words and of pairs, number of the words that make the worst passage, and
#: documents that fit the calibration at most. Chosen by folds among the teaching rows alone.
DISCOUNT, PAIR_DISCOUNT, TOP, CALIBRATION = 3.0, 10.0, 3, 12_000
BATCH_BYTES = 2 << 20
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PAIR, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII signs."""
    return (text or b"").decode("utf-8", "replace").lower().encode().translate(_BLANK).split()


def word_keys(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; two of a hundred million words share one with odds of 3 in 10,000."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit keys of word pairs from the keys of their words."""
    x = (left * _PAIR + right) * _STEP
    return x ^ (x >> np.uint64(29))


def _keyed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the words of all texts, the text that each is of, and the places of those that have a
    word on their left."""
    words = [words_of(t) for t in texts]
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    keys = word_keys([w for ws in words for w in ws])
    return keys, of, np.flatnonzero(of[1:] == of[:-1]) + 1 if len(of) else of


def _once(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of the first of each key in each text."""
    return np.unique(pair_keys(of.astype(np.uint64), keys), return_index=True)[1]


def _by_class(keys: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first of each key, and how many are of class 0 and of class 1."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    n, n1 = np.bincount(back, minlength=len(first)), np.bincount(back, y, len(first)).astype(np.int64)
    return first, n - n1, n1


def hot_words(rows: DataFrame) -> np.ndarray:
    """Keys of the words in over HOT_SHARE of the texts (at least 20): at most a text's mean of distinct
    words / HOT_SHARE."""
    share = HOT_SHARE

    def run(batches: Iterable) -> Iterable:
        import pyarrow as pa

        for b in slices(batches, lambda x: text_bytes(x.column(0)), BATCH_BYTES):
            keys, of, _ = _keyed(b.column(0).to_pylist())
            word, n = np.unique(keys[_once(keys, of)], return_counts=True)
            often = n > share * b.num_rows / 4
            yield pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(n[often])], ["word", "n"])

    total = rows.count()
    counts = rows.select("text").mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return np.array([r.word for r in counts.where(F.col("n") >= max(20, share * total)).select("word").collect()], np.int64).view(np.uint64)


def _counter(hot):
    """Per task: (salt, word, documents by class, pairs that it begins by class, null) and, for its left
    neighbours of equal counts, (salt, word, documents with each by class, 0, 0, neighbours); words by their
    keys. Salts are 0 but for hot words, whose neighbours have 1 to SALTS.

    A word or pair counts once a document: what is rare but repeated in one text says little of others.
    """
    names = ["salt", "word", "n0", "n1", "r0", "r1", "lefts"]

    def out(words, pairs):
        import pyarrow as pa

        word, y = map(np.concatenate, zip(*words))
        left, right, z = map(np.concatenate, zip(*pairs))
        first, n0, n1 = _by_class(word, y)
        begun, r0, r1 = _by_class(left, z)
        word, begun = word[first], left[begun]  # both sorted; what begins a pair is a word
        r = np.zeros((2, len(word)), np.int64)
        r[:, np.searchsorted(word, begun)] = r0, r1
        warm = np.isin(word, hot.value).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(warm), pa.array(word.view(np.int64)), *map(pa.array, (n0, n1, *r)), pa.nulls(len(word), pa.list_(pa.int64()))], names)
        if not len(left):
            return
        first, n0, n1 = _by_class(pair_keys(left, right), z)
        left, right = left[first], right[first]
        salt = np.where(np.isin(right, hot.value), 1 + (left % np.uint64(SALTS)).astype(np.int32), 0).astype(np.int32)
        order = np.lexsort((n1, n0, salt, right))
        left, right, salt, n0, n1 = (x[order] for x in (left, right, salt, n0, n1))
        new = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (right, salt, n0, n1)], axis=0)]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(left)).astype(np.int32)), pa.array(left.view(np.int64)))
        none = pa.array(np.zeros(len(new), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(salt[new]), pa.array(right[new].view(np.int64)), pa.array(n0[new]), pa.array(n1[new]), none, none, lists], names)

    def run(batches: Iterable) -> Iterable:
        words, pairs, held = [], [], 0
        for b in slices(batches, lambda x: text_bytes(x.column(1)), BATCH_BYTES):
            keys, of, inner = _keyed(b.column(1).to_pylist())
            y = (b.column(2).to_numpy(zero_copy_only=False) > 0)[of]
            at = _once(keys, of)
            words.append((keys[at], y[at]))
            left, right = keys[inner - 1], keys[inner]
            at = _once(pair_keys(left, right), of[inner])
            pairs.append((left[at], right[at], y[inner][at]))
            held += len(at)
            if held > HELD:
                yield from out(words, pairs)
                words, pairs, held = [], [], 0
        if words:
            yield from out(words, pairs)

    return run


def gather(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """(word, salt, n0, n1, r0, r1, neighbours, told): ordinary and toxic documents with a word, pairs that it
    begins in them, its distinct left neighbours in both classes together, and those (left, n0, n1) that
    over PAIR_DISCOUNT documents of a class have. Words and neighbours are 64-bit keys; one row a word, of
    hot words one a salt.

    Words are dealt to tasks, and the neighbours of `hot` words to SALTS rows each, so that no row holds
    more than a share of them.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(hot)
    each = rows.select("id", "text", "y").mapInArrow(lean(_counter(shipped)), "salt int, word long, n0 long, n1 long, r0 long, r1 long, lefts array<long>")
    each = each.repartition("word", "salt").select("word", "salt", F.explode_outer("lefts").alias("left"), "n0", "n1", "r0", "r1")
    pairs = each.groupBy("word", "salt", "left").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "r0", "r1")])
    own = [F.sum(F.when(F.col("left").isNull(), F.col(c)).otherwise(0)).alias(c) for c in ("n0", "n1")]
    strong = F.when(F.col("left").isNotNull() & (F.greatest("n0", "n1") > PAIR_DISCOUNT), F.struct("left", "n0", "n1"))
    words = pairs.groupBy("word", "salt").agg(*own, F.sum("r0").alias("r0"), F.sum("r1").alias("r1"), F.count("left").alias("neighbours"), F.collect_list(strong).alias("told"))
    return stored(words, "toxicity-words")


class Model:
    """Interpolated Kneser-Ney models of the two classes, as log ratios of toxic to ordinary.

    A class's word after another is told by its discounted pair counts; what the discount frees goes to
    its discounted word counts, and what that discount frees goes to the distribution of distinct left
    neighbours, which both classes share:

        p(w | v) = max(n(v,w) - PAIR_DISCOUNT, 0) / n(v,.) + g(v) q(w)
        q(w) = max(n(w) - DISCOUNT, 0) / n + f s(w),  s(w) = (distinct left neighbours of w + 1/2) / all

    with g and f such that each sums to one. Where neither class tells a pair its log ratio is one term of
    v plus one of w, and that of words which neither class tells is one constant; so the model is a table
    of terms: of told words, of words that begin told pairs, and what told pairs add. Terms are kept as
    they are and as if a document of class 0 or 1 with the word and pair had not been counted (the sums
    n and n(v,.) and the shared counts as they are). Tables are cut by key into blocks of about BLOCK
    entries, each broadcast.
    """

    def __init__(self, counts: DataFrame, bits: int) -> None:
        sums = [F.sum(c).alias(c) for c in ("n0", "n1", "r0", "r1", "neighbours")]
        cold = counts.where("salt = 0").select("word", "n0", "n1", "r0", "r1", "neighbours")
        words = cold.unionByName(stored(counts.where("salt > 0").groupBy("word").agg(*sums), "toxicity-hot"))
        pairs = counts.select("word", F.explode("told").alias("t")).select("t.left", "word", F.col("t.n0").alias("p0"), F.col("t.n1").alias("p1"))
        told = F.greatest("n0", "n1") > DISCOUNT
        cut = [F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT))) for c in ("n0", "n1")]
        n0, n1, cut0, cut1, links, size, known = (x or 0 for x in words.agg(F.sum("n0"), F.sum("n1"), *cut, F.sum("neighbours"), F.count("*"), F.count_if(told)).first())
        total = [max(float(n), 1.0) for n in (n0, n1)]
        free = [max(float(c), 0.5) / t for c, t in zip((cut0, cut1), total)]
        whole = links + 0.5 * max(size, 1 << bits)
        self.other = float(np.log(free[1]) - np.log(free[0]))

        def rest(c: int):
            """The share that class c's pairs after `left` leave to its words."""
            return F.sum(F.greatest(F.col(f"p{c}") - PAIR_DISCOUNT, F.lit(0.0))).alias(f"k{c}")

        pairs = stored(pairs, "toxicity-pairs")
        known_words = stored(words.where(told), "toxicity-told")  # those of told pairs among them
        lefts = pairs.groupBy(F.col("left").alias("word")).agg(rest(0), rest(1)).join(known_words.select("word", "r0", "r1"), "word")
        lefts = stored(lefts.select("word", *[F.when(F.col(f"r{c}") > 0, 1 - F.col(f"k{c}") / F.col(f"r{c}")).otherwise(1.0).alias(f"g{c}") for c in (0, 1)], "r0", "r1"), "toxicity-lefts")
        told_words = known_words.select("word", "n0", "n1", "neighbours")
        told_words = told_words.join(lefts.select("word", "g0", "g1"), "word", "left").fillna(1.0, ["g0", "g1"])
        history = lefts.withColumnRenamed("word", "left")
        told_pairs = pairs.join(history, "left").join(known_words.select("word", "n0", "n1", "neighbours"), "word")
        entries = known + pairs.count()
        n_blocks = max(-(-entries // BLOCK), 1)

        def mine(df: DataFrame, key: str, k: int):
            return (df.where(F.pmod(F.xxhash64(key), F.lit(n_blocks)) == k) if n_blocks > 1 else df).toArrow()

        def q(t, c, less):
            return np.maximum(t[f"n{c}"].to_numpy() - less - DISCOUNT, 0) / total[c] + free[c] * (t["neighbours"].to_numpy() + 0.5) / whole

        def p(t, c, less):
            pair, right, rest = t[f"p{c}"].to_numpy(), t[f"r{c}"].to_numpy(), t[f"g{c}"].to_numpy()
            return np.maximum(pair - less - PAIR_DISCOUNT, 0) / np.maximum(right, 1) + rest * q(t, c, less)

        def views(f, t):
            return np.stack([np.log(f(t, 1, b)) - np.log(f(t, 0, a)) for a, b in ((0, 0), (1, 0), (0, 1))], 1)

        self.blocks = []
        for k in range(n_blocks):
            w, x = mine(told_words, "word", k), mine(told_pairs, "word", k)
            key = np.concatenate([w["word"].to_numpy().view(np.uint64), pair_keys(x["left"].to_numpy().view(np.uint64), x["word"].to_numpy().view(np.uint64))])
            after = np.log(w["g1"].to_numpy()) - np.log(w["g0"].to_numpy())
            more = views(p, x) - views(q, x) - (np.log(x["g1"].to_numpy()) - np.log(x["g0"].to_numpy()))[:, None]
            terms = np.concatenate([np.column_stack([views(q, w) - self.other, after]), np.column_stack([more, np.zeros(len(x))])]).astype(np.float32)
            order = np.argsort(key, kind="stable")
            self.blocks.append(words.sparkSession.sparkContext.broadcast((key[order], terms[order])))

    def apply(self, rows: DataFrame, text: str, finish, schema, without: str | None = None) -> DataFrame:
        """`rows`, whose texts are binary, through finish(batch, ratios of each text's words); as if a text
        of class `without` had not been counted. All passes but the last store the ratios so far beside
        the rows."""
        kinds, at = rows.schema, rows.columns.index(text)
        y = rows.columns.index(without) if without else None
        width, other, extra = len(rows.columns), np.float32(self.other), max(rows.columns, key=len) + "_ratios"

        def one(block, first, last):
            def run(batches: Iterable) -> Iterable:
                import pyarrow as pa

                keys, terms = block.value
                terms = np.concatenate([terms, np.zeros((1, 4), np.float32)])

                def find(wanted):
                    if not len(keys):
                        return np.zeros(len(wanted), np.int64)
                    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    return np.where(keys[i] == wanted, i, len(keys))

                for b in slices(batches, lambda x: text_bytes(x.column(at)), BATCH_BYTES):
                    flat, of, inner = _keyed(b.column(at).to_pylist())
                    keys_of, back = np.unique(flat, return_inverse=True)
                    place = find(keys_of)[back]
                    view = np.zeros(len(flat), np.int64) if y is None else np.where(b.column(y).to_numpy(zero_copy_only=False) > 0, 2, 1)[of]
                    ratios = terms[place, view]
                    ratios[inner] += terms[place[inner - 1], 3] + terms[find(pair_keys(flat[inner - 1], flat[inner])), view[inner]]
                    if first:
                        ratios += other
                    else:
                        ratios += np.frombuffer(b"".join(b.column(width).to_pylist()), np.float32)
                    found = np.split(ratios, np.searchsorted(of, np.arange(1, b.num_rows)))
                    rest = pa.RecordBatch.from_arrays(b.columns[:width], b.schema.names[:width])
                    if last:
                        yield finish(rest, found)
                    else:
                        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([f.tobytes() for f in found], pa.binary())], [*rest.schema.names, extra])

            return run

        for k, block in enumerate(self.blocks):
            last = k == len(self.blocks) - 1
            rows = rows.mapInArrow(lean(one(block, k == 0, last)), schema if last else StructType([*kinds, StructField(extra, BinaryType())]))
            rows = rows if last else stored(rows, "toxicity-ratios")
        return rows


def features(ratios: np.ndarray) -> tuple[float, float, float]:
    """The log ratio of the likelihoods a word, over the whole text and over its TOP most toxic words in
    their places (what a short text lacks counts as zero); and the log of the number of words, as the worst
    of many words is worse by chance."""
    if not len(ratios):
        return 0.0, 0.0, 0.0
    best = np.partition(ratios, -TOP)[-TOP:] if len(ratios) > TOP else ratios
    return float(ratios.mean(dtype=np.float64)), float(best.sum(dtype=np.float64) / TOP), float(np.log(len(ratios) + 1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, calibration: int = CALIBRATION) -> tuple[Model, np.ndarray]:
    """The model, and the calibration's weights. All teaching rows are counted; a sample of them, each as
    if it had not been counted, fits the calibration. Null labels don't teach, of labels that repeat an id
    the largest does, null texts are empty; with one class or no labels at all every score is that class's
    smoothed share (one half without labels)."""
    hot = hot_words(teaching_rows(docs, labels, label, id_col, text_col, HOT_SAMPLE))
    model = Model(gather(teaching_rows(docs, labels, label, id_col, text_col), hot), bits)

    def finish(b, found):
        import pyarrow as pa

        f = np.array([features(x) for x in found]).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([*(pa.array(f[:, i]) for i in range(3)), b.column(2)], ["a", "b", "c", "y"])

    rows = teaching_rows(docs, labels, label, id_col, text_col, calibration)
    sample = model.apply(rows, "text", finish, "a double, b double, c double, y int", "y").toPandas()
    weights = logistic(sample[["a", "b", "c"]].to_numpy(float), (sample["y"] > 0).to_numpy(float))
    return model, weights


def score(docs: DataFrame, model: Model, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, whatever their names, and toxic_score (0 to 1), which takes the place of a
    column of that name. Rows are scored one by one, also those that repeat an id; a null text, or one
    without words, gets what the calibration says of no evidence."""
    names = [c for c in docs.columns if c != "toxic_score"]
    rows = positional(docs, names)
    text = f"c{names.index(text_col)}"

    def finish(b, found):
        import pyarrow as pa

        f = np.array([features(x) for x in found]).reshape(-1, 3)
        p = 1 / (1 + np.exp(-np.clip(f @ weights[:-1] + weights[-1], -30, 30)))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, "toxic_score"])

    schema = StructType([StructField(f.name, BinaryType() if f.name == text else f.dataType) for f in rows.schema] + [StructField("toxic_score", DoubleType())])
    out = model.apply(rows.withColumn(text, F.col(text).cast("binary")), text, finish, schema)
    return out.withColumn(text, F.col(text).cast("string")).toDF(*names, "toxic_score")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = score(docs, *fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
