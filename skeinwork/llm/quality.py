"""Quality by nearest-neighbour voting among latent-semantic vectors of labelled documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, spread, table
from .labelled import held_out, teaching_rows
from .tokens import lean, slices, text_bytes

#: Labelled documents whose vectors vote at most, latent dimensions, neighbours, and the power of the
#: similarity that weighs a neighbour's label.
REFERENCES, RANK, NEIGHBOURS, POWER = 4000, 32, 25, 8
#: A word is a term if so many references have it; of more than VOCABULARY such words the most frequent are.
LEAST, VOCABULARY = 3, 200_000
BATCH_BYTES, BLOCK = 4 << 20, 1024
#: Beside its words a document has shapes of words as terms. Tail of the word (letter, digit, stop, comma, bar alone,
#: other sign, non-ASCII), its length (four steps), whether it repeats the word before, and whether the
#: same two words stood together earlier in the text; and the tails of two words in a row.
TAILS, LENGTHS = 7, 4
TERMS = TAILS * LENGTHS * 4 + TAILS * TAILS
_TAIL = np.array([0 if chr(c).isalpha() and c < 128 else 1 if chr(c).isdigit() and c < 128 else 2 if c in b".!?" else 3 if c in b",;:" else 5 if c < 128 else 6 for c in range(256)])


def term_counts(text: bytes | None) -> np.ndarray:
    """How often each shape stands in the text."""
    from xxhash import xxh3_64_intdigest

    words = (text or b"").split()
    if not words:
        return np.zeros(TERMS)
    n = len(words)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    size = np.fromiter(map(len, words), np.int64, n)
    tail = _TAIL[np.fromiter((w[-1] for w in words), np.int64, n)]
    tail[(size == 1) & (tail == 5)] = 4
    again = np.zeros(n, np.int64)
    again[1:] = h[1:] == h[:-1]
    seen = np.ones(n, np.int64)
    seen[0] = 0
    _, first = np.unique(h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1], return_index=True)
    seen[first + 1] = 0
    shape = ((tail * LENGTHS + np.searchsorted([3, 6, 10], size, side="right")) * 2 + again) * 2 + seen
    out = np.bincount(shape, minlength=TERMS).astype(float)
    out[TAILS * LENGTHS * 4 :] = np.bincount(tail[:-1] * TAILS + tail[1:], minlength=TAILS * TAILS)
    return out


_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SIGNS = bytes(32 if c >= 128 or chr(c).isalnum() or c < 33 else c for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Words (runs of letters, digits and non-ASCII signs, as they are written) and runs of other signs."""
    return (text or b"").translate(_BLANK).split() + (text or b"").translate(_SIGNS).split()


class Rows:
    """Sparse rows of terms: of each entry its row, its term and its value, in the order of rows."""

    def __init__(self, texts: list[bytes | None], index: dict[bytes, int]) -> None:
        terms, total = [terms_of(t) for t in texts], 0
        self.n = len(texts)
        of = np.repeat(np.arange(self.n), [len(t) for t in terms])
        ids = np.fromiter((index.get(w, -1) for t in terms for w in t), np.int64, len(of))
        key, count = np.unique((of * (len(index) + 1) + ids)[ids >= 0], return_counts=True)
        self.row, self.term = np.divmod(key, len(index) + 1)
        total = np.maximum(np.bincount(of, minlength=self.n), 1)
        self.share = count / total[self.row]
        self.shapes = np.array([term_counts(t) for t in texts]).reshape(-1, TERMS)


def _sums(index: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of `values` by index (sorted), for 0 to n - 1."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(index):
        first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        out[index[first]] = np.add.reduceat(values, first)
    return out


def _weighed(rows: Rows, idf: np.ndarray, shape_idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the entries, and rows of shapes: square roots of shares, weighed by idf, words and shapes
    of a document each of length one (or zero)."""
    words = np.sqrt(rows.share) * idf[rows.term]
    words = (words / np.sqrt(np.maximum(np.bincount(rows.row, words**2, rows.n), 1e-24))[rows.row]).astype(np.float32)
    shapes = np.sqrt(rows.shapes / np.maximum(rows.shapes.sum(1, keepdims=True), 1)) * shape_idf
    return words, (shapes / np.maximum(np.linalg.norm(shapes, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def vocabulary(sample: DataFrame) -> dict[bytes, int]:
    """Numbers of the terms that LEAST rows of the sample have, the most frequent first."""

    def run(batches: Iterable) -> Iterable:
        import pyarrow as pa

        seen = Counter()
        for b in slices(batches, lambda x: text_bytes(x.column(0)), BATCH_BYTES):
            for t in b.column(0).to_pylist():
                seen.update(set(terms_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    counts = sample.select("text").mapInArrow(lean(run), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "term").limit(VOCABULARY).select("term").toArrow()
    return {w: i for i, w in enumerate(often["term"].to_pylist())}


def document_frequencies(docs: DataFrame, index: dict[bytes, int], text_col: str = "text") -> tuple[int, np.ndarray]:
    """Documents, and documents with each term and then each shape, over all of `docs`; a task sends one row."""
    shipped = docs.sparkSession.sparkContext.broadcast(index)
    size = len(index) + TERMS

    def run(batches: Iterable) -> Iterable:
        import pyarrow as pa

        n, df = 0, np.zeros(size, np.int64)
        for b in slices(batches, lambda x: text_bytes(x.column(0)), BATCH_BYTES):
            rows = Rows(b.column(0).to_pylist(), shipped.value)
            n += rows.n
            df[: len(index)] += np.bincount(rows.term, minlength=len(index))
            df[len(index) :] += (rows.shapes > 0).sum(0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["term", "df"])

    parts = docs.select(quoted(text_col).cast("binary").alias("text")).mapInArrow(lean(run), "term long, df long")
    sums = parts.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size + 1, np.int64)
    df[sums["term"].to_numpy()] = sums["df"].to_numpy()  # the number of documents is the last
    return int(df[-1]), df[:-1]


def basis(rows: Rows, words: np.ndarray, shapes: np.ndarray, size: int, steps: int = 3) -> np.ndarray:
    """The leading right singular vectors of the references' rows (terms, then shapes), by subspace iteration."""
    back = np.argsort(rows.term, kind="stable")
    term, row, value = rows.term[back], rows.row[back], words[back]
    rank = min(RANK, rows.n)
    v = np.random.default_rng(7).standard_normal((size + TERMS, rank)).astype(np.float32)

    def forward(v: np.ndarray) -> np.ndarray:
        return sum(_sums(rows.row[s], rows.n, words[s, None] * v[rows.term[s]]) for s in _cuts(len(words))) + shapes @ v[size:]

    def backward(u: np.ndarray) -> np.ndarray:
        return np.concatenate([sum(_sums(term[s], size, value[s, None] * u[row[s]]) for s in _cuts(len(value))), shapes.T @ u])

    for _ in range(steps):
        v = backward(np.linalg.qr(forward(v))[0])
    q, _ = np.linalg.qr(v)
    u = forward(q)
    values, turn = np.linalg.eigh(u.T @ u)
    return (q @ turn[:, np.argsort(-values)]).astype(np.float32)


def _cuts(n: int, size: int = 1 << 19) -> list[slice]:
    return [slice(s, s + size) for s in range(0, max(n, 1), size)]


def latent(rows: Rows, words: np.ndarray, shapes: np.ndarray, basis: np.ndarray, size: int) -> np.ndarray:
    """Unit latent vectors; zero for no terms."""
    x = _sums(rows.row, rows.n, words[:, None] * basis[rows.term]) + shapes @ basis[size:]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vote(x: np.ndarray, references: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Share of label 1 among the nearest references, weighed by a power of the cosine; exact products,
    in blocks. Of references as near as the last neighbour all vote. A vector of zeros gets the prior."""
    out = np.empty(len(x))
    k = min(NEIGHBOURS, len(references))
    for s in range(0, len(x), BLOCK):
        cos = np.maximum(np.round(x[s : s + BLOCK] @ references.T, 6), 0)
        last = np.partition(cos, -k, axis=1)[:, -k, None]
        w = np.where(cos >= last, cos, 0) ** POWER
        out[s : s + BLOCK] = (w @ y + 0.02 * prior) / (w.sum(1) + 0.02)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", references: int = REFERENCES) -> dict:
    """The latent space and the vectors and labels of about `references` labelled documents (fewer: all).

    Terms are the words and runs of signs that LEAST references have, at most VOCABULARY, and the TERMS
    shapes; their idf counts all documents. The space is spanned by the leading singular vectors of the
    references' weighed rows. So the model's size is bounded by these parameters. Null labels don't
    teach, and of labels that repeat an id the largest does. Empty tables give an empty model, and prior
    one half.
    """
    sample = teaching_rows(docs, labels, label, id_col, text_col, references)
    index = vocabulary(sample)
    n, df = document_frequencies(docs, index, text_col)
    idf = np.log((n + 1) / (df + 1)) + 1
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable) -> Iterable:
        import pyarrow as pa

        for b in slices(batches, lambda x: text_bytes(x.column(1)), BATCH_BYTES):
            rows = Rows(texts := b.column(1).to_pylist(), shipped.value)
            ends = np.searchsorted(rows.row, np.arange(rows.n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (rows.term, rows.share)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.crc32(t or b"") for t in texts], pa.int64()), *lists, pa.array(list(rows.shapes), pa.list_(pa.float64())), b.column(2)], ["id", "crc", "terms", "shares", "shapes", "y"])

    sample = sample.withColumn("id", F.col("id").cast("long")).mapInArrow(lean(run), "id long, crc long, terms array<long>, shares array<double>, shapes array<double>, y int")
    sample = sample.toArrow().combine_chunks().sort_by([("id", "ascending"), ("crc", "ascending")])
    y = (sample["y"].to_numpy() > 0).astype(float)
    model = {"index": index, "idf": idf[: len(index)], "shape_idf": idf[len(index) :], "y": y, "prior": float((y.sum() + 0.5) / (len(y) + 1))}
    if len(y):
        rows = Rows([], {})
        rows.n, rows.shapes = len(y), np.array(sample["shapes"].to_pylist())
        rows.row = np.repeat(np.arange(rows.n), [len(t) for t in sample["terms"]])
        rows.term, rows.share = (np.concatenate([x.values.to_numpy() for x in sample[k]]) for k in ("terms", "shares"))
        words, shapes = _weighed(rows, model["idf"], model["shape_idf"])
        model["basis"] = basis(rows, words, shapes, len(index))
        model["references"] = latent(rows, words, shapes, model["basis"], len(index))
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; a text without terms, and every text if nothing was labelled, gets
    the share of label 1 among the references. Null texts are empty; every row is scored by itself, and
    columns beyond id and text are ignored."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable) -> Iterable:
        import pyarrow as pa

        m = shipped.value
        for b in slices(batches, lambda x: text_bytes(x.column(1)), BATCH_BYTES):
            p = np.full(b.num_rows, m["prior"])
            if len(m["y"]):
                rows = Rows(b.column(1).to_pylist(), m["index"])
                x = latent(rows, *_weighed(rows, m["idf"], m["shape_idf"]), m["basis"], len(m["index"]))
                p = vote(x, m["references"], m["y"], m["prior"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["id", "score"])

    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "id long, score double").withColumnRenamed("id", id_col)


def op3_latent_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
