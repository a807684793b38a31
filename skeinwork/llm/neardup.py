"""Near-duplicates: circulant MinHash, banding, exact Jaccard on full shingle sets, components."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, spread, stored, table
from .tokens import lean, slices, text_bytes

ROWS, MISS = 4, 1e-5
#: Buckets up to SMALL sets yield pairs; larger ones are compared in blocks of BLOCK sets inside tasks.
SMALL, BLOCK = 8, 768
#: Ids of sets to verify that may be broadcast; beyond it texts are shuffled to them.
BROADCAST_IDS = 2_000_000
BATCH_BYTES, CHUNK = 4 << 20, 1 << 16


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands so that a pair at the threshold meets in none with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `width`-word shingles; of fewer words, the sequence as one."""
    from xxhash import xxh3_64_intdigest

    words = (text or b"").lower().split()  # bytes: A-Z alone are lowered, and the six ASCII blanks split
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    w = min(width, len(h))
    if not w:
        return h
    out = _mix64(h[: len(h) - w + 1])
    for i in range(1, w):
        out = _mix64(out + h[i : len(h) - w + 1 + i])
    return np.unique(out)


def band_keys(sets: list[np.ndarray], bands: int, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each set (not empty) and band.

    Coordinate k of a set is the least pi(sigma(x) + k mod 2^32) over its elements: sigma spreads the
    elements on a circle of 2^32 places, pi permutes the places, and each coordinate turns the circle
    by one more place. Both are bijections, so two permutations give all coordinates.
    """
    ends = np.cumsum([len(s) for s in sets])
    starts = np.concatenate([[0], ends[:-1]])
    place = (_mix64(np.concatenate(sets) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(rows):
            y = place + np.uint32(b * rows + r)
            y ^= y >> np.uint32(16)
            y *= np.uint32(0x85EBCA6B)
            y ^= y >> np.uint32(13)
            y *= np.uint32(0xC2B2AE35)
            y ^= y >> np.uint32(16)
            key = _mix64(key + np.minimum.reduceat(y, starts))
        keys[:, b] = key
    return keys


def _groups(sets: list[np.ndarray]) -> Iterable[list[int]]:
    """Indexes of the sets that aren't empty, in runs of about CHUNK elements."""
    run, n = [], 0
    for i, s in enumerate(sets):
        if len(s):
            run.append(i)
            n += len(s)
        if n >= CHUNK:
            yield run
            run, n = [], 0
    if run:
        yield run


def _sketcher(width: int, bands: int):
    def run(batches: Iterable) -> Iterable:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in slices(batches, lambda x: text_bytes(x.column(1)), BATCH_BYTES):
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            keys: list = [[]] * len(sets)
            for run in _groups(sets):
                found = band_keys([sets[i] for i in run], bands).view(np.int64)
                for i, k in zip(run, found):
                    keys[i] = k
            digests = [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n", "node", "keys"],
            )

    return run


def _set_maker(width: int):
    def run(batches: Iterable) -> Iterable:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in slices(batches, lambda x: text_bytes(x.column(1)), BATCH_BYTES):
            sets = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
            same = [i for i, (s, node) in enumerate(zip(sets, batch.column(2).to_pylist())) if xxh3_128_digest(s) == node]
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(same, pa.int64())), pa.array([sets[i] for i in same], pa.binary())], ["node", "set"])

    return run


def _linked(part: int, whole: int):
    """a, b of the pairs whose sets are similar: whole * |intersection| >= part * |union|."""

    def run(batches: Iterable) -> Iterable:
        import pyarrow as pa

        for batch in slices(batches, lambda x: text_bytes(x.column(2)) + text_bytes(x.column(3)), BATCH_BYTES):
            keep = []
            for i, (s, t) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                if whole * min(len(x), len(y)) < part * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if whole * common >= part * (len(both) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def forest(sets: list[np.ndarray], part: int, whole: int) -> list[tuple[int, int]]:
    """Edges (i, root) that connect exactly what links between the sets connect; one a set at most."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(fresh) - 1
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    common = np.zeros((m, m), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        width = 4096
        for c in range(0, int(column[-1]) + 1, width):
            lo, hi = np.searchsorted(column, [c, c + width])
            x = np.zeros((m, width), np.float32)
            x[owner[lo:hi], column[lo:hi] - c] = 1
            common += x @ x.T
    shared = np.rint(common).astype(np.int64)
    near = whole * shared >= part * (n[:, None] + n[None, :] - shared)
    root = np.arange(m)
    while True:
        new = np.where(near, root[None, :], m).min(axis=1)
        new = np.minimum(new, root)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    return [(i, int(r)) for i, r in enumerate(root) if r != i]


def _block_links(part: int, whole: int):
    def run(t):
        import pyarrow as pa

        first: dict[bytes, int] = {}
        for i, node in enumerate(t.column("node").to_pylist()):
            first.setdefault(node, i)
        nodes, rows = list(first), t.column("set").take(pa.array(list(first.values()), pa.int64())).to_pylist()
        edges = forest([np.frombuffer(x, np.uint64) for x in rows], part, whole)
        return pa.table({"a": pa.array([nodes[i] for i, _ in edges], pa.binary()), "b": pa.array([nodes[r] for _, r in edges], pa.binary())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that the edges (a, b) reach from each node they name.

    Every round takes the least label among a node's neighbours, then that label's own label, so
    labels travel twice as far each time, until none changes; labels are written to the shared folder each
    round.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(step.join(hop, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for each row of `docs`.

    Rows are linked if whole * |intersection| >= part * |union| of their sets of `width`-word
    shingles; component_id is the least id that links reach, and the row with that id is kept.

    1. sketch: set size, digest of the set, and band keys from circulant MinHash; rows of one digest
       are one node from here on, so copies are never paired;
    2. nodes that share a band key meet in a bucket. Small buckets give pairs; large ones are cut into
       blocks, whose nodes are compared inside a task that returns only edges of a spanning forest;
    3. sets of the nodes concerned are made anew from the texts, and links are confirmed on them;
    4. components by repeated least labels.

    A pair at the threshold escapes all bands with probability MISS. A null or blank text has an empty
    set and no links. Rows that repeat an id are documents of their own. A text that only rows of null
    ids have is linked with nothing: its component_id is null, and they are kept; a null id whose text
    other rows have too belongs to their component. Empty tables give empty results; further columns are
    ignored.
    """
    bands = bands_for(part / whole)
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("binary").alias("text"))
    sketch = stored(rows.mapInArrow(lean(_sketcher(width, bands)), "id long, n long, node binary, keys array<long>"), "sketch")
    nodes = stored(sketch.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.min("keys").alias("keys")), "nodes")
    placed = nodes.select("node", "id", F.explode("keys").alias("key"))
    buckets = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(placed.join(buckets, "key"), "buckets")

    need = stored(members.where("id is not null").select("node", F.col("id").alias("_id")).distinct(), "need")
    source = rows.join(F.broadcast(need) if need.count() <= BROADCAST_IDS else need, F.col("id") == F.col("_id")).select("id", "text", "node")
    sets = source.mapInArrow(lean(_set_maker(width)), "node binary, set binary")

    few = members.where(F.col("n") <= SMALL).select("key", "node")
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b").distinct()
    sided = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    links = sided.select("a", "b", "set_a", "set_b").mapInArrow(lean(_linked(part, whole)), "a binary, b binary")

    many = members.where(F.col("n") > SMALL).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    many = many.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("key", "node", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    blocks = many.join(sets, "node").groupBy("key", "lo", "hi").applyInArrow(_block_links(part, whole), "a binary, b binary")

    labels = components(links.unionByName(blocks))
    found = nodes.select("node", "id").join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    found = stored(found, "found")
    least = found.groupBy("label").agg(F.min("id").alias("component_id"))
    of_node = found.select("node", "label").join(least, "label").select(F.col("node").alias("key"), "component_id")
    # rows without a set get a key of their own, so that they do not meet in one null partition
    keyed = sketch.select("id", "n", F.coalesce("node", F.concat(F.lit("#"), F.col("id").cast("string")).cast("binary"), F.lit("#").cast("binary")).alias("key"))
    out = keyed.join(of_node, "key", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), 3, 85, 100)
