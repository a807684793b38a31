"""Hierarchical packing: length tiers, gaps of long windows filled from shorter tiers, balanced steps."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, spread, table
from .tokens import encoder, lean, slices, text_bytes, tokenizer_path

TIERS = (256, 512, 1024, 2048)
#: Tokens packed together in a task: larger fits better and takes more memory.
GROUP_TOKENS, STEP_WINDOWS, BATCH_BYTES = 1 << 20, 8, 4 << 20

#: length, document, start: a stretch of a document's ids.
Piece = tuple[int, int, int]


def pack(pieces: list[Piece], tiers: tuple[int, ...] = TIERS, last: bool = False) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows (lists of pieces) that fill a tier's length exactly, and the pieces left over.

    Pieces longer than the longest tier fill whole windows of it first. Every other piece is routed
    to the shortest tier that holds it; from the longest tier down, a piece opens a window of its
    tier, and the gap takes the longest shorter-tier piece that fits, again and again, then a cut of
    the shortest piece that is left. With `last`, what is left over fills windows of powers of two.
    """
    windows: list[list[Piece]] = []
    top = tiers[-1]
    pool: list[Piece] = []
    for n, doc, start in pieces:
        while n >= top:
            windows.append([(top, doc, start)])
            n, start = n - top, start + top
        if n:
            pool.append((n, doc, start))
    pool.sort()
    floor = {t: s + 1 for s, t in zip((0, *tiers), tiers)}
    left: list[Piece] = []
    for t in reversed(tiers):
        while pool and pool[-1][0] >= floor[t]:
            first = pool.pop()
            window, gap = [first], t - first[0]
            while gap and pool:
                # what fits the gap is of a shorter tier (or of the shortest)
                i = bisect_right(pool, (gap, 1 << 62, 0))
                if i:
                    piece = pool.pop(i - 1)
                else:
                    n, doc, start = pool.pop(0)
                    piece = (gap, doc, start)
                    insort(pool, (n - gap, doc, start + gap))
                window.append(piece)
                gap -= piece[0]
            if gap:
                left += window
            else:
                windows.append(window)
    if not last:
        return windows, left
    total = sum(n for n, _, _ in left)
    while total:
        size = min(top, 1 << (total.bit_length() - 1))
        window, gap = [], size
        while gap:
            n, doc, start = left.pop()
            window.append((min(n, gap), doc, start))
            if n > gap:
                left.append((n - gap, doc, start + gap))
            gap -= window[-1][0]
        windows.append(window)
        total -= size
    return windows, []


def balanced_steps(windows: list[list[Piece]], size: int = STEP_WINDOWS) -> list[int]:
    """A step number for each window: steps of about `size` windows of like attention cost (the sum of
    squared piece lengths), dealt to and fro in the order of cost."""
    cost = sorted(range(len(windows)), key=lambda i: (-sum(n * n for n, _, _ in windows[i]), i))
    steps = max(1, -(-len(windows) // size))
    out = [0] * len(windows)
    for k, i in enumerate(cost):
        lap, at = divmod(k, steps)
        out[i] = at if lap % 2 == 0 else steps - 1 - at
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_id long, ids binary"


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, group_tokens: int = GROUP_TOKENS, cache: tuple[int, int] | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per piece, in the schema PIECES (ids: little-endian unsigned 32-bit; null unless
    `with_ids`).

    Each task packs what it reads, `group_tokens` at a time, with no shuffle; what does not fill a
    window goes on to the next group, and a task's last pieces fill windows of powers of two, so
    that no window is padded. sequence_id and step_id are numbered by task, as a scan deals rows to
    tasks, and a task that runs again gives the same rows. A null text is empty and is its end id
    alone; rows that repeat an id are packed each by itself; an empty table gives no piece.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end = encoder(tokenizer, cache), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 36
        held: dict[int, tuple[object, bytes]] = {}
        pieces: list[Piece] = []
        state = {"doc": 0, "seq": base, "step": base, "tokens": 0}

        def flush(last: bool) -> Iterator:
            nonlocal pieces, held
            windows, pieces = pack(pieces, tiers, last)
            steps = balanced_steps(windows)
            rows = []
            for window, step in zip(windows, steps):
                offset, size = 0, sum(n for n, _, _ in window)
                for n, doc, start in window:
                    doc_id, ids = held[doc]
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((doc_id, start, n, zlib.crc32(part), len(ids) // 4, state["seq"], offset, size, state["step"] + step, part if with_ids else None))
                    offset += n
                state["seq"] += 1
            state["step"] += max(steps, default=-1) + 1
            held = {doc: held[doc] for _, doc, _ in pieces}
            state["tokens"] = sum(n for n, _, _ in pieces)
            if rows:
                cols = list(zip(*rows))
                names = [c.split()[0] for c in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, cols)], names)

        for b in slices(batches, lambda x: text_bytes(x.column(1)), batch_bytes):
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                held[state["doc"]] = (doc_id, ids + end)
                pieces.append((len(ids) // 4 + 1, state["doc"], 0))
                state["doc"] += 1
                state["tokens"] += len(ids) // 4 + 1
                if state["tokens"] >= group_tokens:
                    yield from flush(False)
        yield from flush(True)

    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("binary").alias("text")).mapInArrow(lean(run, encodes=True), PIECES)


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_path(), 1, with_ids=False).drop("ids")
