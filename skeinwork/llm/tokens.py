"""Token ids of whole texts, fast: the tokenizers library sees each distinct chunk about once."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable

import numpy as np

#: Odd chunks and letter runs that a worker keeps (about 220 bytes each); bounds memory, never results. The
#: older half goes when the newer half is full, and what is used again joins the newer one.
CACHE_CHUNKS, CACHE_CORES = 100_000, 800_000
#: Texts that a tokenizer must encode chunk by chunk as it does whole.
PROBES = ("The  quick Brown fox, doesn't\n jump!\t42 times (a1b2) e.g. ends", " Äpfel, straße ŒUVRE é x-y_z *** a&&& \u3000b", "\n\nx  \n y ")
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_state() -> dict:
    """A dict that lives as long as the Python worker does, over all its tasks."""
    return sys.modules.setdefault("_skeinwork_worker", types.ModuleType("_skeinwork_worker")).__dict__


class Kept:
    """What `learn` makes of keys, for the last `limit` of them or so."""

    def __init__(self, learn: Callable[[list[bytes]], Iterable[bytes]], limit: int) -> None:
        self.learn, self.limit = learn, limit
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of(self, keys: list[bytes]) -> list[bytes]:
        if len(self.new) > self.limit // 2:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        out = list(map(new.get, keys))
        missing = [k for k, v in zip(keys, out) if v is None]
        if missing:
            unknown = []
            for k in missing:
                known = old.get(k)
                if known is None:
                    unknown.append(k)
                else:
                    new[k] = known
            new.update(zip(unknown, self.learn(unknown)))
            out = list(map(new.__getitem__, keys))
        return out


class ChunkEncoder:
    """Ids of texts by `path`'s tokenizer, whose pre-tokenizer must never join across ASCII white space
    and must drop it (as word_bpe_49k.json does): then a text's ids are those of its chunks in turn.

    Texts are parted, and ids put together, by columns; Python sees a batch's distinct parts alone. A chunk
    of lower-case Latin-1 letters and a tail of ASCII punctuation is two pre-tokens; new letter runs are
    encoded many at a time, all other chunks one by one. Ids are little-endian unsigned 32-bit.
    """

    def __init__(self, path: str, chunks: int | None = None, cores: int | None = None) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.whole = self.model.normalizer, self.model.pre_tokenizer
        # lower-case Latin-1 letters are normal already, and blanks alone part them
        self.letters = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.limits = chunks or CACHE_CHUNKS, cores or CACHE_CORES
        self.odd, self.runs = Kept(self._learn_odd, self.limits[0]), Kept(self._learn_runs, self.limits[1])
        want = [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(list(PROBES), add_special_tokens=False)]
        if self.encode([t.encode() for t in PROBES]) != want:
            raise ValueError(f"{path}: chunks between white space don't stand for themselves in this tokenizer")

    def _learn_odd(self, new: list[bytes]) -> list[bytes]:
        found = self.model.encode_batch_fast([t.decode("utf-8", "replace") for t in new], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn_runs(self, new: list[bytes]) -> list[bytes]:
        out = []
        self.model.normalizer, self.model.pre_tokenizer = self.letters
        try:
            for i in range(0, len(new), 256):
                part = new[i : i + 256]
                e = self.model.encode(b" ".join(part).decode(), add_special_tokens=False)
                ids, of = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
                ends = [0, *((np.flatnonzero(of[1:] != of[:-1]) + 1) * 4).tolist(), len(ids)]
                if len(ends) != len(part) + 1:
                    raise ValueError("the tokenizer does not keep letter runs apart")
                out += [ids[a:b] for a, b in zip(ends, ends[1:])]
        finally:
            self.model.normalizer, self.model.pre_tokenizer = self.whole
        return out

    def encode_column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts of an Arrow binary array (null: empty) in a row, and where
        each text's begin, with the end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        def strings(x):  # bytes as they are, valid or not
            return pc.cast(x, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))

        def sizes(x):
            return pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64)

        lists = pc.ascii_split_whitespace(strings(pc.fill_null(column, b"")))
        each = lists.values.dictionary_encode()
        chunks = each.dictionary
        core = pc.ascii_rtrim(chunks, characters=PUNCTUATION.decode())
        low = pc.ascii_lower(core)
        plain = pc.match_substring_regex(low, "\\A[a-zß-öø-ÿ]+\\z")
        heads = pc.if_else(plain, low, chunks).dictionary_encode()
        plain = plain.to_numpy(zero_copy_only=False)
        # a plain chunk's tail is what follows its letters
        after, n = sizes(core), np.where(plain, sizes(chunks) - sizes(core), 0)
        ends = np.cumsum(n)
        begin = np.frombuffer(chunks.buffers()[1], "<i4", len(chunks), 4 * chunks.offset) + after
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[np.repeat(begin - ends + n, n) + np.arange(int(n.sum()))]
        tails = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(np.append(0, ends).astype("<i4")), pa.py_buffer(data)]).dictionary_encode()
        head_at, tail_at = (x.indices.to_numpy(zero_copy_only=False) for x in (heads, tails))
        known = np.zeros(len(heads.dictionary), bool)
        known[head_at[plain]] = True
        words, tail_words = (x.dictionary.cast(pa.binary()).to_pylist() for x in (heads, tails))
        runs = iter(self.runs.of([w for w, k in zip(words, known) if k]))
        odd = iter(self.odd.of([w for w, k in zip(words, known) if not k] + tail_words))
        ids = pa.array([*(next(runs if k else odd) for k in known), *odd], pa.large_binary())
        ids = ids.take(pa.array(np.stack([head_at, tail_at + len(known)], 1).ravel(), pa.int64()))
        halves = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1, 8 * ids.offset)
        ids = pa.Array.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(np.ascontiguousarray(halves[::2])), ids.buffers()[2]])
        ids = ids.take(each.indices)
        cuts = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1, 8 * ids.offset) // 4
        flat = np.frombuffer(ids.buffers()[2] or b"", "<u4")[: cuts[-1]]
        return flat, cuts[lists.offsets.to_numpy()]

    def encode(self, texts: Iterable[bytes | None]) -> list[bytes]:
        """The ids of each text (None: empty), as bytes."""
        import pyarrow as pa

        flat, at = self.encode_column(pa.array(texts, pa.binary()))
        data, at = flat.tobytes(), (4 * at).tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]


def encoder(path: str, cache: tuple[int, int] | None = None) -> ChunkEncoder:
    """This worker's encoder for `path`; `cache` are its limits of odd chunks and letter runs."""
    state = worker_state()
    if ("encoder", path, cache) not in state:
        state["encoder", path, cache] = ChunkEncoder(path, *(cache or ()))
    return state["encoder", path, cache]


def trim() -> None:
    """Gives memory that this process no longer uses back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its memory
        pass


def lean(run: Callable[[Iterable], Iterable], encodes: bool = False) -> Callable[[Iterable], Iterable]:
    """`run`, which at its end gives memory that it no longer uses back to the system: the worker process
    lives on, and its next task may be another stage's. What another stage's encoders left in the worker
    goes at its start, unless it `encodes` itself; what they had in use is given back in any case."""
    state, tidy = worker_state, trim

    def wrapped(batches: Iterable) -> Iterable:
        left = [] if encodes else [k for k in state() if isinstance(k, tuple)]
        for k in left:
            del state()[k]
        if left or encodes:
            tidy()
        yield from run(batches)
        tidy()

    return wrapped


def slices(batches: Iterable, size: Callable[[object], np.ndarray], limit: int) -> Iterable:
    """Record batches cut so that each holds about `limit` bytes of text at most (or one row)."""
    for batch in batches:
        start, sizes = 0, np.cumsum(size(batch))
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column) -> np.ndarray:
    """Bytes of each value of an Arrow binary column (null: 0)."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
