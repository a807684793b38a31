import random
import zlib

import numpy as np
import pytest

from skeinwork.llm import packing, tokenfiles
from skeinwork.llm.tokens import ChunkEncoder, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
TEXTS = ["", None, " \n\t", "Hello, WORLD. it's don't 'sabc 12ab3", "Äa ÿ- straße ŒUVRE Σας ΑΣ İstanbul", "a\x1cb x y ́z é", "<|endoftext|>x <|startoftext|>", "%%% a&&& |", "ab " * 9000, "日本語 テキスト 🙂"]


def _ids(text):
    model = tokenizers.Tokenizer.from_file(tokenizer_path())
    return model.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    enc = ChunkEncoder(tokenizer_path())
    got = enc.encode([None if t is None else t.encode() for t in TEXTS])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [_ids(t) for t in TEXTS]


def test_encoder_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        ChunkEncoder(tokenizer_path("byte_bpe_50k.json"))


def test_encoder_equals_library_on_a_whole_table():
    import duckdb

    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    got = ChunkEncoder(tokenizer_path()).encode([(t or "").encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [_ids(t) for t in texts]


def test_encoder_forgets_without_harm(monkeypatch):
    import skeinwork.llm.tokens as T

    monkeypatch.setattr(T, "CACHE_CHUNKS", 5)
    monkeypatch.setattr(T, "CACHE_CORES", 3)
    enc = ChunkEncoder(tokenizer_path())
    for _ in range(2):
        for t in TEXTS:
            assert np.frombuffer(enc.encode([(t or "").encode()])[0], "<u4").tolist() == _ids(t)


def test_encoder_parts_texts_by_columns():
    """Python meets a batch's distinct parts alone, also in a slice and in bytes that are no UTF-8."""
    pa = pytest.importorskip("pyarrow")
    model = tokenizers.Tokenizer.from_file(tokenizer_path())
    enc = ChunkEncoder(tokenizer_path())
    asked, runs = [], enc.runs.of
    enc.runs.of = lambda keys: asked.extend(keys) or runs(keys)
    texts = [b"left out", b"The the, THE. the; " * 500, None, b"", b" \xff\xfe the caf\xc3 \xc3\xa9t\xc3\xa9!? ", " ß ÿ÷ straße... 3x the--".encode()]
    flat, at = enc.encode_column(pa.array(texts, pa.binary())[1:])
    want = [model.encode((t or b"").decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts[1:]]
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert sorted(asked) == sorted(w.encode() for w in ("the", "été", "ß", "straße"))


@pytest.mark.parametrize("seed", range(20))
def test_pack_covers_everything(seed):
    rng = random.Random(seed)
    pieces = [(rng.choice([1, 5, 300, 700, 2048, 5000, rng.randint(1, 3000)]), i, 0) for i in range(rng.randint(0, 60))]
    windows, left = packing.pack(list(pieces), last=True)
    assert not left
    cover = {}
    for w in windows:
        size = sum(n for n, _, _ in w)
        assert size <= 2048 and size & (size - 1) == 0
        for n, d, s in w:
            cover.setdefault(d, []).append((s, n))
    for n, d, _ in pieces:
        at = 0
        for s, k in sorted(cover[d]):
            assert s == at
            at += k
        assert at == n
    steps = packing.balanced_steps(windows)
    assert len(steps) == len(windows)


def test_pack_documents(documents):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(0, "again", "s"), (None, "null id", "s")]
    got = packing.pack_documents(documents(rows), tokenizer_path(), 1).collect()
    for q in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == q), key=lambda r: r.offset):
            assert r.offset == at and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
            at += r.length
        assert at == r.sequence_length <= 2048
    whole = b"".join(r.ids for r in sorted((r for r in got if r.doc_id == 8), key=lambda r: r.start))
    assert np.frombuffer(whole, "<u4").tolist() == _ids(TEXTS[8]) + [1]
    assert sum(r.length for r in got) == sum(len(_ids(t)) + 1 for _, t, _ in rows)
    assert packing.pack_documents(documents([]), tokenizer_path()).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, documents, tmp_path, encoding):
    rows = [(100 - i, t, "s") for i, t in enumerate(TEXTS)]
    path = f"file://{tmp_path}/{encoding}"
    tokenfiles.write_tokens(documents(rows), path, tokenizer_path(), 2, encoding=encoding, page_rows=2)
    at = 0
    got = {r.doc_id: r for r in tokenfiles.read_tokens(spark, path).collect()}
    for i, t, _ in sorted(rows):
        ids = [*_ids(t), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (at, len(ids), ids)
        at += len(ids)
    plan = spark.read.parquet(path).where("doc_id = 95").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan and "EqualTo(doc_id,95)" in plan


def test_empty_token_files(spark, documents, tmp_path):
    tokenfiles.write_tokens(documents([]), f"file://{tmp_path}/none", tokenizer_path(), 2)
    assert tokenfiles.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


def test_other_stages_drop_what_encoders_left():
    from skeinwork.llm import tokens as T

    key = ("encoder", "test", None)
    T.worker_state()[key] = object()
    assert list(T.lean(lambda b: b, encodes=True)([1])) == [1] and key in T.worker_state()
    assert list(T.lean(lambda b: b)([1, 2])) == [1, 2] and key not in T.worker_state()


def test_an_encoding_task_begins_tidy(monkeypatch):
    """What other stages had in use goes before texts are encoded, not only afterwards."""
    import skeinwork.llm.tokens as T

    calls = []
    monkeypatch.setattr(T, "trim", lambda: calls.append(1))
    run = iter(T.lean(lambda b: b, encodes=True)([1]))
    assert next(run) == 1 and calls == [1] and list(run) == [] and calls == [1, 1]
