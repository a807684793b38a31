"""The registered queries over whole small tables, against brute force or their SQL."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import tokenizers
from brute import components, leaks, toxicity

from skeinwork.llm.catalog import ORACLES, QUERIES
from skeinwork.llm.tokens import tokenizer_path

DIR = "/root/testdata/sf0.001"


def rows(table):
    return duckdb.sql(f"select * from '{DIR}/{table}.parquet' order by 1").fetchall()


@pytest.fixture(scope="module")
def docs():
    return [(r[0], r[1] or "") for r in rows("documents")]


@pytest.fixture(scope="module")
def ids(docs):
    model = tokenizers.Tokenizer.from_file(tokenizer_path())
    return {i: np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for i, t in docs}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    cols = sorted(rel.columns)
    got = QUERIES[name](spark, DIR).select(*cols).collect()
    want = rel.select(*cols).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_op1(spark, ids):
    got = QUERIES["op1_hierarchical_packing"](spark, DIR).collect()
    end = np.array([1], "<u4").tobytes()
    by, seq = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(ids)
    for i, pieces in by.items():
        whole, at = ids[i] + end, 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole) // 4
            assert r.ids_crc32 == zlib.crc32(whole[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(whole) // 4
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_op2(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op2_hash_tree_shards"](spark, DIR).collect()}
    assert {i: (r.size, r.text_crc32) for i, r in got.items()} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs}
    for s in range(8):
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(sum(r.shard == s for r in got.values())))
    assert all(r.grown_shard in (r.shard, 8) for r in got.values())


def test_op3_op8(spark, docs):
    for name, cut in (("op3_latent_votes", 0.3), ("op8_kneser_ney", 0.5)):
        got = {r.doc_id: r for r in QUERIES[name](spark, DIR).collect()}
        assert set(got) == {i for i, _ in docs}
        for i, r in got.items():
            assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)


def test_op8_against_brute_force(spark, docs):
    from skeinwork.llm import toxicity as X

    labels = {r[0]: r[2] for r in rows("labels")}
    want = toxicity(docs, labels, X.DISCOUNT, X.PAIR_DISCOUNT, X.TOP, 1 << X.BITS)
    got = {r.doc_id: r.score for r in QUERIES["op8_kneser_ney"](spark, DIR).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-4


def test_op4(spark, ids):
    at, end = 0, np.array([2], "<u4").tobytes()
    got = {r.doc_id: r for r in QUERIES["op4_token_files"](spark, DIR).collect()}
    for i in sorted(ids):
        whole = ids[i] + end
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(whole) // 4, zlib.crc32(whole))
        at += len(whole) // 4


def test_op5(spark, docs):
    word = "".join
    either = lambda w: word(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    keys = "|".join([either("password"), either("passwd"), either("secret"), either("token"), "[aA][pP][iI]_?[kK][eE][yY]"])
    rules = [("assign", rf"""({keys})["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    got = {r.doc_id: r for r in QUERIES["op5_blob_ledger"](spark, DIR).collect()}
    for i, t in docs:
        spans = sorted((m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(rules) for m in re.finditer(p, t) if len(m[g]) >= n)
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert got[i].spans == text and got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]


def test_op7(spark, docs):
    want = {i: (n, hit, found) for i, n, hit, found in leaks(docs, rows("benchmark"))}
    got = QUERIES["op7_winnowing"](spark, DIR).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_op9(spark, docs):
    got = QUERIES["op9_circulant_minhash"](spark, DIR).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(docs, 3, 85, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
