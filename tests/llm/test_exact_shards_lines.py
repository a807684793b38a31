import hashlib
import math
import zlib

from skeinwork.llm import exact, lines, shards

ROWS = [(1, "a b", "s"), (2, "a b", "s"), (3, None, None), (4, "", "s"), (5, "é" * 300 + "x", "t"), (6, "é" * 300 + "y", "t"), (7, "é" * 300 + "x", None), (7, "é" * 300 + "x", "t"), (None, "a b", "s"), (8, "z" * 200_000, "u")]


def test_exact_groups(documents):
    got = [tuple(r) for r in exact.exact_groups(documents(ROWS), with_digest=True, prefix_bytes=16).collect()]
    by = {}
    for i, t, _ in ROWS:
        by.setdefault(t or "", []).append(i)
    want = []
    for i, t, _ in ROWS:
        g = by[t or ""]
        keep = max(x for x in g if x is not None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_without_broadcast_and_empty(documents):
    a = exact.exact_groups(documents(ROWS), broadcast_keys=0).collect()
    b = exact.exact_groups(documents(ROWS)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert exact.exact_groups(documents([])).count() == 0


def _shard(key, tree):
    def draw(shard, weight):
        u = (int(hashlib.md5(f"s{shard}/{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / weight

    rack_draw = lambda shards: min(draw(s, w) for s, w in shards.items())
    region = min(tree, key=lambda r: min(map(rack_draw, tree[r].values())))
    rack = min(tree[region], key=lambda k: rack_draw(tree[region][k]))
    return min(tree[region][rack], key=lambda s: draw(s, tree[region][rack][s]))


def test_shards(documents):
    rows = [(i, "t" * (i % 7), "s") for i in range(400)] + [(3, None, "s"), (None, "x", "s")]
    got = shards.shard_documents(documents(rows)).collect()
    tree, grown = shards.balanced_tree(8), shards.balanced_tree(9)
    assert len(got) == len(rows)
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (_shard(key, tree), _shard(key, grown))
        assert r.grown_shard in (r.shard, 8)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 6} == {(7, zlib.crc32(b"t" * 6))}
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 3} == {(4, zlib.crc32(b"ttt")), (1, 0)}
    assert shards.shard_documents(documents([])).count() == 0


def test_growth_moves_rows_into_the_new_shard_alone(documents):
    docs = documents([(i, "t", "s") for i in range(300)])
    before = None
    for n in range(1, 17):
        got = {r.doc_id: r for r in shards.shard_documents(docs, n).select("doc_id", "shard", "grown_shard").collect()}
        assert all(r.grown_shard in (r.shard, n) and r.shard < n for r in got.values())
        assert before is None or before == {i: r.shard for i, r in got.items()}
        before = {i: r.grown_shard for i, r in got.items()}


def test_weights_decide_shares():
    tree = {"a": {"a0": {0: 1.0, 1: 1.0}, "a1": {2: 1.0}}, "b": {"b0": {3: 1.0}}}
    reached = [_shard(str(i), tree) for i in range(4000)]
    assert all(abs(reached.count(s) / 4000 - 0.25) < 0.03 for s in range(4))
    tree["b"]["b0"][3] = 3.0
    moved = [_shard(str(i), tree) for i in range(4000)]
    assert abs(moved.count(3) / 4000 - 0.5) < 0.03
    assert all(a == b or b == 3 for a, b in zip(reached, moved))


def test_lines_without_broadcast(documents, monkeypatch):
    rows = [(i, f"head {i}\n  menu \nbody", "s" if i % 3 else "t") for i in range(60)]
    want = sorted(map(str, lines.drop_boilerplate(documents(rows), ratio=0.5).collect()))
    monkeypatch.setattr(lines, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(lines, "BROADCAST_DROPS", 0)
    assert sorted(map(str, lines.drop_boilerplate(documents(rows), ratio=0.5).collect())) == want


def test_lines(documents):
    rows = [(i, f"head {i}\n  menu \n\nbody {i}\nmenu", "s") for i in range(6)] + [(10, "menu", "t"), (11, None, "s"), (12, "", None), (13, "menu\nonly", None), (13, "menu\nonly", None)]
    got = {r.doc_id: r for r in lines.drop_boilerplate(documents(rows), ratio=0.5).collect()}
    assert got[2].text == "head 2\n\nbody 2" and (got[2].n_lines, got[2].n_dropped) == (5, 2)
    assert (got[10].text, got[10].n_dropped) == ("menu", 0)
    assert got[11].text is None and got[11].n_lines == 0
    assert (got[12].text, got[13].text) == ("", "menu\nonly")
    assert lines.drop_boilerplate(documents(rows), ratio=0.5).count() == len(rows)
    odd = lines.drop_boilerplate(documents(rows).selectExpr("*", "1 AS `a.b`", "named_struct('x.y', 1) AS nested"), ratio=0.5)
    assert odd.count() == len(rows) and {"a.b", "nested"} <= set(odd.columns)
    assert lines.drop_boilerplate(documents([])).count() == 0
