import corpus_pipeline

from skeinwork.llm.neardup import near_duplicates


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").cache()
    kept = corpus_pipeline.drop_near_copies(spark, docs, d)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert kept.count() == near_duplicates(docs, 5, 80, 100).where("kept").count()
    lines = corpus_pipeline.drop_lines(spark, docs, d)
    assert lines.count() == docs.count() and lines.columns == corpus_pipeline.COLUMNS
    leaks = corpus_pipeline.drop_leaks(spark, docs, d)
    assert 0 < leaks.count() < docs.count()
    packed = corpus_pipeline.pack(spark, leaks, d)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in leaks.select("doc_id").collect()}


LONG = " ".join(f"word{i}" for i in range(30))


def _edge_rows():
    """Nulls in every column, empty texts, a very long one, repeated ids and rows."""
    item = " ".join(f"leak{i}" for i in range(20))
    return [
        (None, f"x {item} y"), (2, f"x {item} y"), (2, "a clean text of its own with some words"), (3, None), (3, None), (4, ""), (None, None), (5, LONG), (5, LONG), (5, LONG + " and more"),
        (None, LONG), (6, "w " * 60_000 + "end"), (7, "menu\nbody"), (8, "solo"),
    ], item


def _tables(spark, path, rows, item, labels):
    d = f"file://{path}"
    docs = spark.createDataFrame([(i, t, None, "s" if t else None, None if t is None else len(t), "k", "n") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, _row string")
    spark.createDataFrame([(1, item), (2, None), (None, "")] if item else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return docs, d


def test_stages_on_edge_cases(spark, tmp_path):
    rows, item = _edge_rows()
    docs, d = _tables(spark, tmp_path, rows, item, [(2, 1, 0), (3, None, None), (None, 1, 1)])
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, d)
        assert got.columns == corpus_pipeline.COLUMNS, name
        out[name] = texts(got)
    assert out["toxicity"] == sorted(rows, key=str) and len(out["line_dedup"]) == len(rows)
    assert out["decontamination"] == sorted((r for r in rows if not (r[1] and "leak" in r[1])), key=str)
    one = [r for r in out["near_dedup"] if r[1] and r[1].startswith(LONG)]
    assert len(one) == 1 and one[0][0] == 5
    assert [r for r in out["near_dedup"] if not r[1]] == sorted((r for r in rows if not r[1]), key=str)
    assert sum(bool(r[1]) and "leak" in r[1] for r in out["near_dedup"]) == 1
    packed = corpus_pipeline.pack(spark, docs, d).collect()
    assert sum(r.start == 0 for r in packed) == len(rows)


def test_stages_on_empty_tables(spark, tmp_path):
    docs, d = _tables(spark, tmp_path, [], "", [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_run_against_brute_force(spark):
    import duckdb
    import numpy as np
    import tokenizers
    from brute import components, leaks, toxicity

    from skeinwork.llm import toxicity as X
    from skeinwork.llm.lines import OP10_SQL
    from skeinwork.llm.tokens import tokenizer_path

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    docs = con.sql(f"select doc_id, text, source from '{d}/documents.parquet'").fetchall()
    labels = dict(con.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall())
    score = toxicity([(i, t) for i, t, _ in docs], labels, X.DISCOUNT, X.PAIR_DISCOUNT, X.TOP, 1 << X.BITS)
    assert all(abs(s - 0.5) > 1e-3 for s in score.values())
    toxic = {i for i, s in score.items() if s >= 0.5}
    left = [r for r in docs if r[0] not in toxic]
    con.sql("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", left)
    lines = con.sql(f"select doc_id, text from ({OP10_SQL}) order by 1").fetchall()
    first = [(i, t) for (i, t), c in zip(lines, components(lines, 5, 80, 100)) if c[2] == i]
    bench = con.sql(f"select item_id, text from '{d}/benchmark.parquet'").fetchall()
    hit = {i: h for i, _, h, _ in leaks(first, bench)}
    want = {i: t for i, t in first if not hit[i]}
    pieces = {}
    for r in corpus_pipeline.run(spark, d).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert set(pieces) == set(want)
    model = tokenizers.Tokenizer.from_file(tokenizer_path())
    for i, t in want.items():
        assert b"".join(x for _, x in sorted(pieces[i])) == np.array([*model.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
