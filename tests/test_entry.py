import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["multi_indicator_token", "percentile_pools", "binned_mean_log", "knn", "mst_by_label", "exemplar_scores", "dendrogram_root", "novelty_effects"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df, rel = entry.queries()[name](spark, DIR), con.sql(entry.oracle_sql()[name])
    cols = sorted(rel.columns)
    assert cols == sorted(df.columns)
    norm = lambda rows: sorted([tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows], key=str)
    assert norm(df.select(*[f"`{c}`" for c in cols]).collect()) == norm(rel.select(*[f'"{c}"' for c in cols]).fetchall())


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
