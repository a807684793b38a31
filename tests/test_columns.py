import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.functions import columns as C
from skeinwork.sources import images, tables


def one(spark, col, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(col.alias("x")).first().x


def test_sentinels_and_groups(spark):
    assert [one(spark, C.int_or_sentinel(F.lit(v))) for v in ("12", " 7 ", "x", "", "-3")] == [12, 7, -1, -1, -3]
    assert one(spark, C.path_id(F.lit("http://h/a/b9_normal_face.png"))) == "b9"
    assert one(spark, C.path_id(F.lit("nothing"))) is None
    assert [one(spark, C.limited_count(F.lit(v))) for v in ("17 / 100", "- / 100", "17")] == [17, -1, -1]
    assert [one(spark, c) for c in C.file_name_parts(F.lit("US_ab1_face.png"))] == ["US", "ab1"]


def test_multi_values(spark):
    df = spark.createDataFrame([(1, "Action|Role"), (2, "Role-Playing"), (3, ""), (4, None)], "id long, g string")
    assert C.categories(df, "g") == ["", "Action", "Role", "Role-Playing"]
    tok = [r["g(Role)"] for r in C.indicators(df, "g", ["Role"]).orderBy("id").collect()]
    sub = [r["g(Role)"] for r in C.indicators(df, "g", ["Role"], substring=True).orderBy("id").collect()]
    assert tok == [True, False, False, False] and sub == [True, True, False, False]


@pytest.mark.parametrize(("n", "text"), [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (13, "13th"), (21, "21st"), (111, "111st")])
def test_ordinal(spark, n, text):
    assert one(spark, C.ordinal(F.lit(n))) == text


def test_labels(spark):
    assert one(spark, C.superscript(F.lit("x10-3"))) == "x¹⁰⁻³"
    assert [one(spark, C.tick_label(F.lit(v))) for v in (2.0, 0.5, 0.25, 0.125, 1 / 3)] == ["2", "0.5", "0.25", "0.125", "0.333"]
    assert C.log_ticks(5)[-1] == (math.log(4.5), "4")


def test_colours_return(spark):
    rng = np.random.default_rng(3)
    for r, g, b in [*rng.random((5, 3)), (0.0, 0.0, 0.0), (0.5, 0.5, 0.5), (1.0, 0.0, 0.0)]:
        hsv = C.rgb_to_hsv(F.lit(float(r)), F.lit(float(g)), F.lit(float(b)))
        back = one(spark, C.hsv_to_rgb(hsv["h"], hsv["s"], hsv["v"]))
        assert np.allclose([back.r, back.g, back.b], [r, g, b])


def test_repair(spark):
    rows = [("f", 0, "a\tb\tc"), ("f", 1, "d\te1"), ("f", 2, "e2\tf"), ("f", 3, "g\th\ti"), ("g", 0, "1\t2\t3")]
    got = tables.repair_records(spark.createDataFrame(rows, "file string, pos int, line string"), ["x", "y", "z"]).collect()
    assert sorted(map(tuple, got)) == [("1", "2", "3"), ("a", "b", "c"), ("d", "e1\ne2", "f"), ("g", "h", "i")]


def test_repair_goes_on_after_a_record_of_too_many_fields(spark, tmp_path):
    rows = [("f", 0, "a\tb\tc\td"), ("f", 1, "1\t2\t3"), ("f", 2, "4\t5"), ("f", 3, "x\t6\ty"), ("f", 4, "7\t8\t9"), ("f", 5, "left\tover"), ("g", 0, "10\t11\t12")]
    got = tables.repair_records(spark.createDataFrame(rows, "file string, pos int, line string"), ["x", "y", "z"]).collect()
    assert sorted(map(tuple, got)) == [("1", "2", "3"), ("10", "11", "12"), ("7", "8", "9")]
    (tmp_path / "many.tsv").write_text("".join(f"a{i}\tb\nb{i}\tc\n" for i in range(3000)))
    got = tables.read_broken_tsv(spark, f"file://{tmp_path}/many.tsv", ["x", "y", "z"]).collect()
    assert [tuple(r) for r in got] == [(f"a{i}", f"b\nb{i}", "c") for i in range(3000)]


def test_ratings_of_items(spark):
    items = spark.createDataFrame([(1, "a", 5.0), (2, "b", 6.0)], "id long, name string, mean double")
    ratings = spark.createDataFrame([(1, 2.5), (3, 1.0)], "item long, mean double")
    assert [tuple(r) for r in tables.with_ratings(items, ratings, "id", "item").collect()] == [(1, "a", 5.0, 2.5)]
    assert tables.with_ratings(items, ratings, "id", "item", "left").count() == 2


def test_csv_sources(spark, tmp_path):
    path = f"file://{tmp_path}/items"
    df = spark.createDataFrame([(1, "a,b", -1)], "id long, name string, friends long")
    tables.write_once(df, path)
    assert tables.read_items(spark, path, df.schema).collect() == df.collect()
    with pytest.raises(Exception, match="exist"):
        tables.write_once(df, path)
    (tmp_path / "bad.csv").write_text("id,name,friends\n1,a,x\n")
    with pytest.raises(Exception):
        tables.read_strict(spark, f"file://{tmp_path}/bad.csv", df.schema).collect()


def test_profiles(spark, tmp_path):
    fields = ["u", "http://x/q7_normal_face.png", "US", "n", "m", "5 / 100", "1", "2", "x", "4", "msg", "USA", "b", "Expert", "p", "Action|Music", "g"]
    broken = "\t".join(fields).replace("msg", "two\nlines")
    (tmp_path / "raw.tsv").write_text(broken + "\n" + "\t".join(fields) + "\n")
    got = tables.clean_profiles(tables.read_broken_tsv(spark, f"file://{tmp_path}/raw.tsv")).collect()
    assert [tuple(r) for r in got] == [("q7", "US", 5, 1, 2, -1, 4, "Expert", "Action|Music")] * 2


def test_images(spark, tmp_path):
    img = np.arange(4 * 6 * 3).reshape(4, 6, 3) / 255
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "US_a1_x.ppm").write_bytes(images.encode_ppm(img))
    found = images.scan_images(spark, f"file://{tmp_path}")
    assert [(r.country, r.id) for r in found.collect()] == [("US", "a1")]
    vec = images.decoded(found, 4, 6).first().vec
    assert np.allclose(vec, img.ravel())
    assert images.with_images(spark.createDataFrame([("a1",), ("b2",)], "id string"), found).count() == 1
    assert [len(r.rows) for r in images.batches(spark.createDataFrame([([1.0],)] * 5, "v array<double>").coalesce(1), "v", 2).collect()] == [2, 2, 1]


def test_cache(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for use in (True, True, False):
        assert tables.cached(spark, f"file://{tmp_path}/c", "n", "v1", build, use).count() == 3
    assert len(made) == 2
