"""Queries over the test tables, by name, with SQL that gives the same rows where SQL can.

Items are customers with their nation, order count and spending; ratings are line items of a part;
multi-value fields are the words of part names and the event types of a user; features are embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import columns as C
from skeinwork.functions.vectors import euclidean
from skeinwork.operators import aggregates as A
from skeinwork.operators import clusters as K
from skeinwork.operators import filters as S
from skeinwork.operators import graph as G
from skeinwork.operators import inference as I
from skeinwork.operators import layout as W
from skeinwork.operators import learn as L
from skeinwork.operators import neighbours as N
from skeinwork.operators import ranking as R
from skeinwork.params import Exemplars
from skeinwork.plans.novelty import novelty_associations, scored
from skeinwork.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(*names: str) -> list:
    return [F.round(F.col(f"`{n}`"), 6).alias(n) for n in names]


def items(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    out = table(spark, d, "customer").join(F.broadcast(nation), "c_nationkey").join(orders, "c_custkey", "left")
    return out.select(
        F.col("c_custkey").alias("id"), "country", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
        F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"), (F.col("c_acctbal") < 0).alias("private"),
    )


ITEMS = """WITH items AS (SELECT c_custkey AS id, n_name AS country, c_mktsegment AS segment, c_acctbal AS balance,
coalesce(orders, 0) AS orders, coalesce(spent, 0.0) AS spent, c_acctbal < 0 AS private FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey) """


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


POINTS = "WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings) "


# --- columns ---------------------------------------------------------------------------------------


@query("clean_int_sentinel", "SELECT p_partkey, coalesce(try_cast(split_part(p_name, ' ', 2) AS BIGINT), -1) AS n, coalesce(try_cast(p_size::VARCHAR AS BIGINT), -1) AS size_n FROM part")
def clean_int_sentinel(spark, d):
    x = table(spark, d, "part")
    return x.select("p_partkey", C.int_or_sentinel(F.get(F.split("p_name", " "), 1)).alias("n"), C.int_or_sentinel(F.col("p_size").cast("string")).alias("size_n"))


@query("regex_id", "SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)/', 1), '') AS host, nullif(regexp_extract(url, '^.*/([0-9]+)', 1), '') AS number FROM pages")
def regex_id(spark, d):
    x = table(spark, d, "pages")
    return x.select("page_id", C.first_group(F.col("url"), "https?://([^/]+)/").alias("host"), C.first_group(F.col("url"), ".*/([0-9]+)").alias("number"))


EVENTS = "WITH u AS (SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds FROM events GROUP BY user_id), c AS (SELECT DISTINCT event_type AS v FROM events) "


def user_kinds(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("kinds"))


@query("multi_indicator_token", EVENTS + "SELECT user_id, v AS category, list_contains(string_split(kinds, '|'), v) AS has FROM u, c")
def multi_indicator_token(spark, d):
    u = user_kinds(spark, d)
    cats = C.categories(u, "kinds")
    wide = C.indicators(u, "kinds", cats)
    return wide.unpivot("user_id", [f"`kinds({c})`" for c in cats], "category", "has").select("user_id", F.regexp_extract("category", r"\((.*)\)", 1).alias("category"), "has")


@query("multi_indicator_substring", "SELECT p_partkey, contains(p_name, 'a') AS \"p_name(a)\", contains(p_name, 'ed') AS \"p_name(ed)\", p_name = '' AS \"p_name()\" FROM part")
def multi_indicator_substring(spark, d):
    return C.indicators(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["a", "ed", ""], substring=True).drop("p_name")


@query("dict_encode", ITEMS + "SELECT id, segment, dense_rank() OVER (ORDER BY segment) - 1 AS segment_code FROM items")
def dict_encode(spark, d):
    return C.encode(items(spark, d).select("id", "segment"), "segment")


@query("dict_encode_first_seen", ITEMS + ", f AS (SELECT segment, row_number() OVER (ORDER BY min(id), segment) - 1 AS segment_code FROM items GROUP BY segment) SELECT id, segment, segment_code FROM items JOIN f USING (segment)")
def dict_encode_first_seen(spark, d):
    return C.encode(items(spark, d).select("id", "segment"), "segment", "id")


@query("one_hot", ITEMS + "SELECT id, CASE WHEN segment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b, CASE WHEN segment = 'MACHINERY' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM items")
def one_hot(spark, d):
    x = C.one_hot(items(spark, d), "segment", ["BUILDING", "MACHINERY"])
    return x.select("id", F.get("segment_onehot", 0).alias("b"), F.get("segment_onehot", 1).alias("m"))


@query("minmax", ITEMS + "SELECT id, round((balance - min(balance) OVER ()) / nullif(max(balance) OVER () - min(balance) OVER (), 0), 6) AS balance_norm FROM items")
def minmax(spark, d):
    return C.min_max(items(spark, d).select("id", "balance"), "balance").select("id", *r6("balance_norm"))


@query("maxnorm", ITEMS + "SELECT id, round(spent / nullif(max(spent) OVER (), 0), 6) AS \"spent-norm\" FROM items")
def maxnorm(spark, d):
    return C.max_share(items(spark, d).select("id", "spent"), "spent").select("id", *r6("spent-norm"))


@query("log_half", ITEMS + "SELECT id, CASE WHEN balance > -0.5 THEN round(ln(balance + 0.5), 6) END AS log_balance, round(ln(orders + 0.5), 6) AS log_orders FROM items")
def log_half(spark, d):
    return items(spark, d).select("id", F.round(C.log_half(F.col("balance")), 6).alias("log_balance"), F.round(C.log_half(F.col("orders")), 6).alias("log_orders"))


@query("log1p", ITEMS + "SELECT id, CASE WHEN balance > -1 THEN round(ln(balance + 1), 6) END AS \"log-balance\" FROM items")
def log1p(spark, d):
    return items(spark, d).select("id", F.round(C.log_one(F.col("balance")), 6).alias("log-balance"))


@query("binarize_auto", ITEMS + "SELECT id, " + ", ".join(f"segment = '{v}' AS \"segment({v})\"" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM items")
def binarize_auto(spark, d):
    return C.binarize(items(spark, d).select("id", "segment"), "segment").drop("segment")


@query("vector_components", POINTS + "SELECT id, round(vec[1], 6) AS \"feature(0)\", round(vec[2], 6) AS \"feature(1)\", round(vec[64], 6) AS \"feature(63)\" FROM p")
def vector_components(spark, d):
    x = C.components(points(spark, d).select("id", F.col("vec").cast("array<double>").alias("vec")), "vec", 64)
    return x.select("id", *r6("feature(0)", "feature(1)", "feature(63)"))


@query("ordinals", "SELECT p_size, p_size::VARCHAR || CASE WHEN p_size % 100 BETWEEN 11 AND 19 AND p_size < 100 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal, count(*) AS n FROM part GROUP BY ALL")
def ordinals(spark, d):
    return table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n")).select("p_size", C.ordinal(F.col("p_size")).alias("ordinal"), "n")


@query("scale_rank", "SELECT o_orderkey, nullif(list_position(['NONE', '5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) - 1, -1) AS rank FROM orders")
def scale_rank(spark, d):
    scale = ["NONE", "5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    return table(spark, d, "orders").select("o_orderkey", C.scale_rank(F.col("o_orderpriority"), scale).alias("rank"))


@query("mean_deviation", "WITH e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM e GROUP BY i) SELECT id, round(sum(abs(x - m)), 4) AS deviation FROM e JOIN m USING (i) GROUP BY id")
def mean_deviation(spark, d):
    x = C.deviations(points(spark, d), "vec")
    return x.select("id", F.round(F.aggregate("vec_deviation", F.lit(0.0), lambda s, v: s + F.abs(v)), 4).alias("deviation"))


# --- filters ---------------------------------------------------------------------------------------


@query("filter_or_not", ITEMS + "SELECT id FROM items WHERE NOT private AND (country = 'FRANCE' OR country = 'GERMANY' OR country LIKE '%1%')")
def filter_or_not(spark, d):
    x = items(spark, d).select("id", "private", (F.col("country") == "FRANCE").alias("fr"), (F.col("country") == "GERMANY").alias("de"), F.col("country").contains("1").alias("one"))
    return x.where(S.condition(["!private", "fr|de|one"])).select("id")


@query("hash_subset")
def hash_subset(spark, d):
    return S.subset(items(spark, d), "id", 100)


@query("top_bottom_k", "(SELECT event_id, value, 'least' AS pool FROM events ORDER BY value, event_id LIMIT 20) UNION ALL (SELECT event_id, value, 'greatest' AS pool FROM events ORDER BY value DESC, event_id LIMIT 20)")
def top_bottom_k(spark, d):
    return S.extremes(table(spark, d, "events").select("event_id", "value"), "value", "event_id", 20)


POOLS = ", q AS (SELECT quantile_cont(spent, [0.1, 0.3, 0.4, 0.6, 0.7, 0.9]) AS q FROM items), w AS (SELECT items.*, CASE WHEN spent < q[1] THEN 0 WHEN spent > q[2] AND spent < q[3] THEN 1 WHEN spent > q[4] AND spent < q[5] THEN 2 WHEN spent > q[6] THEN 3 END AS pool FROM items, q) "


@query("percentile_pools", ITEMS + POOLS + "SELECT pool, count(*) AS n, sum(private::INT)::BIGINT AS private FROM w WHERE pool IS NOT NULL GROUP BY pool")
def percentile_pools(spark, d):
    return S.pool_counts(S.percentile_pools(items(spark, d), "spent"), ["private"])


@query("per_group_sample")
def per_group_sample(spark, d):
    return S.per_group_sample(items(spark, d), "segment", "id", 10, 20).select("segment", "id")


VARIETY = "WITH e AS (SELECT unnest(embedding) AS v, unnest(range(64))::INT AS feature FROM embeddings), c AS (SELECT feature, v, count(*) AS c FROM e GROUP BY ALL) "


@query("feature_variety", VARIETY + "SELECT feature, count(*) AS \"distinct\", max(c) AS modal, sum(c)::BIGINT AS n, round(min(v)::DOUBLE, 6) AS lo, round(max(v)::DOUBLE, 6) AS hi FROM c GROUP BY feature HAVING count(*) > 1 AND max(c) <= sum(c) * 0.975")
def feature_variety(spark, d):
    x = S.varied_features(points(spark, d), "vec")
    return x.select("feature", "distinct", "modal", "n", *r6("lo", "hi"))


# --- aggregates ------------------------------------------------------------------------------------


@query("percent_agreement", "WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY ALL) SELECT l_partkey, sum(c)::BIGINT AS n, round(sum(c * (c - 1) / 2) / nullif(sum(c) * (sum(c) - 1) / 2, 0), 6) AS agreement FROM c GROUP BY l_partkey")
def percent_agreement(spark, d):
    return A.percent_agreement(table(spark, d, "lineitem"), "l_partkey", "l_returnflag").select("l_partkey", "n", *r6("agreement"))


RANKS = "WITH r AS (SELECT l_partkey, (floor(l_quantity / 7.0)::INT % 8) AS rank FROM lineitem) "


def part_ranks(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", (F.floor(F.col("l_quantity") / 7.0).cast("int") % 8).alias("rank"))


@query("ordinal_rating_summary", RANKS + "SELECT l_partkey, count(*) AS n, round(quantile_cont(CASE WHEN rank > 0 THEN rank END, 0.5), 6) AS median, round(avg(CASE WHEN rank > 0 THEN rank END), 6) AS mean, round(avg((rank = 4)::INT), 6) AS neutral, sum(CASE WHEN rank > 0 THEN abs(rank - 4) ELSE 0 END)::DOUBLE AS intensity FROM r GROUP BY l_partkey")
def ordinal_rating_summary(spark, d):
    return A.ordinal_summary(part_ranks(spark, d), ["l_partkey"], "rank").select("l_partkey", "n", *r6("median", "mean", "neutral"), "intensity")


SCALES = "WITH r AS (SELECT l_partkey, l_returnflag AS scale, (floor(l_quantity / 7.0)::INT % 8) AS rank FROM lineitem), c AS (SELECT l_partkey, scale, rank, count(*) AS k FROM r GROUP BY ALL), s AS (SELECT l_partkey, scale, sum(k) AS n, sum(k * (k - 1) / 2) AS same, sum(CASE WHEN rank > 0 THEN k * abs(rank - 4) ELSE 0 END) AS intensity, sum(CASE WHEN rank = 4 THEN k ELSE 0 END) / sum(k) AS neutral, " + ", ".join(f"coalesce(sum(k) FILTER (rank = {i}), 0)::BIGINT AS r{i}" for i in range(8)) + " FROM c GROUP BY l_partkey, scale) "


def part_scales(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("scale"), (F.floor(F.col("l_quantity") / 7.0).cast("int") % 8).alias("rank"))


@query("rank_distribution", SCALES + "SELECT l_partkey, scale, " + ", ".join(f"r{i}" for i in range(8)) + ", CASE WHEN n > 1 THEN round(same / (n * (n - 1) / 2), 6) END AS agreement FROM s")
def rank_distribution(spark, d):
    c = A.rank_distribution(part_scales(spark, d), ["l_partkey", "scale"], "rank", 7)
    return c.select("l_partkey", "scale", *[F.col("distribution")[i].alias(f"r{i}") for i in range(8)], *r6("agreement"))


@query("expression_summary", SCALES + "SELECT l_partkey, round(sum(1 - neutral) / 3, 6) AS simple, round(sum(intensity) / 3, 6)::DOUBLE AS intensity, CASE WHEN min(n) > 1 THEN round(sum(same / (n * (n - 1) / 2)) / 3, 6) END AS agreement FROM s GROUP BY l_partkey")
def expression_summary(spark, d):
    return A.expression_summary(part_scales(spark, d), "l_partkey", "scale", "rank", 3).select("l_partkey", *r6("simple", "intensity", "agreement"))


NULLED = "WITH r AS (SELECT l_partkey, CASE WHEN l_quantity <= 30 THEN (l_quantity::INT % 5) + 1 END AS v FROM lineitem), s AS (SELECT l_partkey, count(*) AS n, count(*) - count(v) AS missing, quantile_cont(v, 0.5) AS median, avg(v) AS mean, sum(CASE WHEN v = 3 THEN 1.0 ELSE 0.0 END) / count(*) AS neutral, sum(abs(v - 3)) AS intensity FROM r GROUP BY 1) "


@query("null_rating_summary", NULLED + "SELECT l_partkey, n, missing, CASE WHEN missing * 2 <= n THEN round(median, 6) END AS median, CASE WHEN missing * 2 <= n THEN round(mean, 6) END AS mean, round(neutral, 6)::DOUBLE AS neutral, CASE WHEN missing * 2 <= n THEN intensity::DOUBLE END AS intensity FROM s")
def null_rating_summary(spark, d):
    x = table(spark, d, "lineitem").select("l_partkey", F.when(F.col("l_quantity") <= 30, F.col("l_quantity").cast("int") % 5 + 1).alias("v"))
    return A.null_rating_summary(x, ["l_partkey"], "v").select("l_partkey", "n", "missing", *r6("median", "mean"), F.round(F.col("neutral").cast("double"), 6).alias("neutral"), "intensity")


@query("histogram100", "WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / (hi - lo) * 100), 99)::INT AS bin, count(*) AS n FROM events, s GROUP BY 1")
def histogram100(spark, d):
    return A.histogram(table(spark, d, "events"), "value", 100)


def _bins_sql(bins, value: str, x: str, source: str, digits: int = 6) -> str:
    edges = "[" + ", ".join(f"{b[0]!r}::DOUBLE" for b in bins) + "]"
    rows = ", ".join(f"({i}, {float(b[2])!r}::DOUBLE)" for i, b in enumerate(bins))
    return (
        f"WITH t(bin, centre) AS (VALUES {rows}), x AS (SELECT ({x})::DOUBLE AS x, ({value})::DOUBLE AS v FROM {source}), "
        f"s AS (SELECT (len(list_filter({edges}, lambda e: e <= x)) - 1)::INT AS bin, count(*) AS n, avg(v) AS mean FROM x WHERE x >= {bins[0][0]!r} AND x <= {bins[-1][1]!r} GROUP BY 1) "
        f"SELECT t.bin::INT AS bin, round(centre, 6) AS centre, coalesce(n, 0) AS n, round(mean, {digits}) AS mean, round((SELECT avg(v) FROM x), {digits}) AS overall FROM t LEFT JOIN s USING (bin)"
    )


LINEAR, LOG = A.linear_bins(0.0, 50.0, 50), A.log_bins(60.0)
LEFT_EDGES = [(lo, hi, lo) for lo, hi, _ in A.linear_bins(1.0, 50.0, 49)]


@query("binned_proportion", _bins_sql(LINEAR, "(l_returnflag = 'R')::INT", "l_quantity", "lineitem"))
def binned_proportion(spark, d):
    return A.binned(table(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R", LINEAR).select("bin", *r6("centre"), "n", *r6("mean", "overall"))


@query("binned_mean_log", _bins_sql(LOG, "l_extendedprice", "ln(l_quantity + 0.5)", "lineitem", 4))
def binned_mean_log(spark, d):
    x = table(spark, d, "lineitem").select("l_extendedprice", C.log_half(F.col("l_quantity")).alias("x"))
    return A.binned(x, "x", F.col("l_extendedprice"), LOG).select("bin", *r6("centre"), "n", *[F.round(c, 4).alias(c) for c in ("mean", "overall")])


@query("binned_mean_linear", _bins_sql(LEFT_EDGES, "l_tax", "l_quantity", "lineitem"))
def binned_mean_linear(spark, d):
    return A.binned(table(spark, d, "lineitem"), "l_quantity", F.col("l_tax"), LEFT_EDGES).select("bin", *r6("centre"), "n", *r6("mean", "overall"))


@query("duplicates", "SELECT min(vec_id) AS representative, count(*) AS multiplicity FROM embeddings GROUP BY embedding")
def duplicates(spark, d):
    return A.duplicates(points(spark, d), "id", "vec")


@query("group_quantiles", ITEMS + "SELECT segment, count(*) AS n, round(avg(balance), 6) AS mean, " + ", ".join(f"round(quantile_cont(balance, {q}), 6) AS q{round(q * 100)}" for q in (0.0, 0.25, 0.5, 0.75, 1.0)) + " FROM items GROUP BY segment")
def group_quantiles(spark, d):
    return A.group_quantiles(items(spark, d), "segment", "balance").select("segment", "n", *r6("mean", "q0", "q25", "q50", "q75", "q100"))


@query("confusion", "WITH c AS (SELECT quality = 1 AS truth, n_chars > 1000 AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL) SELECT truth, predicted, n, round(n / sum(n) OVER (PARTITION BY truth), 6) AS share FROM c")
def confusion(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return A.confusion(x, F.col("quality") == 1, F.col("n_chars") > 1000).select("truth", "predicted", "n", *r6("share"))


@query("active_features", "SELECT feature::INT AS feature, bool_or(embedding[feature + 1] <> 0) AS active FROM embeddings, range(64) r(feature) GROUP BY 1")
def active_features(spark, d):
    return A.active_features(points(spark, d), "vec").select(F.col("feature").cast("int").alias("feature"), "active")


@query("monotony", "WITH c AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1) SELECT count(*) AS \"distinct\", round(max(c) / sum(c), 6) AS modal_share FROM c")
def monotony(spark, d):
    return A.monotony(table(spark, d, "events"), "event_type").select("distinct", *r6("modal_share"))


@query("category_share", ITEMS + "SELECT segment, round(avg(private::INT), 6) AS share FROM items GROUP BY segment")
def category_share(spark, d):
    return items(spark, d).groupBy("segment").agg(F.round(A.proportion(F.col("private")), 6).alias("share"))


@query("line_fit", ITEMS + "SELECT round(regr_slope(spent, orders), 4) AS slope, round(regr_intercept(spent, orders), 4) AS intercept FROM items")
def line_fit(spark, d):
    return I.pearson(items(spark, d), F.col("orders"), F.col("spent")).select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


# --- inference -------------------------------------------------------------------------------------


@query("welch", ITEMS + ", s AS (SELECT count(*) FILTER (private) AS n1, count(*) FILTER (NOT private) AS n0, avg(spent) FILTER (private) AS m1, avg(spent) FILTER (NOT private) AS m0, var_samp(spent) FILTER (private) / count(*) FILTER (private) AS a, var_samp(spent) FILTER (NOT private) / count(*) FILTER (NOT private) AS b FROM items) SELECT n1, n0, round(m1 - m0, 4) AS effect, round((m1 - m0) / sqrt(a + b), 6) AS t, round((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)), 4) AS df FROM s")
def welch(spark, d):
    return I.welch(items(spark, d), F.col("private"), F.col("spent")).select("n1", "n0", F.round("effect", 4).alias("effect"), *r6("t"), F.round("df", 4).alias("df"))


@query("pearson", ITEMS + "SELECT count(*) AS n, round(corr(balance, spent), 6) AS r, round(corr(balance, spent) * sqrt((count(*) - 2) / (1 - corr(balance, spent) * corr(balance, spent))), 6) AS t FROM items")
def pearson(spark, d):
    return I.pearson(items(spark, d), F.col("balance"), F.col("spent")).select("n", *r6("r", "t"))


@query("associations")
def associations(spark, d):
    x = C.binarize(items(spark, d), "segment").withColumn("log_orders", C.log_half(F.col("orders")))
    flags = [c for c in x.columns if c.startswith("segment(")]
    return I.holm(I.association_tests(x, [*flags, "private", "balance", "log_orders", "country"], "spent"))


@query("holm", "WITH t AS (SELECT p_partkey AS col, exp(-p_retailprice / 50.0) / (1 + p_partkey % 97) AS p FROM part), r AS (SELECT col, p, row_number() OVER (ORDER BY p, col) AS rank, count(*) OVER () AS m FROM t) SELECT col, rank::INT AS rank, bool_and(p <= 0.05 / (m - rank + 1)) OVER (ORDER BY rank) AS rejected FROM r")
def holm(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("col"), (F.exp(-F.col("p_retailprice") / 50.0) / (1 + F.col("p_partkey") % 97)).alias("p"))
    return I.holm(x).select("col", "rank", "rejected")


@query("sidak", "SELECT r_regionkey, round(1 - power(1 - 0.05, 1.0::DOUBLE / (r_regionkey + 1)), 9) AS alpha FROM region")
def sidak(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.round(I.sidak(0.05, F.col("r_regionkey") + 1), 9).alias("alpha"))


@query("mean_ci", ITEMS + "SELECT segment, count(*) AS n, round(avg(balance), 6) AS mean, round(stddev_pop(balance), 6) AS sd FROM items GROUP BY segment")
def mean_ci(spark, d):
    return I.mean_intervals(items(spark, d), "segment", "balance").select("segment", "n", *r6("mean", "sd"))


@query("mean_ci_bounds")
def mean_ci_bounds(spark, d):
    return I.mean_intervals(items(spark, d), "segment", "balance")


@query("jeffreys_ci")
def jeffreys_ci(spark, d):
    return I.jeffreys_intervals(items(spark, d), "segment", "private")


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    x = table(spark, d, "supplier").withColumn("g", F.col("s_nationkey"))
    return I.bootstrap_intervals(x, "g", "s_acctbal")


@query("fisher_counts", ITEMS + "SELECT segment, count(*) FILTER (private) AS a, count(*) FILTER (NOT private) AS b, (SELECT count(*) FILTER (private) FROM items) AS c, (SELECT count(*) FILTER (NOT private) FROM items) AS d FROM items GROUP BY segment")
def fisher_counts(spark, d):
    return I.fisher_by_group(items(spark, d), "segment", "private").select("segment", "a", "b", "c", "d")


@query("fisher_p")
def fisher_p(spark, d):
    return I.fisher_by_group(items(spark, d), "segment", "private")


CHI = ", s AS (SELECT segment AS g, count(*) AS gn FROM items GROUP BY 1), o AS (SELECT country, count(*) AS all_n FROM items GROUP BY 1), k AS (SELECT segment AS g, country, count(*) AS k FROM items GROUP BY 1, 2), c AS (SELECT s.g, o.country, coalesce(k, 0) + 1.0::DOUBLE / gn AS o1, all_n::DOUBLE AS o2 FROM s CROSS JOIN o LEFT JOIN k ON k.g = s.g AND k.country = o.country), e AS (SELECT *, sum(o1) OVER (PARTITION BY g) AS s1, sum(o2) OVER (PARTITION BY g) AS s2, count(*) OVER (PARTITION BY g) - 1 AS df FROM c), x AS (SELECT g, df, o1, o2, s1 * (o1 + o2) / (s1 + s2) AS e1, s2 * (o1 + o2) / (s1 + s2) AS e2 FROM e) SELECT g AS segment, df, round(sum((o1 - e1) * (o1 - e1) / e1 + (o2 - e2) * (o2 - e2) / e2), 6) AS chi2 FROM x GROUP BY g, df"


@query("chi2_smoothed", ITEMS + CHI)
def chi2_smoothed(spark, d):
    return I.chi2_by_group(items(spark, d), "segment", "country").select("segment", "df", *r6("chi2"))


@query("cluster_report")
def cluster_report(spark, d):
    return I.cluster_report(items(spark, d), "country", "spent")


@query("cluster_significance")
def cluster_significance(spark, d):
    return I.cluster_significance(items(spark, d), "country", ["private", "segment", "spent"])


@query("cluster_outlier_report")
def cluster_outlier_report(spark, d):
    return T.cluster_outlier_report(I.cluster_report(items(spark, d), "orders", "spent"), "orders")


@query("residual_deviation", ITEMS + ", f AS (SELECT regr_slope(spent, orders) AS m, regr_intercept(spent, orders) AS b FROM items) SELECT id, round(spent - (m * orders + b), 3) AS deviation FROM items, f")
def residual_deviation(spark, d):
    x = I.residual_deviation(items(spark, d), "spent", "orders")
    return x.select("id", F.round("spent_orders_deviation", 3).alias("deviation"))


# --- vectors and graphs ----------------------------------------------------------------------------


@query("pairwise_distance", POINTS + "SELECT a.label, a.id AS i, b.id AS j, round(list_distance(a.vec, b.vec), 6) AS d FROM p a JOIN p b ON a.label = b.label AND a.id < b.id")
def pairwise_distance(spark, d):
    return N.pairwise(points(spark, d), "label").select("label", "i", "j", *r6("d"))


KNN = POINTS + ", n AS (SELECT a.id AS i, b.id AS j, list_distance(a.vec, b.vec) AS d FROM p a JOIN p b ON a.id <> b.id), k AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank, j, d FROM n QUALIFY rank <= 10) "


@query("knn", KNN + "SELECT i, rank::INT AS rank, j, round(d, 6) AS d FROM k")
def knn(spark, d):
    return N.nearest(points(spark, d), 10).select("i", "rank", "j", *r6("d"))


@query("knn_edges", KNN + "SELECT least(i, j) AS fr, greatest(i, j) AS \"to\", round(min(d), 6) AS d FROM k GROUP BY 1, 2")
def knn_edges(spark, d):
    return N.neighbour_edges(N.nearest(points(spark, d), 10)).select("fr", "to", *r6("d"))


@query("neighbor_ratio", KNN + ", r AS (SELECT i, rank, d, lead(d) OVER (PARTITION BY i ORDER BY rank) AS n FROM k) SELECT i, rank::INT AS rank, round(n / nullif(d, 0), 6) AS ratio FROM r WHERE n IS NOT NULL")
def neighbor_ratio(spark, d):
    return N.neighbour_ratios(N.nearest(points(spark, d), 10)).select("i", "rank", *r6("ratio"))


@query("clones_by_rank", KNN + "SELECT rank::INT AS rank, count(*) FILTER (d = 0) AS clones, round(avg(d), 6) AS mean_d FROM k GROUP BY rank")
def clones_by_rank(spark, d):
    return N.clones_by_rank(N.nearest(points(spark, d), 10)).select("rank", "clones", *r6("mean_d"))


SCALE = ", z AS (SELECT i, d FROM k WHERE rank <= 9 UNION ALL SELECT id, 0.0 FROM p), s AS (SELECT i AS id, quantile_cont(d, 0.5) AS s FROM z GROUP BY i) "


@query("normalized_distance", KNN + SCALE + "SELECT k.i, k.j, round(k.d / nullif((a.s + b.s) / 2, 0), 6) AS d FROM k JOIN s a ON a.id = k.i JOIN s b ON b.id = k.j")
def normalized_distance(spark, d):
    p = points(spark, d)
    near = G.checkpointed(N.nearest(p, 10))
    return N.normalized(near, N.local_scale_of(near, p, 10)).select("i", "j", *r6("d"))


@query("cosine_distance", POINTS + "SELECT a.label, a.id AS i, b.id AS j, round(list_cosine_distance(a.vec, b.vec), 6) AS d FROM p a JOIN p b ON a.label = b.label AND a.id < b.id")
def cosine_distance(spark, d):
    return N.pairwise(points(spark, d), "label", "cosine").select("label", "i", "j", *r6("d"))


CHAIN = """WITH RECURSIVE p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings),
e AS (SELECT a.label, a.id AS i, b.id AS j, list_distance(a.vec, b.vec) AS d FROM p a JOIN p b ON a.label = b.label AND a.id <> b.id),
c0 AS (SELECT label, i, j, d AS c FROM e),
""" + ",\n".join(f"c{k + 1} AS (SELECT label, i, j, min(c) AS c FROM (SELECT * FROM c{k} UNION ALL SELECT a.label, a.i, b.j, greatest(a.c, b.c) FROM c{k} a JOIN c{k} b ON a.label = b.label AND a.j = b.i WHERE a.i <> b.j) GROUP BY ALL)" for k in range(6)) + " "


@query("mst_by_label", CHAIN + "SELECT e.label, e.i AS fr, e.j AS \"to\", round(e.d, 6) AS d FROM e JOIN c6 USING (label, i, j) WHERE e.i < e.j AND e.d = c6.c")
def mst_by_label(spark, d):
    return G.group_trees(points(spark, d), "label").select("label", "fr", "to", *r6("d"))


@query("chain_distance", CHAIN + "SELECT label, i, j, round(c, 6) AS c FROM c6 WHERE i < j")
def chain_distance(spark, d):
    return G.chain_distances(G.group_trees(points(spark, d), "label"), "label").select("label", "i", "j", *r6("c"))


@query("spanning_forest")
def spanning_forest(spark, d):
    return G.minimum_spanning_forest(N.neighbour_edges(N.nearest(points(spark, d), 10)))


@query("modified_forest")
def modified_forest(spark, d):
    return G.modified_forests_of_points(points(spark, d), "label")


@query("simple_representatives")
def simple_representatives(spark, d):
    found = G.simple_representatives(points(spark, d))
    return spark.createDataFrame([(rep, i) for rep, ids in found for i in ids], "rep long, id long")


@query("agglomerative_labels")
def agglomerative_labels(spark, d):
    return G.group_labels(points(spark, d).withColumnRenamed("label", "part"), "part", G.agglomerative)


@query("affinity_labels")
def affinity_labels(spark, d):
    return G.group_labels(points(spark, d).withColumnRenamed("label", "part"), "part", G.affinity_propagation)


FIRST = ", c AS (SELECT id, list_distance(vec, (SELECT vec FROM p WHERE id = 0)) AS c FROM p), s AS (SELECT k.i, k.j, (a.c - b.c) / greatest(1e-9, k.d) AS slope FROM k JOIN c a ON a.id = k.i JOIN c b ON b.id = k.j), t AS (SELECT i, j FROM s WHERE slope > 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY slope DESC, j) = 1), w(id, root) AS (SELECT id, id FROM p UNION ALL SELECT w.id, t.j FROM w JOIN t ON w.root = t.i) SELECT id, root FROM w WHERE root NOT IN (SELECT i FROM t)"


@query("watersheds", KNN.replace("WITH p", "WITH RECURSIVE p") + FIRST)
def watersheds(spark, d):
    p = points(spark, d)
    origin = p.where("id = 0").select(F.col("vec").alias("o"))
    criterion = p.crossJoin(F.broadcast(origin)).select("id", euclidean(F.col("vec"), F.col("o")).alias("c"))
    return G.watersheds(N.nearest(p, 10), criterion)


@query("typicality")
def typicality(spark, d):
    p = points(spark, d)
    return G.typicality(G.checkpointed(N.nearest(p, 15)), p.select("id"))


@query("representatives")
def representatives(spark, d):
    return G.group_representatives(points(spark, d), "label")


@query("dbscan")
def dbscan(spark, d):
    return G.dbscan(points(spark, d))[0]


SCORES = ", cat AS (SELECT id, label FROM p), m AS (SELECT k.*, a.label AS category, (a.label <> b.label)::INT AS alien FROM k JOIN cat a ON a.id = k.i JOIN cat b ON b.id = k.j), f AS (SELECT i, min(rank) AS foil FROM m WHERE alien = 1 GROUP BY i) "


@query("exemplar_scores", KNN + SCORES + "SELECT m.i AS id, m.category, count(*) FILTER (alien = 0 AND (foil IS NULL OR rank < foil)) AS centrality, round(min(d) FILTER (rank = foil), 6) AS separation, min(rank) FILTER (rank = foil)::INT AS foil_rank, min(j) FILTER (rank = foil) AS foil_id FROM m LEFT JOIN f USING (i) GROUP BY m.i, m.category")
def exemplar_scores(spark, d):
    p = points(spark, d)
    s = R.exemplar_scores(N.nearest(p, 10), p.select("id", F.col("label").alias("category")))
    return s.select("id", "category", "centrality", F.round(F.when(F.col("foil_id").isNotNull(), F.col("separation")), 6).alias("separation"), "foil_rank", "foil_id")


@query("exemplars")
def exemplars(spark, d):
    return R.exemplars_of(points(spark, d).withColumnRenamed("label", "category"), Exemplars.neighborhood)


@query("alt_exemplars", KNN + ", s AS (SELECT k.i AS id, a.label AS category, avg((a.label = b.label)::INT) AS purity, quantile_cont(d, 0.5) AS scale FROM k JOIN p a ON a.id = k.i JOIN p b ON b.id = k.j GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY purity DESC, id) AS r0, row_number() OVER (PARTITION BY category ORDER BY scale DESC, id) AS r1 FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY greatest(r0, r1), CASE WHEN r0 >= r1 AND r0 <> r1 THEN 0 WHEN r0 = r1 THEN 0 ELSE 1 END, id) AS place FROM r) SELECT category, place::INT AS place, id, round(purity, 6) AS purity, round(scale, 6) AS scale FROM o WHERE place <= 16")
def alt_exemplars(spark, d):
    p = points(spark, d)
    return R.alternative_exemplars(N.nearest(p, 10), p.select("id", F.col("label").alias("category"))).select("category", "place", "id", *r6("purity", "scale"))


@query("alt_exemplars_apart")
def alt_exemplars_apart(spark, d):
    return R.alternative_exemplars_of(points(spark, d).withColumnRenamed("label", "category"), Exemplars.alt_neighborhood).select("category", "place", "id", *r6("purity", "scale"))


@query("multiobjective_rank", ITEMS + ", r AS (SELECT id, row_number() OVER (ORDER BY balance DESC, id) AS a, row_number() OVER (ORDER BY orders DESC, id) AS b FROM items) SELECT id, row_number() OVER (ORDER BY greatest(a, b), CASE WHEN a >= b THEN 0 ELSE 1 END, id)::INT AS place FROM r")
def multiobjective_rank(spark, d):
    return R.multiobjective_rank(items(spark, d), [F.col("balance").desc(), F.col("orders").desc()], "id").select("id", "place")


# --- clusters --------------------------------------------------------------------------------------


@query("dendrogram_root", CHAIN + ", s AS (SELECT label, sum(c) AS internal, max(c) AS scale FROM c6 WHERE i < j GROUP BY label), n AS (SELECT label, count(*) AS n FROM p GROUP BY label), m AS (SELECT e.label, avg(e.d) AS mean FROM e JOIN c6 USING (label, i, j) WHERE e.i < e.j AND e.d = c6.c GROUP BY e.label) SELECT label, n, round(scale, 6) AS scale, round(mean, 6) AS mean, round(internal, 4) AS internal, round(mean * n * (n - 1) / 2 / internal, 6) AS quality, round(2 * internal / (n * n), 6) AS isolation_mean FROM s JOIN n USING (label) JOIN m USING (label)")
def dendrogram_root(spark, d):
    t = K.multiscale(points(spark, d), "label", lists=False, tops=True)
    return t.select("label", "n", *r6("scale", "mean"), F.round("internal", 4).alias("internal"), *r6("quality", "isolation_mean"))


@query("dendrogram_stats")
def dendrogram_stats(spark, d):
    return K.multiscale(points(spark, d), "label", lists=False)


@query("condensed")
def condensed(spark, d):
    return K.condensed(points(spark, d), "label", lists=False)


@query("separated")
def separated(spark, d):
    return K.separated(points(spark, d), "label", lists=False)


@query("assignments")
def assignments(spark, d):
    return K.smallest_condensed(points(spark, d), "label")


@query("isolation")
def isolation(spark, d):
    p = points(spark, d)
    return K.isolation(p, K.multiscale(p, "label", tops=True), "label")


@query("cluster_overlaps")
def cluster_overlaps(spark, d):
    return K.overlaps(K.multiscale(points(spark, d), "label", lists=False), "label")


@query("lineage")
def lineage(spark, d):
    return K.lineage(K.multiscale(points(spark, d), "label", lists=False), "label")


@query("label_clusters", "SELECT label, count(*) AS n, count(*) - 1 AS size FROM embeddings GROUP BY label")
def label_clusters(spark, d):
    return K.from_labels(points(spark, d), "label")


@query("manifolds")
def manifolds(spark, d):
    return L.manifolds(points(spark, d), "label")


# --- features, novelty, layout ---------------------------------------------------------------------

NOVEL = "WITH e AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM e GROUP BY i), r AS (SELECT id, label, sqrt(avg((x - m) * (x - m))) AS error FROM e JOIN m USING (i) GROUP BY id, label), n AS (SELECT *, (error - min(error) OVER ()) / nullif(max(error) OVER () - min(error) OVER (), 0) AS novelty FROM r) "


@query("novelty", NOVEL + "SELECT id, label, round(error, 6) AS error, round(novelty, 6) AS novelty FROM n")
def novelty(spark, d):
    return scored(points(spark, d)).select("id", "label", *r6("error", "novelty"))


@query("novelty_correlation")
def novelty_correlation(spark, d):
    p = points(spark, d).withColumn("spread", F.aggregate("vec", F.lit(0.0), lambda s, v: s + F.abs(v.cast("double"))))
    return novelty_associations(p, "label", ["spread"])


@query("novelty_effects", NOVEL + ", l AS (SELECT DISTINCT label FROM n) SELECT 'label(' || l.label || ')' AS col, round(avg(novelty) FILTER (n.label = l.label) - avg(novelty) FILTER (n.label <> l.label), 6) AS effect FROM n, l GROUP BY l.label")
def novelty_effects(spark, d):
    return novelty_associations(points(spark, d), "label", []).select("col", *r6("effect"))


@query("pca_novelty")
def pca_novelty(spark, d):
    return scored(points(spark, d), features=8).select("id", *r6("error", "novelty"))


@query("predictor")
def predictor(spark, d):
    p = points(spark, d)
    return A.confusion(L.predict(p, L.fit_predictor(p, "label")), F.col("label"), F.col("predicted"))


@query("montage_grid", "WITH r AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS i, ceil(sqrt(count(*) OVER ()))::BIGINT AS side FROM embeddings) SELECT id, i // side AS row, i % side AS col FROM r")
def montage_grid(spark, d):
    return W.montage_grid(points(spark, d).select("id"), "id")


@query("equal_depth_lineup", "WITH r AS (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) - 1 AS b, count(*) OVER () AS n FROM part) SELECT p_partkey, floor(b * 8 / n)::INT AS bin FROM r")
def equal_depth_lineup(spark, d):
    return W.equal_depth_lineup(table(spark, d, "part"), "p_size", 8).select("p_partkey", "bin")


@query("percentile_edge_lineup", ITEMS + ", q AS (SELECT quantile_cont(spent, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM items) SELECT id, CASE WHEN spent < q[5] THEN (len(list_filter(q, lambda e: e <= spent)) - 1)::INT END AS bin FROM items, q")
def percentile_edge_lineup(spark, d):
    return W.percentile_edge_lineup(items(spark, d), "spent", 5).select("id", "bin")


@query("lineup_samples")
def lineup_samples(spark, d):
    return W.lineup_samples(W.equal_depth_lineup(table(spark, d, "part"), "p_size", 8), "bin", "p_partkey", 4)


@query("moving_average", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS smooth FROM events")
def moving_average(spark, d):
    return W.moving_average(table(spark, d, "events").select("user_id", "event_id", "value"), "value", "event_id", 3, "user_id").select("event_id", *r6("smooth"))


def _convolved_sql(kernel: tuple[float, ...]) -> str:
    half = len(kernel) // 2
    taps = [f"coalesce({f'lag(value, {k - half})' if k >= half else f'lead(value, {half - k})'} OVER w, 0) * {x!r}" for k, x in enumerate(kernel) if x]
    return f"SELECT event_id, round(({' + '.join(taps)}) / {sum(kernel)!r}, 6) AS smooth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


def _convolved(spark, d, kernel):
    return W.convolved(table(spark, d, "events").select("user_id", "event_id", "value"), "value", "event_id", kernel, "user_id").select("event_id", *r6("smooth"))


@query("wide_average", _convolved_sql(W.WIDE_KERNEL))
def wide_average(spark, d):
    return _convolved(spark, d, W.WIDE_KERNEL)


@query("trailing_average", _convolved_sql(W.TRAILING_KERNEL))
def trailing_average(spark, d):
    return _convolved(spark, d, W.TRAILING_KERNEL)


@query("bin_means", "WITH e AS (SELECT label, unnest(range(64))::INT AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, feature, count(*) AS n, round(avg(x), 6) AS mean FROM e GROUP BY label, feature")
def bin_means(spark, d):
    m = W.bin_means(points(spark, d), "label", "vec").select(F.col("bin").alias("label"), "n", F.posexplode("mean").alias("feature", "mean"))
    return m.select("label", "feature", "n", *r6("mean"))


@query("weighted_union", "SELECT kind, count(*) AS n FROM (SELECT 'common' AS kind FROM supplier, range(20) UNION ALL SELECT 'rare' FROM nation, range(3)) GROUP BY kind")
def weighted_union(spark, d):
    common, rare = table(spark, d, "supplier").select(F.lit("common").alias("kind")), table(spark, d, "nation").select(F.lit("rare").alias("kind"))
    return T.weighted_union([(common, 20), (rare, 3)]).groupBy("kind").agg(F.count("*").alias("n"))


@query("file_sample")
def file_sample(spark, d):
    return T.sample_files(table(spark, d, "pages").select("page_id", "url"), 0.2, path="url")


def entry(spark: SparkSession) -> DataFrame:
    return novelty_correlation(spark, "/root/testdata/sf0.001")
