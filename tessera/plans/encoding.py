"""Loading, encoding, imputing, projection and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import encode as E
from tessera.operators import tables as T
from tessera.plans.base import query, rounded, table

_HOLES = """holes AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 13 = 0 THEN 'Infinity'::DOUBLE ELSE o_totalprice END AS x,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE ' ' || o_orderpriority END AS c, o_orderkey % 10 < 7 AS train, o_orderstatus AS y FROM orders)"""


def _holes(spark, d):
    k = F.col("o_orderkey")
    x = F.when(k % 7 == 0, None).when(k % 11 == 0, float("nan")).when(k % 13 == 0, float("inf")).otherwise(F.col("o_totalprice"))
    c = F.when(k % 5 == 0, None).otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))
    return table(spark, d, "orders").select(k.alias("row_id"), x.alias("x"), c.alias("c"), (k % 10 < 7).alias("train"), F.col("o_orderstatus").alias("y"))


_FINITE = "CASE WHEN isfinite(x) THEN x END"


@query("enc1_target_to_int", """SELECT t, count(*) AS n, (CASE WHEN t IN ('yes', 'TRUE') THEN 1 WHEN t IN ('no', '0') THEN 0 WHEN t = '2.6' THEN 3 END)::BIGINT AS y FROM
 (SELECT CASE event_id % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'no' WHEN 3 THEN '0' WHEN 4 THEN '2.6' ELSE 'maybe' END AS t FROM events) GROUP BY t""")
def _(spark, d):
    words = F.array(*map(F.lit, ["yes", "TRUE", "no", "0", "2.6", "maybe"]))
    t = table(spark, d, "events").select(F.element_at(words, (F.col("event_id") % 6 + 1).cast("int")).alias("t"))
    return rounded(t.groupBy("t").agg(F.count("*").alias("n")).withColumn("y", E.target_to_int("t")))


@query("enc2_label_encode", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::BIGINT AS code FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("code"))
    return rounded(E.apply_mapping(o, E.mapping(o, "code", None), "code", missing=None))


_MAP = """m AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT coalesce(trim(c), '__missing__') AS value FROM holes {where}))"""


@query("enc3_category_codes", f"WITH {_HOLES}, {_MAP.format(where='')} SELECT row_id, m.code::BIGINT AS c FROM holes JOIN m ON m.value = coalesce(trim(c), '__missing__')")
def _(spark, d):
    h = _holes(spark, d).select("row_id", "c")
    return rounded(E.encode(h, h, ["c"]))


@query("enc5_codes_fit_on_train", f"WITH {_HOLES}, {_MAP.format(where='WHERE train AND row_id % 3 <> 0')} SELECT row_id, coalesce(m.code, -1)::BIGINT AS c FROM holes LEFT JOIN m ON m.value = coalesce(trim(c), '__missing__')")
def _(spark, d):
    h = _holes(spark, d).select("row_id", "c", "train")
    return rounded(E.encode(h.where("train and row_id % 3 <> 0"), h.select("row_id", "c"), ["c"]))


@query("enc8_median_fill", f"WITH {_HOLES}, m AS (SELECT median({_FINITE}) AS m FROM holes WHERE train) SELECT row_id, round(coalesce({_FINITE}, m), 6) AS x FROM holes, m")
def _(spark, d):
    h = _holes(spark, d)
    return rounded(E.median_fill(h.where("train"), h.select("row_id", "x"), ["x"]))


@query("enc9_fill_zero", f"WITH {_HOLES} SELECT row_id, round(coalesce({_FINITE}, 0), 6) AS x FROM holes")
def _(spark, d):
    return rounded(E.clean(_holes(spark, d).select("row_id", "x"), 0.0))


@query("enc10_coerce_numeric", """SELECT k, try_cast(a AS DOUBLE) AS a, b FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_custkey AS varchar) END AS a, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE cast(o_custkey AS varchar) END AS b FROM orders)""")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    o = table(spark, d, "orders").select(k.alias("k"), F.when(k % 4 == 0, None).otherwise(c).alias("a"), F.when(k % 4 == 0, "x").otherwise(c).alias("b"))
    return rounded(E.coerce(o, ["a", "b"]))


@query("enc11_violations", f"WITH {_HOLES} SELECT count(*) FILTER (row_id IS NULL) AS row_id, count(*) FILTER (NOT coalesce(isfinite(x), false)) AS x, count(*) AS c FROM holes")
def _(spark, d):
    found = E.violations(_holes(spark, d).select("row_id", "x", "c"))
    return spark.createDataFrame([found])


@query("enc13_one_hot", """SELECT o_orderkey, (o_orderstatus = 'F')::BIGINT AS "s_F", (o_orderstatus = 'O')::BIGINT AS "s_O", (o_orderstatus = 'P')::BIGINT AS "s_P", 0::BIGINT AS s_nan FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    return rounded(E.one_hot(o, o, "s"))


@query("enc14_ordinal_unknown", f"WITH {_HOLES}, m AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT trim(c) AS value FROM holes WHERE c IS NOT NULL)) SELECT row_id, coalesce(m.code, -1)::BIGINT AS c FROM holes LEFT JOIN m ON m.value = trim(c)")
def _(spark, d):
    h = _holes(spark, d).select("row_id", "c")
    return rounded(E.apply_mapping(h, E.mapping(h, "c", None), "c", missing=None))


@query("enc15_standardize", "WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_extendedprice) AS n, stddev_pop(l_extendedprice) AS t FROM lineitem WHERE l_linenumber <= 5) SELECT l_linenumber::BIGINT AS l_linenumber, round(sum((l_quantity - m) / s), 4) AS q, round(sum((l_extendedprice - n) / t), 4) AS p FROM lineitem, s GROUP BY l_linenumber")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice")
    z = E.standardize(rows.where("l_linenumber <= 5"), rows, ["l_quantity", "l_extendedprice"])
    return rounded(z.groupBy("l_linenumber").agg(F.round(F.sum("l_quantity"), 4).alias("q"), F.round(F.sum("l_extendedprice"), 4).alias("p")))


@query("enc16_robust_scale", "WITH s AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, median(o_totalprice) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT o_orderkey, round((o_totalprice - b) / (c - a), 6) AS x FROM orders, s")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    return rounded(E.robust_scale(o, o, ["x"]))


@query("enc16_yeo_johnson")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"))
    lam = E.yeo_johnson_fit(c, "x")
    return c.select("c_custkey", E.yeo_johnson("x", lam).alias("x"), F.lit(lam).alias("lambda"))


@query("enc16_quantile_normal")
def _(spark, d):
    return E.quantile_normal(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x")), "x", "o_orderkey")


@query("enc17_log_target", "SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS z, round(exp(ln(1 + o_totalprice)) - 1, 4) AS back FROM orders")
def _(spark, d):
    z = F.log1p("o_totalprice")
    return rounded(table(spark, d, "orders").select("o_orderkey", z.alias("z"), F.round(F.expm1(z), 4).alias("back")))


@query("enc7_timestamp_epoch", "SELECT o_orderkey, epoch_us(o_orderdate)::DOUBLE AS t FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.to_epoch("o_orderdate").alias("t"))


@query("enc19_low_cardinality", """SELECT name, n FROM (SELECT 'p_brand' AS name, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part UNION ALL SELECT 'p_partkey', count(DISTINCT p_partkey) FROM part) WHERE n <= 50""")
def _(spark, d):
    p = table(spark, d, "part")
    names = E.low_cardinality(p, ["p_brand", "p_name", "p_size", "p_partkey"])
    counts = p.agg(*[F.count_distinct(n).alias(n) for n in names])
    return counts.unpivot([], names, "name", "n")


@query("flt1_drop_incomplete", f"WITH {_HOLES} SELECT y, count(*) AS kept, (SELECT count(*) FROM holes h WHERE h.y = holes.y) - count(*) AS dropped FROM holes WHERE isfinite(x) AND c IS NOT NULL GROUP BY y")
def _(spark, d):
    h = E.clean(_holes(spark, d))
    whole = F.col("x").isNotNull() & F.col("c").isNotNull()
    return h.groupBy("y").agg(F.count_if(whole).alias("kept"), F.count_if(~whole).alias("dropped"))


@query("flt2_finite_only", f"WITH {_HOLES} SELECT row_id, round(x, 6) AS x FROM holes WHERE isfinite(x)")
def _(spark, d):
    return rounded(E.clean(_holes(spark, d).select("row_id", "x")).where("x is not null"))


@query("flt7_data_contract", "SELECT count(*) AS n, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS bad_target, count(*) FILTER (NOT isfinite(o_totalprice)) AS bad_value FROM orders")
def _(spark, d):
    bad = ~F.col("o_orderstatus").isin("F", "O")
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad_target"), F.count_if(E.finite("o_totalprice").isNull()).alias("bad_value"))


@query("prj1_split_target", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus AS target FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderstatus").alias("target"))


@query("prj2_class_cap", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN (SELECT DISTINCT o_orderstatus FROM orders ORDER BY 1 LIMIT 2)")
def _(spark, d):
    return T.class_cap(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 2)
