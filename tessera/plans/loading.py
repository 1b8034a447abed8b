"""Loader queries: tables written as CSV and read back as tasks; and encoders, folds and merges around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import encode as E
from tessera.operators import features as P
from tessera.operators import models as L
from tessera.operators import tables as T
from tessera.operators.features import Feature
from tessera.operators.split import random_split
from tessera.plans.base import PRED_SQL, predictions, query, rounded, sql_hash, table
from tessera.sources import loaders
from tessera.sources.shared import fresh_dir

_RANK = f"row_number() OVER (ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey)"
_SRC = "src AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus AS status FROM orders)"


def _csv(spark, d, target: str) -> str:
    """Orders as a CSV file set: key, price and priority with gaps, and the target last."""
    k = F.col("o_orderkey")
    price, priority = F.when(k % 7 == 0, None).otherwise(F.col("o_totalprice")), F.when(k % 5 == 0, None).otherwise(F.col("o_orderpriority"))
    kinds = {"status": F.col("o_orderstatus"), "answer": F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no"), "amount": F.when(k % 11 == 0, "unknown").otherwise((F.col("o_totalprice") / 1000).cast("string"))}
    path = fresh_dir(spark, "orders-csv")
    table(spark, d, "orders").select("o_orderkey", price.alias("price"), priority.alias("priority"), kinds[target].alias(target)).write.csv(path, header=True)
    return path


def _keyed(df):
    return df.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("src2_csv_dataset", f"WITH r AS (SELECT o_orderkey, {_RANK} AS r, count(*) OVER () AS n FROM orders), c AS (SELECT count(DISTINCT o_orderstatus) AS classes FROM orders) SELECT o_orderkey, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split, classes FROM r, c")
def _(spark, d):
    path = _csv(spark, d, "status")
    df, classes, _ = loaders.csv_dataset(spark, [path + "-missing", path], 42, 0.2, "o_orderkey")
    return _keyed(df).select("o_orderkey", "split", F.lit(classes).cast("long").alias("classes"))


_CODES = "m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(priority, '__MISSING__') AS v FROM s WHERE split = 'train'))"


@query("src5_binary_task", f"""WITH {_SRC}, s AS (SELECT *, CASE WHEN {_RANK} <= ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM src), {_CODES}
 SELECT o_orderkey, round(coalesce(price, 0)::FLOAT::DOUBLE, 6) AS price, coalesce(code, -1)::BIGINT AS priority, (status = 'F')::BIGINT AS y, split FROM s LEFT JOIN m ON v = coalesce(priority, '__MISSING__')""")
def _(spark, d):
    df = loaders.binary_task(spark, _csv(spark, d, "answer"), "o_orderkey")
    return rounded(_keyed(df).select("o_orderkey", F.col("price").cast("double").alias("price"), "priority", "y", "split"))


_SRANK = f"row_number() OVER (PARTITION BY status ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey)"


@query("src6_multiclass_task", f"""WITH {_SRC}, s AS (SELECT *, CASE WHEN {_SRANK} <= floor(count(*) OVER (PARTITION BY status) * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS split FROM src),
 m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(priority, '__missing__') AS v FROM s WHERE split = 'train')), q AS (SELECT median(price) AS m FROM s WHERE split = 'train')
 SELECT o_orderkey, round(coalesce(price, q.m), 6) AS price, coalesce(code, -1)::BIGINT AS priority, (dense_rank() OVER (ORDER BY status) - 1)::BIGINT AS y, split FROM s CROSS JOIN q LEFT JOIN m ON v = coalesce(priority, '__missing__')""")
def _(spark, d):
    return rounded(_keyed(loaders.multiclass_task(spark, _csv(spark, d, "status"), "o_orderkey")).select("o_orderkey", "price", "priority", "y", "split"))


@query("src7_regression_task", f"""WITH {_SRC}, k AS (SELECT s.*, o.o_totalprice / 1000 AS y FROM src s JOIN orders o USING (o_orderkey) WHERE o_orderkey % 11 <> 0), s AS (SELECT *, CASE WHEN {_RANK} <= ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM k), {_CODES}
 SELECT o_orderkey, round(coalesce(price, 0), 6) AS price, coalesce(code, -1)::BIGINT AS priority, round(y, 6) AS y, split FROM s LEFT JOIN m ON v = coalesce(priority, '__MISSING__')""")
def _(spark, d):
    return rounded(_keyed(loaders.regression_task(spark, _csv(spark, d, "amount"), "o_orderkey")).select("o_orderkey", "price", "priority", "y", "split"))


_CAP = "row_number() OVER (ORDER BY {0}, {1})"


@query("src16_all_tasks", f"""WITH a AS (SELECT o_orderkey AS row_id, o_orderstatus AS y, o_totalprice AS price, 'orders' AS dataset FROM orders WHERE o_orderstatus IN (SELECT DISTINCT o_orderstatus FROM orders ORDER BY 1 LIMIT 2)),
 b AS (SELECT c_custkey AS row_id, c_mktsegment AS y, NULL::DOUBLE AS price, 'customers' AS dataset FROM customer WHERE c_mktsegment IN (SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1 LIMIT 2)),
 u AS (SELECT * FROM a UNION ALL SELECT * FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {sql_hash(42, 'row_id')}, row_id) AS r FROM u) SELECT row_id, y, price, dataset FROM r WHERE r <= 500""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("y"), F.col("o_totalprice").alias("price"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("y"))
    return loaders.all_tasks({"orders": o, "customers": c}, "y", "row_id", 500, 2, 42)


@query("snk6_predictions", f"WITH {PRED_SQL} SELECT row_id AS row_index, y::BIGINT AS target, p AS probability, (p >= 0.5)::BIGINT AS prediction FROM pred")
def _(spark, d):
    return rounded(loaders.write_predictions(predictions(spark, d), fresh_dir(spark, "predictions"), "row_id"))


_ALL = "o AS (SELECT o_orderkey, o_custkey, CASE WHEN {r} <= ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM orders)".replace("{r}", _RANK)


@query("enc4_codes_fit_on_all", f"WITH {_ALL}, m AS (SELECT o_custkey, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_custkey, cast(o_custkey AS varchar) AS v FROM o)) SELECT o_orderkey, split, code::BIGINT AS code FROM o JOIN m USING (o_custkey)")
def _(spark, d):
    o = random_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 0.2, 42, "o_orderkey")
    return rounded(E.encode_split(o, ["o_custkey"], "all").select("o_orderkey", "split", F.col("o_custkey").alias("code")))


@query("enc6_column_transform", f"WITH {_SRC}, s AS (SELECT *, CASE WHEN {_RANK} <= ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM src), {_CODES} SELECT o_orderkey, round(coalesce(price, 0), 6) AS price, coalesce(code, -1)::BIGINT AS priority FROM s LEFT JOIN m ON v = coalesce(priority, '__MISSING__')")
def _(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k, F.when(k % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("price"), F.when(k % 5 == 0, None).otherwise(F.col("o_orderpriority")).alias("priority"))
    parts = random_split(o, 0.2, 42, "o_orderkey")
    return rounded(E.column_transform(parts.where("split = 'train'"), parts, ["price"], ["priority"]).select("o_orderkey", "price", "priority"))


@query("enc12_numeric_frame", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::BIGINT AS word, (o_orderkey % 2 = 0)::BIGINT AS flag, (o_custkey * 2)::DOUBLE AS number, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END AS holes FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k, F.col("o_orderpriority").alias("word"), (k % 2 == 0).alias("flag"), (F.col("o_custkey") * 2).cast("string").alias("number"), F.when(k % 3 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("holes"))
    return rounded(E.numeric_frame(o))


@query("prj5_final_columns", "SELECT o_custkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders")
def _(spark, d):
    return E.final_columns(table(spark, d, "orders"), ["o_custkey", "o_totalprice", "o_orderstatus"], ["o_orderpriority", "o_custkey"], "o_orderstatus")


@query("jn10_merge_by_keys", """WITH r AS (SELECT o_orderstatus AS dataset, o_custkey % 5 AS seed, 'v' || (o_orderkey % 3) AS condition, o_orderkey AS job, o_totalprice AS rmse, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 END AS picp FROM orders)
 SELECT dataset, seed::BIGINT AS seed, condition, job, rmse, CASE WHEN job % 3 = 1 THEN round((job % 10) / 10.0::DOUBLE, 6) ELSE picp END AS picp, CASE WHEN job % 3 = 1 THEN (job % 7)::BIGINT END AS mpiw FROM r""")
def _(spark, d):
    k = F.col("o_orderkey")
    keys = [F.col("o_orderstatus").alias("dataset"), (F.col("o_custkey") % 5).alias("seed"), F.concat(F.lit("v"), k % 3).alias("condition"), k.alias("job")]
    o = table(spark, d, "orders")
    records = o.select(*keys, F.col("o_totalprice").alias("rmse"), F.when(k % 2 == 0, 0.5).alias("picp"))
    extra = o.where("o_orderkey % 3 = 1").select(*keys, (k % 10 / 10.0).alias("picp"), (k % 7).alias("mpiw"))
    return rounded(T.merge_by_keys(records, extra, ["dataset", "seed", "condition", "job"]))


def _order_ranks(seed: int) -> str:
    return f"row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_hash(seed, 'o_orderkey')}, o_orderkey)"


@query("spl9_repeated_holdout", "WITH " + ", ".join(f"""r{r} AS (SELECT {r} AS repeat, o_totalprice AS p, {_order_ranks(42 + r)} <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.25::DOUBLE + 0.5) AS val FROM orders)""" for r in range(3)) + ", u AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2), m AS (SELECT repeat, avg(p) AS m FROM u WHERE NOT val GROUP BY repeat) SELECT repeat::BIGINT AS repeat, round(sqrt(avg((p - m) ** 2)), 4) AS score FROM u JOIN m USING (repeat) WHERE val GROUP BY repeat")
def _(spark, d):
    """Root mean squared error of the training mean over three re-splits."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")

    def score(train, val):
        mean = train.agg(F.avg("o_totalprice")).first()[0]
        return val.agg(F.sqrt(F.avg(F.pow(F.col("o_totalprice") - mean, 2)))).first()[0]

    return rounded(L.repeated_holdout(o, score, "o_orderkey", "o_orderstatus", 3, 42).withColumn("score", F.round("score", 4)))


_PROGRAM = [Feature("unit", "try_divide(price, k)"), Feature("mean_price", group_by="status", statistic="avg(price)")]
_FOLD = f"(row_number() OVER (PARTITION BY status ORDER BY {sql_hash(42, 'k')}, k) - 1) % 5"


@query("fea23_dry_run", f"WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders) SELECT 'whole' AS program, 0::BIGINT AS repeat, fold::BIGINT AS fold, count(*) AS rows, false AS failed FROM (SELECT {_FOLD} AS fold FROM o) GROUP BY fold UNION ALL SELECT 'broken', NULL, NULL, NULL, true")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    whole = P.dry_run(_PROGRAM, o, "k", 5, 1, 42, "status")
    broken = P.dry_run([Feature("x", "missing_column + 1")], o, "k")
    out = whole.withColumn("program", F.lit("whole")).unionByName(broken.withColumn("program", F.lit("broken")))
    return rounded(out.select("program", "repeat", "fold", "rows", F.col("error").isNotNull().alias("failed")))


@query("fsel4_top_intersection", """WITH c AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber']) AS name, unnest([abs(corr(l_quantity, l_extendedprice)), abs(corr(l_discount, l_extendedprice)), abs(corr(l_tax, l_extendedprice)), abs(corr(l_linenumber, l_extendedprice))]) AS a,
 unnest([var_pop(l_quantity), var_pop(l_discount), var_pop(l_tax), var_pop(l_linenumber)]) AS b FROM lineitem), r AS (SELECT name, row_number() OVER (ORDER BY a DESC, name) AS ra, row_number() OVER (ORDER BY b DESC, name) AS rb FROM c) SELECT name, ra::BIGINT AS place FROM r WHERE ra <= 3 AND rb <= 3""")
def _(spark, d):
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    li = table(spark, d, "lineitem")
    row = li.agg(*[F.abs(F.corr(n, "l_extendedprice")).alias(f"a_{n}") for n in names], *[F.var_pop(n).alias(f"b_{n}") for n in names]).first()
    screens = [{n: row[f"{s}_{n}"] for n in names} for s in "ab"]
    chosen = P.top_intersection(screens, 3)
    order = sorted(names, key=lambda n: (-screens[0][n], n))
    return spark.createDataFrame([(n, order.index(n) + 1) for n in chosen], "name string, place long")


P.feature_function("log_ratio", lambda a, b: __import__("numpy").log1p(a / b.where(b != 0)))
P.metric_function("rmse_over_mean", {"e": lambda y, p: (p - y) * (p - y), "s": lambda y, p: F.abs(y)}, lambda n, e, s: F.sqrt(e / n) / (s / n))


@query("udf2_user_feature", "SELECT l_linenumber::BIGINT AS l_linenumber, round(sum(ln(1 + l_extendedprice / l_quantity)), 3) AS log_ratio FROM lineitem GROUP BY 1")
def _(spark, d):
    li = P.apply_feature(table(spark, d, "lineitem"), "log_ratio", ["l_extendedprice", "l_quantity"], "log_ratio")
    return rounded(li.groupBy("l_linenumber").agg(F.round(F.sum("log_ratio"), 3).alias("log_ratio")))


@query("udf2_user_metric", "SELECT o_orderstatus AS dataset, round(sqrt(avg((o_totalprice * 0.1 - 30 * (o_custkey % 1000)) ** 2)) / avg(abs(o_totalprice)), 6) AS rmse_over_mean FROM orders GROUP BY 1")
def _(spark, d):
    from tessera.plans.base import regression

    return rounded(P.apply_metric(regression(spark, d), "rmse_over_mean", "y", "p", ["dataset"]))
