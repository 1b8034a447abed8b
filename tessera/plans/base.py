"""Registry of queries with their oracle SQL, and the tables that the queries derive from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Every double to 6 decimals, every int to long: what both engines print alike."""
    out = []
    for name, kind in df.dtypes:
        out.append(r6(name).alias(name) if kind in ("double", "float") else F.col(name).cast("long").alias(name) if kind in ("int", "smallint", "tinyint") else F.col(name))
    return df.select(*out)


HASH = "('0x' || substr(md5('{seed}|' || cast({key} as varchar)), 1, 8))::BIGINT"


def sql_hash(seed: int, key: str) -> str:
    return HASH.format(seed=seed, key=key)


#: Scored binary task: two models' probabilities for each order, in five seeds and three datasets.
PRED_SQL = """pred AS (SELECT o_orderkey AS row_id, o_orderstatus AS dataset, 42 + o_custkey % 5 AS seed, y,
 round(1 / (1 + exp(-z)), 4) AS p, round(1 / (1 + exp(-0.8 * z - 0.1)), 4) AS q FROM (
 SELECT *, (o_totalprice - 250000) / 150000 + CASE WHEN y = 1 THEN 0.6 ELSE -0.4 END + (o_custkey % 97) / 97.0::DOUBLE - 0.5 AS z FROM (
 SELECT *, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS y FROM orders)))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0))
    z = (F.col("o_totalprice") - 250000) / 150000 + F.when(F.col("y") == 1, 0.6).otherwise(-0.4) + (F.col("o_custkey") % 97) / F.lit(97.0) - 0.5
    o = o.withColumn("z", z)
    return o.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("dataset"), (42 + F.col("o_custkey") % 5).alias("seed"), "y",
        F.round(1 / (1 + F.exp(-F.col("z"))), 4).alias("p"), F.round(1 / (1 + F.exp(-0.8 * F.col("z") - 0.1)), 4).alias("q"),
    )


#: Scored line items: the large prediction table.
LINES_SQL = """lines AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_linestatus AS dataset,
 round(1 / (1 + exp(-((l_quantity - 25) / 20 + (l_discount - 0.05) * 10 + CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 0 END))), 4) AS p FROM lineitem)"""


def line_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    z = (F.col("l_quantity") - 25) / 20 + (F.col("l_discount") - 0.05) * 10 + F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").select(y.alias("y"), F.col("l_linestatus").alias("dataset"), F.round(1 / (1 + F.exp(-z)), 4).alias("p"))


#: Regression predictions of order prices by a teacher and a student.
REG_SQL = """reg AS (SELECT o_orderkey AS row_id, o_orderstatus AS dataset, o_totalprice AS y,
 o_totalprice * 0.9 + (o_custkey % 1000) * 30 AS p, o_totalprice * 0.85 + (o_custkey % 1000) * 35 + (o_orderkey % 13) * 500 AS q FROM orders)"""


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_custkey") % 1000, F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("dataset"), price.alias("y"),
        (price * 0.9 + k * 30).alias("p"), (price * 0.85 + k * 35 + (F.col("o_orderkey") % 13) * 500).alias("q"),
    )


#: Three class probabilities for each order's status.
MULTI_SQL = """multi AS (SELECT row_id, y, round(a / (a + b + c), 4) AS pf, round(b / (a + b + c), 4) AS po, round(c / (a + b + c), 4) AS pp FROM (
 SELECT o_orderkey AS row_id, o_orderstatus AS y, 0.2 + (o_custkey % 11) + CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 0 END AS a,
 0.2 + (o_custkey % 7) + CASE WHEN o_orderstatus = 'O' THEN 4 ELSE 0 END AS b, 0.2 + (o_custkey % 5) + CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END AS c FROM orders))"""
CLASSES = {"F": "pf", "O": "po", "P": "pp"}


def multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, y = table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    raw = {c: 0.2 + (F.col("o_custkey") % m) + F.when(y == c, w).otherwise(0) for c, m, w in (("F", 11, 4), ("O", 7, 4), ("P", 5, 2))}
    o = o.select(F.col("o_orderkey").alias("row_id"), y.alias("y"), *[v.cast("double").alias(k) for k, v in raw.items()])
    total = F.col("F") + F.col("O") + F.col("P")
    return o.select("row_id", "y", *[F.round(F.col(c) / total, 4).alias(n) for c, n in CLASSES.items()])


#: Benchmark result rows: one metric for each task, framework, dataset and seed of many runs.
BENCH_SQL = """bench AS (SELECT l_returnflag AS task, l_linestatus AS framework, 'ds' || cast(l_suppkey % 20 AS varchar) AS dataset, l_linenumber::BIGINT AS seed,
 'v' || cast(1 + l_partkey % 6 AS varchar) AS version, l_extendedprice / 1000 AS metric, l_quantity AS cost, CASE WHEN l_tax >= 0.08 THEN 'failed' ELSE 'completed' END AS status,
 l_orderkey AS job, l_shipdate AS ts FROM lineitem)"""


def bench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("framework"), F.concat(F.lit("ds"), F.col("l_suppkey") % 20).alias("dataset"), F.col("l_linenumber").cast("long").alias("seed"),
        F.concat(F.lit("v"), 1 + F.col("l_partkey") % 6).alias("version"), (F.col("l_extendedprice") / 1000).alias("metric"), F.col("l_quantity").alias("cost"),
        F.when(F.col("l_tax") >= 0.08, "failed").otherwise("completed").alias("status"), F.col("l_orderkey").alias("job"), F.col("l_shipdate").alias("ts"),
    )


#: Run-event log: user is the run, day the round, event type the stage.
LOG_SQL = """log AS (SELECT event_id, ts, user_id AS run, day(ts)::BIGINT AS round, event_type AS stage, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("run"), F.dayofmonth("ts").cast("long").alias("round"), F.col("event_type").alias("stage"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
