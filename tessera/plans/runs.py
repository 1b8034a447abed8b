"""Queries over log files, keyed tables, a user's own models and soft students."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import distill as D
from tessera.operators import models as L
from tessera.operators.encode import principal_components
from tessera.operators.user_models import fit_groups
from tessera.plans.base import query, rounded, table
from tessera.plans.control import _status
from tessera.sources import logs as G
from tessera.sources.shared import fresh_dir, written
from tessera.streaming.keyed import KeyedTable

#: Logs of orders: a job for each thousand orders, with a block an order.
_JOBS = "jobs AS (SELECT o_orderkey, o_orderkey // 1000 AS job, o_custkey % 900 + 100 AS auc, o_custkey % 89 + 10 AS acc FROM orders)"


def order_logs(spark, d) -> DataFrame:
    """The logs, written as text files below a folder a job, read back as whole texts."""
    o = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 1000).alias("job"), (F.col("o_custkey") % 900 + 100).alias("auc"), (F.col("o_custkey") % 89 + 10).alias("acc"))
    block = F.concat(F.lit("【配置"), "o_orderkey", F.lit(": seed "), F.col("o_orderkey") % 5, F.lit("】\n准确率: 0."), "acc", F.lit("\nF1 Score: N/A\nround AUC= 0.5\nAUC: 0."), "auc", F.lit("\n"))
    texts = o.groupBy("job").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x.b), "").alias("b"))  # a thousand orders
    whole = texts.select("job", F.concat(F.lit("Dataset: d"), "job", F.lit("\n"), "b", F.lit("=====\n\nTotal experiment time: 3 s AUC: 0.999\n")).alias("text"))
    path = fresh_dir(spark, "logs")
    whole.write.partitionBy("job").text(path)
    return G.read_logs(spark, path, "*.txt")


def _job(path):
    return F.regexp_extract(path, r"job=(\d+)", 1).cast("long")


@query("src11_log_metrics", f"WITH {_JOBS} SELECT job, o_orderkey AS block, 'seed ' || o_orderkey % 5 AS configuration, round(('0.' || auc)::DOUBLE * 100, 6) AS auc, round(('0.' || acc)::DOUBLE * 100, 6) AS acc FROM jobs")
def _(spark, d):
    """Every block's metrics out of whole log files; what stands after the blocks is in none."""
    found = G.log_metrics(order_logs(spark, d), "classification")
    return rounded(found.select(_job(F.col("path")).alias("job"), "block", "configuration", "auc", "acc"))


@query("src14_joined_status", f"WITH {_JOBS}, b AS (SELECT job, round(('0.' || max(auc))::DOUBLE * 100, 6) AS auc, count(*) AS parsed FROM jobs GROUP BY job), n AS (SELECT DISTINCT job FROM jobs) SELECT CASE WHEN job % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, job::VARCHAR AS job, CASE WHEN job % 2 = 0 THEN 'completed' END AS status, CASE WHEN job % 3 > 0 THEN auc END AS auc, CASE WHEN job % 3 > 0 THEN parsed END AS parsed FROM n JOIN b USING (job)")
def _(spark, d):
    """Status tables of two schemas with the best block of the log that each row names; every third names none."""
    logs = order_logs(spark, d)
    best = G.best_block(G.log_metrics(logs, "classification"), "classification", ["path"])
    jobs = logs.select(_job(F.col("path")).alias("job"), "path").withColumn("path", F.when(F.col("job") % 3 > 0, F.col("path")))
    one = jobs.where("job % 2 = 0").select(F.col("job").alias("job_no"), F.lit("completed").alias("status"), F.col("path").alias("stdout"))
    two = jobs.where("job % 2 = 1").select("job", F.col("path").alias("log"))
    status = G.status_rows([(one, "v1", {"job": "job_no", "log": "stdout"}), (two, "v2", {})])
    return rounded(G.joined_metrics(status, best, _job).select("version", "job", "status", "auc", "parsed"))


@query("str5_repeated_metrics", f"WITH {_JOBS}, r AS (SELECT job, row_number() OVER (PARTITION BY job ORDER BY o_orderkey) AS place, auc, acc FROM jobs), t AS (SELECT job, 2 * place - 1 AS place, 0.5::DOUBLE AS value, 'auc' AS metric FROM r UNION ALL SELECT job, 2 * place, ('0.' || auc)::DOUBLE, 'auc' FROM r UNION ALL SELECT job, place, ('0.' || acc)::DOUBLE, 'acc' FROM r UNION ALL SELECT job, 2 * count(*) + 1, 0.999, 'auc' FROM r GROUP BY job) SELECT job, metric, place, round(value, 6) AS value FROM t")
def _(spark, d):
    """Every number after a label of each log, in order."""
    found = G.repeated_metrics(order_logs(spark, d), {"auc": ["AUC"], "acc": ["准确率", "Accuracy"]})
    return rounded(found.select(_job(F.col("path")).alias("job"), "metric", "place", "value"))


@query("stm9_keyed_table", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY user_id")
def _(spark, d):
    """Events merged into a keyed table batch by batch, two of them twice, with compactions between: the newest event of each user."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    held = KeyedTable(spark, fresh_dir(spark, "keyed"), ["user_id"], ["ts", "event_id"], compact_after=3)
    for number in (0, 1, 2, 1, 3, 4, 4):
        held.merge(e.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == number), number)
    return rounded(held.read().select("user_id", "event_id", "value"))


class NearerMean:
    """A model of a user's own: the class whose mean of the first feature is nearer."""

    def fit(self, x, y):
        column = x.iloc[:, 0]
        self.low, self.high = column[y == 0].mean(), column[y == 1].mean()

    def predict(self, x):
        column = x.iloc[:, 0]
        return ((column - self.high).abs() < (column - self.low).abs()).astype(float)


@query("udf1_group_models", "WITH t AS (SELECT o_orderkey, o_orderstatus AS dataset, o_custkey % 5 AS seed, o_totalprice / 1000 AS price, o_orderpriority IN ('1-URGENT', '2-HIGH') AS y, o_orderkey % 4 = 0 AS test FROM orders), m AS (SELECT dataset, seed, avg(price) FILTER (NOT y) AS low, avg(price) FILTER (y) AS high FROM t WHERE NOT test GROUP BY ALL) SELECT dataset, seed::BIGINT AS seed, o_orderkey, (abs(price - high) < abs(price - low))::INT::DOUBLE AS p FROM t JOIN m USING (dataset, seed) WHERE test")
def _(spark, d):
    """A user's own model for each dataset and seed, fitted and applied in a task a group."""
    t = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("dataset"), (F.col("o_custkey") % 5).alias("seed"), (F.col("o_totalprice") / 1000).alias("price"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("y"), F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("fit").alias("split"))
    return rounded(fit_groups(t, ["dataset", "seed"], "o_orderkey", ["price"], NearerMean)[0].select("dataset", "seed", "o_orderkey", "p"))


@query("dis3_soft_student")
def _(spark, d):
    """Losses on test of students of a forest's probabilities: on true labels, on softened ones, and the one chosen on validation."""
    fit, test = _status(spark, d)
    teacher_model = L.multiclass_pool(42)["forest"].fit(fit)
    both = fit.unionByName(test)
    teacher = written(L.class_probabilities(teacher_model, both, ["row_id"], 3), "teacher")
    inner, val = fit.where(F.pmod(F.xxhash64("row_id"), F.lit(4)) > 0), fit.where(F.pmod(F.xxhash64("row_id"), F.lit(4)) == 0)
    chosen, share, _ = D.chosen_student(teacher, inner, val, "row_id", 3)
    told = None
    for name, model in {"hard": D.hard_student(inner), "soft": D.soft_student(teacher, inner, "row_id", 3), "chosen": chosen}.items():
        part = L.class_probabilities(model, test, ["row_id", "y"], 3).withColumnRenamed("p", "s").withColumn("student", F.lit(name))
        told = part if told is None else told.unionByName(part)
    losses = D.distillation_losses(told.join(teacher.select("row_id", F.col("p").alias("t")), "row_id"), by=["student"])
    return losses.withColumn("share", F.when(F.col("student") == "chosen", F.lit(share)))


@query("enc16_principal_components")
def _(spark, d):
    """Variance of each component of the embeddings, as many as explain 95 % of it."""
    e = L.from_array(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    found = principal_components(e)(e).select(F.posexplode(vector_to_array("features")).alias("component", "x"))
    return found.groupBy("component").agg(F.var_samp("x").alias("variance"), F.count("*").alias("n"))
