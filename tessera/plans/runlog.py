"""Run-log queries, batch forms; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.base import LOG_SQL, query, rounded, run_log, table
from tessera.streaming import runlog as R

_L = "WITH " + LOG_SQL


@query("agg9_event_counters", f"{_L} SELECT round, stage, sum(k) AS total, count(*) AS n FROM log GROUP BY ALL")
def _(spark, d):
    maps = run_log(spark, d).select("round", F.create_map("stage", "k").alias("events"))
    return maps.select("round", F.explode("events").alias("stage", "k")).groupBy("round", "stage").agg(F.sum("k").alias("total"), F.count("*").alias("n"))


@query("agg18_budget", f"{_L}, c AS (SELECT run, event_id, ts, sum(value) OVER (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM log) SELECT run, round(max(spent), 4) AS total, min(ts) FILTER (spent > 300) AS crossed FROM c GROUP BY run")
def _(spark, d):
    w = Window.partitionBy("run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = run_log(spark, d).withColumn("spent", F.sum("value").over(w))
    return spent.groupBy("run").agg(F.round(F.max("spent"), 4).alias("total"), F.min(F.when(F.col("spent") > 300, F.col("ts"))).alias("crossed"))


_ROUND = f"{_L}, r AS (SELECT run, round, arg_min(value, (ts, event_id)) AS v FROM log GROUP BY ALL)"


def _rounds(spark, d):
    return run_log(spark, d).groupBy("run", "round").agg(F.min_by("value", F.struct("ts", "event_id")).alias("v"))


@query("win3_running_best", f"{_ROUND} SELECT run, round, round(max(v) OVER (PARTITION BY run ORDER BY round ROWS UNBOUNDED PRECEDING), 6) AS best FROM r")
def _(spark, d):
    w = Window.partitionBy("run").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(_rounds(spark, d).select("run", "round", F.max("v").over(w).alias("best")))


@query("win4_convergence_round", f"{_ROUND}, g AS (SELECT run, round, abs(v - lag(v) OVER (PARTITION BY run ORDER BY round)) AS g FROM r) SELECT run, min(round) FILTER (g < 1.0) AS converged FROM g GROUP BY run")
def _(spark, d):
    gap = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("run").orderBy("round")))
    return _rounds(spark, d).withColumn("g", gap).groupBy("run").agg(F.min(F.when(F.col("g") < 1.0, F.col("round"))).alias("converged"))


@query("win5_round_deltas", f"{_ROUND} SELECT run, round, round(v, 6) AS v, round(v - lag(v) OVER (PARTITION BY run ORDER BY round), 6) AS delta FROM r")
def _(spark, d):
    return rounded(_rounds(spark, d).withColumn("delta", F.col("v") - F.lag("v").over(Window.partitionBy("run").orderBy("round"))))


@query("stm3_failure_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL")
def _(spark, d):
    return R.failure_counts(table(spark, d, "events"))


@query("stm4_transitions", f"{_L}, c AS (SELECT run, round, count(*) FILTER (stage = 'signup') AS retries, count(*) FILTER (stage = 'purchase' AND k > 90) AS fallbacks, count(*) FILTER (stage = 'error') AS failures FROM log GROUP BY ALL) SELECT run, round, CASE WHEN fallbacks > 0 THEN 'fallback_to_best_runnable' WHEN retries > 0 OR failures > 0 THEN 'revise_affected_plan' ELSE 'retain_plan' END AS action FROM c")
def _(spark, d):
    stage = F.col("stage")
    c = run_log(spark, d).groupBy("run", "round").agg(F.count_if(stage == "signup").alias("r"), F.count_if((stage == "purchase") & (F.col("k") > 90)).alias("f"), F.count_if(stage == "error").alias("e"))
    return c.select("run", "round", R.transition(F.col("r"), F.col("f"), F.col("e")).alias("action"))


@query("stm6_interval_totals", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    return R.interval_counts(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("stm7_sliding_counts", "SELECT b + INTERVAL (-15 * i) minute AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 15 minutes, ts) AS b, event_type FROM events), (SELECT unnest(range(4)) AS i) GROUP BY ALL")
def _(spark, d):
    return R.interval_counts(table(spark, d, "events"), "1 hour", "15 minutes").drop("total")


@query("stm7_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 hours THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 hours AS \"end\", count(*) AS n FROM s GROUP BY user_id, s")
def _(spark, d):
    return R.sessions(table(spark, d, "events"))


@query("stm8_newest_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id")
def _(spark, d):
    e = R.deduplicated(table(spark, d, "events"))
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))


@query("stm10_trace_export", f"{_L} SELECT run, arg_max(round, (value, event_id)) AS best_round, round(max(value), 6) AS best, count(*) AS rows FROM log WHERE stage = 'purchase' GROUP BY run")
def _(spark, d):
    p = run_log(spark, d).where("stage = 'purchase'")
    return rounded(p.groupBy("run").agg(F.max_by("round", F.struct("value", "event_id")).alias("best_round"), F.max("value").alias("best"), F.count("*").alias("rows")))


@query("stm11_failure_categories", f"{_L} SELECT stage, CASE WHEN k >= 80 THEN 'timeout' WHEN k >= 60 THEN 'retry' ELSE 'none' END AS reason, count(*) AS n FROM log GROUP BY ALL")
def _(spark, d):
    reason = F.when(F.col("k") >= 80, "timeout").when(F.col("k") >= 60, "retry").otherwise("none")
    return run_log(spark, d).groupBy("stage", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("stm12_job_matrix", f"{_L}, j AS (SELECT stage, round, s AS seed FROM (SELECT DISTINCT stage FROM log), (SELECT DISTINCT round FROM log), (SELECT unnest(range(42, 47)) AS s)) SELECT stage, round, seed FROM j WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.stage = j.stage AND log.round = j.round AND 42 + log.k % 5 = j.seed AND log.value > 90)")
def _(spark, d):
    log = run_log(spark, d)
    jobs = log.select("stage").distinct().crossJoin(log.select("round").distinct()).crossJoin(spark.range(42, 47).toDF("seed"))  # dimensions
    done = log.where("value > 90").select("stage", "round", (42 + F.col("k") % 5).alias("seed")).distinct()
    return jobs.join(done, ["stage", "round", "seed"], "left_anti")
