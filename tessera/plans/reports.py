"""Source-shaped and report queries over benchmark-style rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import tables as T
from tessera.plans.base import BENCH_SQL, PRED_SQL, bench_rows, predictions, query, rounded, table
from tessera.sources.files import json_lines, path_keys, sections
from tessera.sources.shared import fresh_dir

_G = "WITH " + BENCH_SQL
_CELL = f"{_G}, cell AS (SELECT task, framework, dataset, seed, avg(metric) AS value, avg(cost) AS cost FROM bench GROUP BY ALL)"


def _cell(spark, d):
    return bench_rows(spark, d).groupBy("task", "framework", "dataset", "seed").agg(F.avg("metric").alias("value"), F.avg("cost").alias("cost"))


@query("flt3_trusted_runs", f"{_G} SELECT task, version, count(*) AS n FROM bench WHERE status = 'completed' AND version NOT IN ('v1', 'v2', 'v3') GROUP BY ALL")
def _(spark, d):
    trusted = (F.col("status") == "completed") & ~F.col("version").isin("v1", "v2", "v3")
    return bench_rows(spark, d).where(trusted).groupBy("task", "version").agg(F.count("*").alias("n"))


@query("src8_cluster_loader", "SELECT c_mktsegment AS dataset, count(*) AS n, count(DISTINCT c_nationkey) AS n_clusters, round(sum(CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_acctbal END), 4) AS total FROM customer GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "customer").withColumn("x", F.when(F.col("c_custkey") % 9 == 0, float("nan")).otherwise(F.col("c_acctbal")))
    train, test = c.where("c_custkey % 5 < 4"), c.where("c_custkey % 5 = 4")
    both = train.unionByName(test).withColumn("x", F.coalesce(F.when(~F.isnan("x"), F.col("x")), F.lit(0.0)))
    return both.groupBy(F.col("c_mktsegment").alias("dataset")).agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("n_clusters"), F.round(F.sum("x"), 4).alias("total"))


@query("src9_json_events", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL AS corrupt FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT NULL, NULL, '{"event_id":' || event_id FROM events WHERE event_id % 10 = 0""")
def _(spark, d):
    """Events written as JSON lines, every tenth cut off, and read back: a bad line is a row with its text."""
    path = fresh_dir(spark, "json-lines")
    k = F.get_json_object("props", "$.k")
    line = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 10 != 0, F.concat(F.lit(', "k": '), k, F.lit("}"))).otherwise(""))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return json_lines(spark, path, "event_id long, k long").withColumnRenamed("_corrupt", "corrupt").withColumn("event_id", F.when(F.col("corrupt").isNull(), F.col("event_id")))


@query("src10_artifact_keys", f"{_G} SELECT task, dataset, seed, version AS condition, count(*) AS n FROM bench GROUP BY ALL")
def _(spark, d):
    path = F.concat_ws("/", F.lit("/runs"), "task", "dataset", F.concat(F.lit("seed_"), "seed"), F.concat("version", F.lit(".json")))
    keyed = bench_rows(spark, d).select(*path_keys(path))
    return keyed.groupBy("task", "dataset", "seed", "condition").agg(F.count("*").alias("n"))


@query("src15_sectioned_tables", "SELECT 'table ' || p_partkey AS title, 'row' || i AS name, c AS column, CASE c WHEN 'a' THEN cast(p_size + i AS varchar) ELSE cast(p_size * i AS varchar) END AS cell FROM part, (SELECT unnest(range(3)) AS i), (SELECT unnest(['a', 'b']) AS c)")
def _(spark, d):
    body = [F.concat(F.lit("table "), "p_partkey"), F.lit("name,a,b")] + [F.concat(F.lit(f"row{i},"), F.col("p_size") + i, F.lit(","), F.col("p_size") * i) for i in range(3)] + [F.lit("")]
    lines = table(spark, d, "part").select("p_partkey", F.posexplode(F.array(*body)).alias("line", "text"))
    return sections(lines, ["p_partkey"]).drop("p_partkey")


@query("src14_status_union", f"{_G} SELECT version, status, count(*) AS n, round(avg(metric), 6) AS mean FROM bench WHERE version IN ('v1', 'v2') GROUP BY ALL")
def _(spark, d):
    b = bench_rows(spark, d)
    one = b.where("version = 'v1'").select(F.lit("v1").alias("version"), F.col("status").alias("state"), F.col("metric").alias("score")).select("version", F.col("state").alias("status"), F.col("score").alias("metric"))
    two = b.where("version = 'v2'").select(F.lit("v2").alias("version"), "status", "metric")
    return rounded(one.unionByName(two).groupBy("version", "status").agg(F.count("*").alias("n"), F.avg("metric").alias("mean")))


@query("fid5_fact_table", f"WITH {PRED_SQL}, a AS (SELECT 'classification' AS task, dataset, seed, corr(p, q) AS fidelity, avg((p - y) * (p - y)) AS teacher, avg((q - y) * (q - y)) AS student FROM pred GROUP BY ALL) SELECT task, dataset, seed, round(fidelity, 6) AS fidelity, round(teacher, 6) AS teacher, round(student, 6) AS student, fidelity < 0.9 OR student > 1.1 * teacher AS failed FROM a")
def _(spark, d):
    gap = lambda c: F.avg(F.pow(F.col(c) - F.col("y"), 2))
    a = predictions(spark, d).groupBy("dataset", "seed").agg(F.corr("p", "q").alias("fidelity"), gap("p").alias("teacher"), gap("q").alias("student"))
    failed = (F.col("fidelity") < 0.9) | (F.col("student") > 1.1 * F.col("teacher"))
    return rounded(a.select(F.lit("classification").alias("task"), "dataset", "seed", "fidelity", "teacher", "student", failed.alias("failed")))


@query("rpt1_best_setting", f"{_CELL}, s AS (SELECT task, dataset, framework, count(DISTINCT seed) AS seeds, avg(value) AS mean FROM cell GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY task, dataset ORDER BY (seeds >= 5)::INT DESC, mean DESC, framework) AS r FROM s) SELECT task, dataset, framework, seeds, round(mean, 6) AS mean, seeds >= 5 AS strict FROM r WHERE r = 1")
def _(spark, d):
    s = _cell(spark, d).groupBy("task", "dataset", "framework").agg(F.count_distinct("seed").alias("seeds"), F.avg("value").alias("mean"))
    best = T.best_per_group(s, ["task", "dataset"], [(F.col("seeds") >= 5).cast("int").desc(), F.col("mean").desc(), F.col("framework")])
    return rounded(best.withColumn("strict", F.col("seeds") >= 5))


@query("rpt2_published_deltas", f"{_CELL}, n AS (SELECT task, dataset, avg(value) AS new FROM cell WHERE framework = 'O' GROUP BY ALL), o AS (SELECT task, dataset, avg(value) AS old FROM cell WHERE framework = 'F' AND dataset <> 'ds3' GROUP BY ALL) SELECT task, dataset, round(new - old, 6) AS delta, CASE WHEN old IS NULL THEN 'missing' WHEN abs(new - old) < 0.5 THEN 'same' WHEN new > old THEN 'better' ELSE 'worse' END AS status FROM n FULL JOIN o USING (task, dataset)")
def _(spark, d):
    c = _cell(spark, d)
    n = c.where("framework = 'O'").groupBy("task", "dataset").agg(F.avg("value").alias("new"))
    o = c.where("framework = 'F' and dataset <> 'ds3'").groupBy("task", "dataset").agg(F.avg("value").alias("old"))
    gap = F.col("new") - F.col("old")
    status = F.when(F.col("old").isNull(), "missing").when(F.abs(gap) < 0.5, "same").when(gap > 0, "better").otherwise("worse")
    return rounded(n.join(o, ["task", "dataset"], "full").select("task", "dataset", gap.alias("delta"), status.alias("status")))


@query("rpt3_gap_flags", f"{_CELL} SELECT a.task, a.dataset, a.seed, round(a.value - b.value, 6) AS gap, abs(a.value - b.value) > 5 AS large FROM cell a LEFT JOIN cell b ON b.task = a.task AND b.dataset = a.dataset AND b.seed = a.seed AND b.framework = 'F' WHERE a.framework = 'O'")
def _(spark, d):
    c, keys = _cell(spark, d), ["task", "dataset", "seed"]
    both = c.where("framework = 'O'").join(c.where("framework = 'F'").select(*keys, F.col("value").alias("base")), keys, "left")
    gap = F.col("value") - F.col("base")
    return rounded(both.select(*keys, gap.alias("gap"), (F.abs(gap) > 5).alias("large")))


@query("rpt4_instability", f"{_G} SELECT task, dataset, round(stddev_samp(metric), 6) AS std, count(*) FILTER (status = 'failed') AS failures FROM bench GROUP BY ALL HAVING stddev_samp(metric) > 28 OR count(*) FILTER (status = 'failed') > 120")
def _(spark, d):
    s = bench_rows(spark, d).groupBy("task", "dataset").agg(F.stddev_samp("metric").alias("std"), F.count_if(F.col("status") == "failed").alias("failures"))
    return rounded(s.where("std > 28 or failures > 120"))


@query("rpt5_clean_logs", f"{_CELL}, r AS (SELECT *, row_number() OVER (PARTITION BY task, dataset ORDER BY seed, framework) AS r FROM cell) SELECT task, dataset, seed, framework, printf('%.4f', value) AS text FROM r WHERE r <= 5")
def _(spark, d):
    w = Window.partitionBy("task", "dataset").orderBy("seed", "framework")
    r = _cell(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 5")
    return r.select("task", "dataset", "seed", "framework", F.format_string("%.4f", "value").alias("text"))


@query("rpt6_key_claims", f"{_CELL} SELECT 'cells' AS claim, count(*)::DOUBLE AS value FROM cell UNION ALL SELECT 'mean', round(avg(value), 6) FROM cell UNION ALL SELECT 'best', round(max(value), 6) FROM cell")
def _(spark, d):
    one = _cell(spark, d).agg(F.count("*").cast("double").alias("cells"), F.avg("value").alias("mean"), F.max("value").alias("best"))
    return rounded(one.unpivot([], ["cells", "mean", "best"], "claim", "value"))


@query("rpt7_inventory", "SELECT 'orders' AS source, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'labels', count(*) FROM labels")
def _(spark, d):
    out = None
    for name in ("orders", "events", "labels"):
        row = table(spark, d, name).agg(F.count("*").alias("n")).withColumn("source", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("rpt9_placeholders", f"{_CELL}, k AS (SELECT t.task, s.dataset, g.seed FROM (SELECT DISTINCT task FROM cell) t, (SELECT DISTINCT dataset FROM cell) s, (SELECT unnest(range(1, 9)) AS seed) g), f AS (SELECT task, dataset, seed, value FROM cell WHERE framework = 'F') SELECT k.*, round(f.value, 6) AS value, (f.value IS NULL)::BIGINT AS failed_flag, CASE WHEN f.value IS NULL THEN 'no result' END AS reason FROM k LEFT JOIN f USING (task, dataset, seed)")
def _(spark, d):
    c, keys = _cell(spark, d), ["task", "dataset", "seed"]
    grid = c.select("task").distinct().crossJoin(c.select("dataset").distinct()).crossJoin(spark.range(1, 9).toDF("seed"))  # dimensions
    joined = grid.join(c.where("framework = 'F'").select(*keys, "value"), keys, "left")
    return rounded(joined.withColumn("failed_flag", F.col("value").isNull().cast("long")).withColumn("reason", F.when(F.col("value").isNull(), "no result")))


@query("rpt10_cluster_rows", "SELECT c_mktsegment AS config, count(DISTINCT c_custkey % 7) AS k, round(avg((c_nationkey % 5 = c_custkey % 7)::INT), 6) AS match, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    same = (F.col("c_nationkey") % 5 == F.col("c_custkey") % 7).cast("double")
    return rounded(table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("config")).agg(F.count_distinct(F.col("c_custkey") % 7).alias("k"), F.avg(same).alias("match"), F.count("*").alias("n")))


@query("rpt8_curated", f"{_CELL} SELECT dataset, round(max(value) - min(value), 4) AS reduction, CASE WHEN sum(CASE WHEN value > 50 THEN 1 ELSE -1 END) > 0 THEN 'support' ELSE 'none' END AS margin FROM cell WHERE task IN ('A', 'N') GROUP BY dataset")
def _(spark, d):
    c = _cell(spark, d).where("task in ('A', 'N')").groupBy("dataset")
    margin = F.when(F.sum(F.when(F.col("value") > 50, 1).otherwise(-1)) > 0, "support").otherwise("none")
    return c.agg(F.round(F.max("value") - F.min("value"), 4).alias("reduction"), margin.alias("margin"))
