"""Join, aggregation, window, ranking, top-k and set queries over benchmark-style result rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import tables as T
from tessera.operators.ranking import linear_quantiles
from tessera.plans.base import BENCH_SQL, bench_rows, query, rounded, sql_hash, table

_G = "WITH " + BENCH_SQL


def _cell(spark, d):
    """One value a (task, framework, dataset, seed): the mean metric."""
    return bench_rows(spark, d).groupBy("task", "framework", "dataset", "seed").agg(F.avg("metric").alias("value"), F.avg("cost").alias("cost"))


_CELL = f"{_G}, cell AS (SELECT task, framework, dataset, seed, avg(metric) AS value, avg(cost) AS cost FROM bench GROUP BY ALL)"


@query("agg1_group_summary", f"{_G} SELECT task, dataset, round(avg(metric), 6) AS metric_mean, round(CASE WHEN count(metric) = 1 THEN 0 ELSE stddev_samp(metric) END, 6) AS metric_std, count(metric) AS metric_n, round(avg(cost), 6) AS cost_mean, round(CASE WHEN count(cost) = 1 THEN 0 ELSE stddev_samp(cost) END, 6) AS cost_std, count(cost) AS cost_n FROM bench GROUP BY ALL")
def _(spark, d):
    return rounded(T.grouped_summary(bench_rows(spark, d), ["task", "dataset"], ["metric", "cost"]))


@query("agg2_summary_null_groups", "SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END::BIGINT AS g, round(avg(l_quantity), 6) AS q_mean, round(CASE WHEN count(l_quantity) = 1 THEN NULL ELSE stddev_samp(l_quantity) END, 6) AS q_std, count(l_quantity) AS q_n FROM lineitem GROUP BY 1")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("long")).alias("g"), F.col("l_quantity").alias("q"))
    return rounded(T.grouped_summary(li, ["g"], ["q"], None))


@query("agg3_failure_counts", f"{_G} SELECT task, dataset, count(*) AS n_rows, count(DISTINCT seed) AS n_seeds, count(*) FILTER (status = 'failed') AS failed_count FROM bench GROUP BY ALL")
def _(spark, d):
    return bench_rows(spark, d).groupBy("task", "dataset").agg(F.count("*").alias("n_rows"), F.count_distinct("seed").alias("n_seeds"), F.count_if(F.col("status") == "failed").alias("failed_count"))


@query("agg4_two_level", f"{_G} SELECT task, CASE WHEN grouping(dataset) = 1 THEN 'ALL' ELSE dataset END AS dataset, round(avg(metric), 6) AS mean, count(*) AS n FROM bench GROUP BY GROUPING SETS ((task), (task, dataset))")
def _(spark, d):
    return rounded(T.two_level(bench_rows(spark, d), "task", "dataset", [F.avg("metric").alias("mean"), F.count("*").alias("n")]))


@query("agg5_share_of_true", f"{_G} SELECT dataset, round(avg(CASE WHEN metric >= 40 THEN 1.0 ELSE 0.0 END), 6) AS share FROM bench GROUP BY dataset")
def _(spark, d):
    return rounded(bench_rows(spark, d).groupBy("dataset").agg(F.avg((F.col("metric") >= 40).cast("double")).alias("share")))


@query("agg6_mean_std_text", f"{_G} SELECT task, printf('%.2f±%.2f', avg(cost), stddev_samp(cost)) AS text FROM bench GROUP BY task")
def _(spark, d):
    return bench_rows(spark, d).groupBy("task").agg(T.mean_std_text(F.avg("cost"), F.stddev_samp("cost")).alias("text"))


@query("agg7_distinct_counts", "SELECT count(DISTINCT l_returnflag) AS classes, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_linenumber) AS lines FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct("l_returnflag").alias("classes"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_linenumber").alias("lines"))


@query("agg8_joined_names", f"{_G} SELECT task, dataset, string_agg(DISTINCT version, ',' ORDER BY version) AS versions, string_agg(DISTINCT framework, ',' ORDER BY framework) AS frameworks FROM bench GROUP BY ALL")
def _(spark, d):
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return bench_rows(spark, d).groupBy("task", "dataset").agg(names("version").alias("versions"), names("framework").alias("frameworks"))


@query("agg10_failure_table", f"{_G} SELECT task, dataset, count(*) FILTER (status = 'failed') AS failures, round(avg(cost), 6) AS mean_cost, round(avg(metric), 6) AS mean_metric FROM bench GROUP BY ALL")
def _(spark, d):
    return rounded(bench_rows(spark, d).groupBy("task", "dataset").agg(F.count_if(F.col("status") == "failed").alias("failures"), F.avg("cost").alias("mean_cost"), F.avg("metric").alias("mean_metric")))


@query("agg11_run_quality", f"{_G} SELECT task, count(*) FILTER (status = 'completed') AS success, count(*) AS total, round(sum(cost), 6) AS cost FROM bench GROUP BY task UNION ALL SELECT 'events', count(*) FILTER (event_type <> 'error'), count(*), round(sum(value), 6) FROM events")
def _(spark, d):
    runs = bench_rows(spark, d).groupBy("task").agg(F.count_if(F.col("status") == "completed").alias("success"), F.count("*").alias("total"), F.sum("cost").alias("cost"))
    log = table(spark, d, "events").agg(F.count_if(F.col("event_type") != "error").alias("success"), F.count("*").alias("total"), F.sum("value").alias("cost")).withColumn("task", F.lit("events"))
    return rounded(runs.unionByName(log))


@query("agg12_win_tie_loss", f"{_CELL} SELECT a.task, count(*) FILTER (a.value - b.value > 1e-12) AS win, count(*) FILTER (abs(a.value - b.value) <= 1e-12) AS tie, count(*) FILTER (a.value - b.value < -1e-12) AS loss, count(*) FILTER (a.value - b.value > 1e-12) - count(*) FILTER (a.value - b.value < -1e-12) AS margin FROM cell a JOIN cell b USING (task, dataset, seed) WHERE a.framework = 'F' AND b.framework = 'O' GROUP BY a.task")
def _(spark, d):
    c = _cell(spark, d)
    return T.win_tie_loss(c.where("framework = 'F'"), c.where("framework = 'O'"), ["task", "dataset", "seed"], ["task"], "value", True)


@query("agg13_bootstrap_ci", f"""{_CELL}, g AS (SELECT task, dataset, seed - 1 AS pos, value, count(*) OVER (PARTITION BY task, dataset) AS n FROM cell WHERE framework = 'O'),
 s AS (SELECT task, dataset, any_value(n) AS n, avg(value) AS mean FROM g GROUP BY ALL), dr AS (SELECT task, dataset, n, mean, r, unnest(range(n)) AS place FROM s, (SELECT unnest(range(1, 101)) AS r)),
 w AS (SELECT *, (('0x' || substr(md5('9|' || r || '|' || place), 1, 8))::BIGINT) % n AS pos FROM dr), m AS (SELECT w.task, w.dataset, w.mean, w.r, avg(g.value) AS m FROM w JOIN g USING (task, dataset, pos) GROUP BY ALL)
 SELECT task, dataset, round(mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m GROUP BY task, dataset, mean""")
def _(spark, d):
    c = _cell(spark, d).where("framework = 'O'").withColumn("pos", F.col("seed") - 1)
    return rounded(T.bootstrap_ci(c, ["task", "dataset"], "value", "pos", 100, 9))


@query("agg14_standardised_mean", f"{_CELL} SELECT task, dataset, round(CASE WHEN stddev_samp(value) > 1e-12 THEN avg(value) / stddev_samp(value) END, 6) AS z FROM cell GROUP BY ALL")
def _(spark, d):
    s = F.stddev_samp("value")
    return rounded(_cell(spark, d).groupBy("task", "dataset").agg(F.when(s > 1e-12, F.avg("value") / s).alias("z")))


@query("agg15_threshold_reasons", f"{_CELL} SELECT task, framework, dataset, seed, concat_ws(';', CASE WHEN value < 40 THEN 'low_metric' END, CASE WHEN cost > 27 THEN 'high_cost' END, CASE WHEN seed > 5 THEN 'late_seed' END) AS reasons FROM cell")
def _(spark, d):
    checks = {"low_metric": F.col("value") < 40, "high_cost": F.col("cost") > 27, "late_seed": F.col("seed") > 5}
    return _cell(spark, d).select("task", "framework", "dataset", "seed", T.reasons(checks).alias("reasons"))


@query("agg16_minimum_support", f"{_CELL}, k AS (SELECT *, row_number() OVER (PARTITION BY task, framework, dataset ORDER BY seed) AS r, count(*) OVER (PARTITION BY task, framework, dataset) AS n FROM cell) SELECT task, framework, dataset, round(avg(value), 6) AS mean, count(*) AS n FROM k WHERE n >= 5 AND r <= 5 GROUP BY ALL")
def _(spark, d):
    w = Window.partitionBy("task", "framework", "dataset")
    k = _cell(spark, d).withColumn("r", F.row_number().over(w.orderBy("seed"))).withColumn("n", F.count("*").over(w))
    return rounded(k.where("n >= 5 and r <= 5").groupBy("task", "framework", "dataset").agg(F.avg("value").alias("mean"), F.count("*").alias("n")))


@query("agg19_profile", """SELECT 'o_totalprice' AS name, count(o_totalprice) AS n, count(*) - count(o_totalprice) AS n_null, count(DISTINCT o_totalprice) AS n_distinct, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std, round(min(o_totalprice), 6) AS low, round(max(o_totalprice), 6) AS high FROM orders
 UNION ALL SELECT 'o_custkey', count(o_custkey), count(*) - count(o_custkey), count(DISTINCT o_custkey), round(avg(o_custkey), 6), round(stddev_samp(o_custkey), 6), min(o_custkey), max(o_custkey) FROM orders""")
def _(spark, d):
    names = ["o_totalprice", "o_custkey"]
    stats = lambda n: F.struct(F.count(n).alias("n"), F.count_if(F.col(n).isNull()).alias("n_null"), F.count_distinct(n).alias("n_distinct"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min(n).cast("double").alias("low"), F.max(n).cast("double").alias("high"))
    one = table(spark, d, "orders").agg(*[stats(n).alias(n) for n in names])
    return rounded(one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("s")) for n in names])).alias("x")).select("x.name", "x.s.*"))


@query("agg20_summary_check", f"{_CELL} SELECT 0::BIGINT AS mismatches, count(*) AS groups FROM (SELECT DISTINCT task, dataset FROM cell)")
def _(spark, d):
    c = _cell(spark, d)
    once, again = (T.grouped_summary(x, ["task", "dataset"], ["value"]) for x in (c, c.repartition(3, "seed")))
    off = ~F.abs(F.col("l.value_mean") - F.col("r.value_mean")).eqNullSafe(F.lit(0.0)) & (F.abs(F.col("l.value_mean") - F.col("r.value_mean")) > 1e-10)
    return once.alias("l").join(again.alias("r"), ["task", "dataset"], "full").agg(F.count_if(F.coalesce(off, F.lit(True))).alias("mismatches"), F.count("*").alias("groups"))


@query("agg21_quantiles", f"{_G} SELECT task, round(quantile_cont(metric, 0.1), 6) AS q10, round(median(metric), 6) AS q50, round(quantile_cont(metric, 0.9), 6) AS q90, round(quantile_cont(metric, 0.95), 6) AS q95 FROM bench GROUP BY task")
def _(spark, d):
    return rounded(linear_quantiles(bench_rows(spark, d), "metric", {"q10": 0.1, "q50": 0.5, "q90": 0.9, "q95": 0.95}, ["task"]))


@query("agg22_mixed_summary", f"{_CELL} SELECT a.*, b.over FROM (SELECT dataset, round(avg(value), 6) AS mean_value, count(*) AS n FROM cell GROUP BY dataset) a LEFT JOIN (SELECT dataset, count(*) FILTER (cost > 45) AS over FROM bench GROUP BY dataset) b USING (dataset)")
def _(spark, d):
    a = _cell(spark, d).groupBy("dataset").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))
    b = bench_rows(spark, d).groupBy("dataset").agg(F.count_if(F.col("cost") > 45).alias("over"))
    return rounded(a.join(b, "dataset", "left"))


@query("agg23_dataset_card", f"{_CELL} SELECT task, dataset, round(avg(value), 6) AS mean_value, round(1 / avg(cost), 6) AS speed FROM cell GROUP BY ALL")
def _(spark, d):
    return rounded(_cell(spark, d).groupBy("task", "dataset").agg(F.avg("value").alias("mean_value"), F.try_divide(F.lit(1.0), F.avg("cost")).alias("speed")))


_BEST = f"{_G}, b AS (SELECT *, row_number() OVER (PARTITION BY task, dataset, seed ORDER BY CASE WHEN task = 'N' THEN -metric ELSE metric END DESC, version DESC, job DESC, cost DESC) AS r FROM bench WHERE status = 'completed')"


def _best(spark, d):
    signed = F.when(F.col("task") == "N", -F.col("metric")).otherwise(F.col("metric"))
    return T.best_per_group(bench_rows(spark, d).where("status = 'completed'"), ["task", "dataset", "seed"], [signed.desc(), F.col("version").desc(), F.col("job").desc(), F.col("cost").desc()])


@query("win1_best_per_group", f"{_BEST} SELECT task, dataset, seed, version, job, round(metric, 6) AS metric FROM b WHERE r = 1")
def _(spark, d):
    return rounded(_best(spark, d).select("task", "dataset", "seed", "version", "job", "metric"))


@query("win2_first_after_sort", f"{_CELL}, b AS (SELECT *, row_number() OVER (PARTITION BY task, dataset ORDER BY value DESC, cost, framework, seed) AS r FROM cell) SELECT task, dataset, framework, seed, round(value, 6) AS value FROM b WHERE r = 1")
def _(spark, d):
    b = T.best_per_group(_cell(spark, d), ["task", "dataset"], [F.col("value").desc(), F.col("cost"), F.col("framework"), F.col("seed")])
    return rounded(b.select("task", "dataset", "framework", "seed", "value"))


@query("win6_min_max", f"{_CELL} SELECT task, framework, dataset, seed, round(CASE WHEN max(value) OVER w - min(value) OVER w < 1e-12 THEN 1 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) AS score FROM cell WINDOW w AS (PARTITION BY task, dataset)")
def _(spark, d):
    return rounded(T.min_max(_cell(spark, d), ["task", "dataset"], "value", True).select("task", "framework", "dataset", "seed", "score"))


@query("win8_method_order", f"{_CELL}, s AS (SELECT framework, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS score FROM cell WINDOW w AS (PARTITION BY task, dataset)) SELECT framework, round(avg(score), 6) AS score, row_number() OVER (ORDER BY avg(score) DESC, framework) AS place FROM s GROUP BY framework")
def _(spark, d):
    means = T.min_max(_cell(spark, d), ["task", "dataset"], "value", True).groupBy("framework").agg(F.avg("score").alias("score"))
    return rounded(means.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "framework"))))  # one row a framework


@query("win9_curve_interpolation", f"""{_CELL}, r AS (SELECT task, dataset, value, row_number() OVER (PARTITION BY task, dataset ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY task, dataset) AS n FROM cell WHERE framework = 'F'),
 g AS (SELECT DISTINCT task, dataset, n, unnest(range(11)) AS k FROM r), p AS (SELECT *, k / 10.0::DOUBLE * (n - 1) AS x FROM g)
 SELECT p.task, p.dataset, p.k, round(a.value + (b.value - a.value) * (x - floor(x)), 6) AS value FROM p JOIN r a ON a.task = p.task AND a.dataset = p.dataset AND a.i = floor(x) JOIN r b ON b.task = p.task AND b.dataset = p.dataset AND b.i = least(floor(x) + 1, p.n - 1)""")
def _(spark, d):
    w = Window.partitionBy("task", "dataset")
    r = _cell(spark, d).where("framework = 'F'").select("task", "dataset", "value", (F.row_number().over(w.orderBy("value")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    grid = r.select("task", "dataset", "n").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("x", F.col("k") / 10.0 * (F.col("n") - 1))
    low = grid.withColumn("i", F.floor("x").cast("int")).join(r.select("task", "dataset", "i", F.col("value").alias("a")), ["task", "dataset", "i"])
    high = low.withColumn("i", F.least(F.col("i") + 1, F.col("n") - 1).cast("int")).join(r.select("task", "dataset", "i", F.col("value").alias("b")), ["task", "dataset", "i"])
    return rounded(high.select("task", "dataset", "k", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("x") - F.floor("x"))).alias("value")))


@query("win10_z_score", f"{_CELL} SELECT task, framework, dataset, seed, round((cost - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w < 1e-12 THEN 1 ELSE stddev_pop(value) OVER w END, 6) AS z FROM cell WINDOW w AS (PARTITION BY seed, task)")
def _(spark, d):
    w = Window.partitionBy("seed", "task")
    s = F.stddev_pop("value").over(w)
    return rounded(_cell(spark, d).withColumn("z", (F.col("cost") - F.avg("value").over(w)) / F.when(s < 1e-12, 1.0).otherwise(s)).select("task", "framework", "dataset", "seed", "z"))


@query("win11_last_wins", f"{_G}, b AS (SELECT *, row_number() OVER (PARTITION BY task, dataset, seed ORDER BY ts DESC, job DESC, cost DESC, metric DESC) AS r FROM bench) SELECT task, dataset, seed, ts, job, status FROM b WHERE r = 1")
def _(spark, d):
    last = T.best_per_group(bench_rows(spark, d), ["task", "dataset", "seed"], [F.col(c).desc() for c in ("ts", "job", "cost", "metric")])
    return last.select("task", "dataset", "seed", "ts", "job", "status")


@query("top1_top_k", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, d):
    return rounded(table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25))


@query("top3_adaptive_threshold", f"{_CELL}, k AS (SELECT *, max(value) OVER (PARTITION BY task) AS mv, max(cost) OVER (PARTITION BY task) AS mc FROM cell), f AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY value + cost DESC, framework, dataset, seed) AS r FROM k WHERE value >= 0.5 * mv AND cost >= 0.5 * mc) SELECT task, framework, dataset, seed, round(value, 6) AS value FROM f WHERE r <= 5")
def _(spark, d):
    f = T.adaptive_threshold(_cell(spark, d), ["task"], ["value", "cost"], 0.5, 5, ["framework", "dataset", "seed"])
    return rounded(f.select("task", "framework", "dataset", "seed", "value"))


@query("top4_gap_selection", f"{_CELL}, k AS (SELECT *, min(value) OVER (PARTITION BY task, dataset) AS best, row_number() OVER (PARTITION BY task, dataset ORDER BY value, framework, seed) AS r FROM cell) SELECT task, dataset, framework, seed, round(value, 6) AS value FROM k WHERE (value <= best * 1.1 OR r <= 2) AND r <= 5")
def _(spark, d):
    k = T.gap_selection(_cell(spark, d), ["task", "dataset"], "value", 0.1, 2, 5, ["framework", "seed"])
    return rounded(k.select("task", "dataset", "framework", "seed", "value"))


@query("top5_greedy_pruning", """WITH l AS (SELECT l_quantity AS a, l_quantity * 2 + 1 AS b, l_discount AS c, l_tax AS d FROM lineitem),
 p AS (SELECT abs(corr(a, b)) < 0.995 AS ab, abs(corr(a, c)) < 0.995 AS ac, abs(corr(a, d)) < 0.995 AS ad, abs(corr(b, c)) < 0.995 AS bc, abs(corr(b, d)) < 0.995 AS bd, abs(corr(c, d)) < 0.995 AS cd FROM l),
 t AS (SELECT *, ac AND (NOT ab OR bc) AS c FROM p) SELECT 'a' AS name UNION ALL SELECT 'b' FROM t WHERE ab UNION ALL SELECT 'c' FROM t WHERE c UNION ALL SELECT 'd' FROM t WHERE ad AND (NOT ab OR bd) AND (NOT c OR cd)""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_quantity") * 2 + 1).alias("b"), F.col("l_discount").alias("c"), F.col("l_tax").alias("d"))
    return spark.createDataFrame([(n,) for n in T.greedy_uncorrelated(li, ["a", "b", "c", "d"])], "name string")


@query("top6_k_compatible", "WITH c AS (SELECT c_nationkey AS id, count(DISTINCT c_mktsegment) + c_nationkey % 4 AS k, avg(c_acctbal) AS s FROM customer GROUP BY c_nationkey), g AS (SELECT *, min(abs(k - 6)) OVER () AS gap FROM c) SELECT id::BIGINT AS id, k, round(s, 6) AS s, row_number() OVER (ORDER BY s DESC, id) AS place FROM g WHERE abs(k - 6) = gap")
def _(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.count_distinct("c_mktsegment").alias("k"), F.avg("c_acctbal").alias("s")).withColumn("k", F.col("k") + F.col("id") % 4)
    gap = c.agg(F.min(F.abs(F.col("k") - 6)).alias("gap"))
    near = c.crossJoin(F.broadcast(gap)).where("abs(k - 6) = gap").drop("gap")
    return rounded(near.withColumn("place", F.row_number().over(Window.orderBy(F.col("s").desc(), "id"))))  # candidates only


@query("top7_arg_best", f"{_CELL} SELECT task, dataset, arg_min(framework || '/' || seed, value) AS choice, round(min(value), 6) AS value FROM cell GROUP BY ALL")
def _(spark, d):
    return rounded(_cell(spark, d).groupBy("task", "dataset").agg(F.min_by(F.concat_ws("/", "framework", "seed"), "value").alias("choice"), F.min("value").alias("value")))


@query("set1_union_by_name", "SELECT o_orderkey AS k, o_totalprice AS v, NULL::VARCHAR AS s FROM orders UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("s"))
    return o.unionByName(c, allowMissingColumns=True)


@query("set2_intersect_features", "SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("set3_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("set4_long_and_wide", f"{_CELL}, a AS (SELECT task, dataset, framework, avg(value) AS v FROM cell GROUP BY ALL) SELECT task, dataset, round(max(v) FILTER (framework = 'F'), 6) AS f, round(max(v) FILTER (framework = 'O'), 6) AS o FROM a GROUP BY ALL")
def _(spark, d):
    long = _cell(spark, d).select("task", "dataset", "framework", "seed", "value", "cost").unpivot(["task", "dataset", "framework", "seed"], ["value", "cost"], "metric", "v")
    wide = long.where("metric = 'value'").groupBy("task", "dataset").pivot("framework", ["F", "O"]).agg(F.avg("v"))
    return rounded(wide.select("task", "dataset", F.col("F").alias("f"), F.col("O").alias("o")))


@query("jn1_left_join", "SELECT o.o_orderkey, c.c_mktsegment FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 5000")
def _(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").drop("o_custkey")


@query("jn2_inner_on_unstable", f"{_CELL}, u AS (SELECT task, dataset FROM cell GROUP BY ALL HAVING stddev_samp(value) > 2) SELECT task, dataset, seed, framework, round(value, 6) AS value FROM cell JOIN u USING (task, dataset)")
def _(spark, d):
    c = _cell(spark, d)
    unstable = c.groupBy("task", "dataset").agg(F.stddev_samp("value").alias("s")).where("s > 2")
    return rounded(c.join(unstable, ["task", "dataset"], "left_semi").select("task", "dataset", "seed", "framework", "value"))


@query("jn3_full_outer", "SELECT coalesce(s.s_nationkey, c.c_nationkey)::BIGINT AS nation, s.n AS suppliers, c.n AS customers FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) c ON s.s_nationkey = c.c_nationkey")
def _(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.count("*").alias("suppliers"))
    c = table(spark, d, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count("*").alias("customers"))
    return s.join(c, "nation", "full")


@query("jn4_multi_left", f"{_CELL}, k AS (SELECT DISTINCT dataset FROM cell) SELECT k.dataset, round(a.v, 6) AS best_f, round(b.v, 6) AS best_o, c.n AS runs FROM k LEFT JOIN (SELECT dataset, max(value) AS v FROM cell WHERE framework = 'F' GROUP BY 1) a USING (dataset) LEFT JOIN (SELECT dataset, max(value) AS v FROM cell WHERE framework = 'O' AND seed > 3 GROUP BY 1) b USING (dataset) LEFT JOIN (SELECT dataset, count(*) AS n FROM cell GROUP BY 1) c USING (dataset)")
def _(spark, d):
    c = _cell(spark, d)
    a = c.where("framework = 'F'").groupBy("dataset").agg(F.max("value").alias("best_f"))
    b = c.where("framework = 'O' and seed > 3").groupBy("dataset").agg(F.max("value").alias("best_o"))
    n = c.groupBy("dataset").agg(F.count("*").alias("runs"))
    return rounded(c.select("dataset").distinct().join(a, "dataset", "left").join(b, "dataset", "left").join(n, "dataset", "left"))


@query("jn5_pending_jobs", f"{_G}, j AS (SELECT DISTINCT task, dataset, seed, version FROM bench) SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM bench b WHERE b.status = 'completed' AND b.task = j.task AND b.dataset = j.dataset AND b.seed = j.seed AND b.version = j.version)")
def _(spark, d):
    keys = ["task", "dataset", "seed", "version"]
    b = bench_rows(spark, d)
    return T.pending(b.select(*keys).distinct(), b, keys)


@query("jn6_alias_pivot", f"{_CELL}, m AS (SELECT * FROM (VALUES ('F', 'forest'), ('O', 'ours')) t(framework, family)), p AS (SELECT c.task, c.dataset, m.family, max(c.value) AS v FROM cell c JOIN m USING (framework) WHERE abs(c.seed / 10.0::DOUBLE - 0.1) < 1e-8 GROUP BY ALL) SELECT task, dataset, round(max(v) FILTER (family = 'forest'), 6) AS forest, round(max(v) FILTER (family = 'ours'), 6) AS ours FROM p GROUP BY ALL")
def _(spark, d):
    alias = F.create_map(F.lit("F"), F.lit("forest"), F.lit("O"), F.lit("ours"))
    c = _cell(spark, d).where("abs(seed / 10.0D - 0.1D) < 1e-8").withColumn("family", alias[F.col("framework")])
    return rounded(c.groupBy("task", "dataset").pivot("family", ["forest", "ours"]).agg(F.max("value")))


@query("jn7_coverage_grid", f"{_G} SELECT t.task, s.dataset, g.seed, EXISTS (SELECT 1 FROM bench b WHERE b.task = t.task AND b.dataset = s.dataset AND b.seed = g.seed AND b.status = 'failed') AS present FROM (SELECT DISTINCT task FROM bench) t, (SELECT DISTINCT dataset FROM bench) s, (SELECT unnest(range(1, 10)) AS seed) g")
def _(spark, d):
    b = bench_rows(spark, d)
    dims = [b.select("task").distinct(), b.select("dataset").distinct(), spark.range(1, 10).toDF("seed")]
    return T.coverage_grid(dims, b.where("status = 'failed'"), ["task", "dataset", "seed"])


@query("jn8_candidate_pairs", f"{_CELL}, m AS (SELECT version AS model, dataset, seed, avg(metric) AS v FROM bench GROUP BY ALL) SELECT a.model AS a, b.model AS b, round(corr(a.v, b.v), 6) AS corr, count(*) AS n FROM m a JOIN m b USING (dataset, seed) WHERE a.model < b.model GROUP BY ALL")
def _(spark, d):
    m = bench_rows(spark, d).groupBy(F.col("version").alias("model"), "dataset", "seed").agg(F.avg("metric").alias("v"))
    a, b = m.withColumnsRenamed({"model": "a", "v": "x"}), m.withColumnsRenamed({"model": "b", "v": "y"})
    return rounded(a.join(b, ["dataset", "seed"]).where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"), F.count("*").alias("n")))


@query("jn11_condition_sets", f"{_G} SELECT dataset, seed, len(list_filter(['v1', 'v2', 'v3', 'v4', 'v5', 'v6'], lambda x: NOT list_contains(list(DISTINCT version), x))) = 0 AS complete FROM bench GROUP BY ALL")
def _(spark, d):
    expected = F.array(*[F.lit(f"v{i}") for i in range(1, 7)])
    return bench_rows(spark, d).groupBy("dataset", "seed").agg((F.size(F.array_except(expected, F.collect_set("version"))) == 0).alias("complete"))


@query("jn12_lookup_update", f"{_CELL}, s AS (SELECT dataset, avg(value) AS m FROM cell WHERE dataset < 'ds15' GROUP BY dataset) SELECT task, framework, dataset, seed, round(coalesce(s.m, value), 6) AS value FROM cell LEFT JOIN s USING (dataset)")
def _(spark, d):
    c = _cell(spark, d)
    s = c.where("dataset < 'ds15'").groupBy("dataset").agg(F.avg("value").alias("m"))
    return rounded(c.join(s, "dataset", "left").select("task", "framework", "dataset", "seed", F.coalesce("m", "value").alias("value")))


@query("jn13_result_with_fallback", f"{_CELL}, k AS (SELECT DISTINCT task, dataset, seed FROM cell), e AS (SELECT * FROM cell WHERE framework = 'F' AND seed % 2 = 0), b AS (SELECT * FROM cell WHERE framework = 'O' AND seed < 6) SELECT k.*, round(coalesce(e.value, b.value), 6) AS value, e.value IS NULL AND b.value IS NULL AS failed FROM k LEFT JOIN e USING (task, dataset, seed) LEFT JOIN b USING (task, dataset, seed)")
def _(spark, d):
    c, keys = _cell(spark, d), ["task", "dataset", "seed"]
    exact = c.where("framework = 'F' and seed % 2 = 0").select(*keys, F.col("value").alias("e"))
    base = c.where("framework = 'O' and seed < 6").select(*keys, F.col("value").alias("b"))
    joined = c.select(*keys).distinct().join(exact, keys, "left").join(base, keys, "left")
    return rounded(joined.select(*keys, F.coalesce("e", "b").alias("value"), (F.col("e").isNull() & F.col("b").isNull()).alias("failed")))


@query("jn14_first_config", f"{_G}, f AS (SELECT dataset, seed, version, metric, row_number() OVER (PARTITION BY dataset, seed, version ORDER BY job, cost, metric) AS r FROM bench) SELECT dataset, seed, round(max(metric) FILTER (version = 'v1'), 6) AS v1, round(max(metric) FILTER (version = 'v2'), 6) AS v2 FROM f WHERE r = 1 AND version IN ('v1', 'v2') GROUP BY ALL")
def _(spark, d):
    first = T.best_per_group(bench_rows(spark, d).where("version in ('v1', 'v2')"), ["dataset", "seed", "version"], [F.col("job"), F.col("cost"), F.col("metric")])
    return rounded(first.groupBy("dataset", "seed").pivot("version", ["v1", "v2"]).agg(F.max("metric")))


@query("prj4_capped_rows", f"SELECT dataset, count(*) AS n FROM (SELECT 'ds' || l_suppkey % 20 AS dataset, row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY {sql_hash(2, 'l_orderkey')}, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 2000 GROUP BY dataset")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("dataset", F.concat(F.lit("ds"), F.col("l_suppkey") % 20))
    return T.row_cap(rows, 2000, 2, "l_orderkey", ["dataset"]).groupBy("dataset").agg(F.count("*").alias("n"))
