"""Calibration, threshold and interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import logit
from tessera.operators import calibration as C
from tessera.operators import metrics as M
from tessera.operators.split import stratified_split
from tessera.plans.base import CLASSES, LINES_SQL, MULTI_SQL, PRED_SQL, REG_SQL, line_predictions, multiclass, predictions, query, regression, rounded

_GRID = [0.25, 0.5, 1.0, 2.0, 4.0]
_CLIP = "least(greatest({0}, 1e-6), 1 - 1e-6)"


@query("cal4_temperature_grid", f"""WITH {PRED_SQL}, z AS (SELECT y, ln({_CLIP.format('p')} / (1 - {_CLIP.format('p')})) AS z FROM pred), g AS (SELECT unnest({_GRID!r}) AS t),
 q AS (SELECT t::DOUBLE AS t, y, {_CLIP.format('1 / (1 + exp(-z / t))')} AS q FROM z, g) SELECT t, round(avg(-y * ln(q) - (1 - y) * ln(1 - q)), 6) AS loss FROM q GROUP BY t""")
def _(spark, d):
    scored = predictions(spark, d).withColumn("z", logit(F.col("p")))
    return rounded(C.temperature_losses(scored, "y", "z", _GRID))


@query("cal4_temperature_fit")
def _(spark, d):
    scored = predictions(spark, d).withColumn("z", logit(F.col("p")))
    return spark.createDataFrame([(C.fit_temperature(scored, "y", "z"),)], "temperature double")


@query("cal5_multiclass_temperature_grid", f"""WITH {MULTI_SQL}, l AS (SELECT y, ln({_CLIP.format('pf')}) AS f, ln({_CLIP.format('po')}) AS o, ln({_CLIP.format('pp')}) AS p FROM multi), g AS (SELECT unnest({_GRID!r})::DOUBLE AS t),
 q AS (SELECT t, {_CLIP.format("exp((CASE y WHEN 'F' THEN f WHEN 'O' THEN o ELSE p END) / t) / (exp(f / t) + exp(o / t) + exp(p / t))")} AS q FROM l, g) SELECT t, round(avg(-ln(q)), 6) AS loss FROM q GROUP BY t""")
def _(spark, d):
    return rounded(C.multiclass_temperature_losses(multiclass(spark, d), "y", CLASSES, _GRID))


_T = [i / 100 for i in range(1, 100)]


@query("cal7_best_threshold", f"""WITH {LINES_SQL}, g AS (SELECT i / 100.0::DOUBLE AS t FROM (SELECT unnest(range(1, 100)) AS i)), h AS (SELECT dataset, p, sum(y) AS pos, sum(1 - y) AS neg FROM lines GROUP BY ALL),
 c AS (SELECT dataset, t, sum(pos) FILTER (p >= t) AS tp, sum(neg) FILTER (p >= t) AS fp, sum(pos) FILTER (p < t) AS fn, sum(neg) FILTER (p < t) AS tn FROM h, g GROUP BY ALL),
 s AS (SELECT dataset, t, (coalesce(tp, 0) / (coalesce(tp, 0) + coalesce(fn, 0))::DOUBLE + coalesce(tn, 0) / (coalesce(tn, 0) + coalesce(fp, 0))::DOUBLE) / 2 AS b FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY b DESC, t) AS r FROM s) SELECT dataset, t AS threshold, round(b, 6) AS balanced_accuracy FROM r WHERE r = 1""")
def _(spark, d):
    scores = C.threshold_table(line_predictions(spark, d), "y", "p", _T, ["dataset"])
    return rounded(C.best_threshold(scores, "balanced_accuracy", ["dataset"]))


_RES = f"WITH {REG_SQL}, r AS (SELECT dataset, abs(y - p) AS res FROM reg), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY res) AS i, count(*) OVER (PARTITION BY dataset) AS n FROM r)"


def _residuals(spark, d):
    return regression(spark, d).withColumn("res", F.abs(F.col("y") - F.col("p")))


@query("int1_conformal_higher", f"{_RES} SELECT dataset, round(res, 6) AS qhat FROM k WHERE i = ceil((n - 1) * 0.9::DOUBLE - 1e-12) + 1")
def _(spark, d):
    return rounded(C.conformal(_residuals(spark, d), "res", 0.1, ["dataset"]))


@query("int2_conformal_finite", f"{_RES} SELECT dataset, round(res, 6) AS qhat FROM k WHERE i = ceil((n - 1) * least(ceil((n + 1) * 0.9::DOUBLE) / n, 1) - 1e-12) + 1")
def _(spark, d):
    return rounded(C.conformal(_residuals(spark, d), "res", 0.1, ["dataset"], "finite"))


@query("int3_conformal_linear", f"{_RES} SELECT dataset, round(quantile_cont(res, 0.9), 6) AS qhat FROM k GROUP BY dataset")
def _(spark, d):
    return rounded(C.conformal(_residuals(spark, d), "res", 0.1, ["dataset"], "linear"))


@query("int4_interval_curve", " UNION ALL ".join(f"SELECT * FROM ({_RES.replace('abs(y - p) AS res', f'abs(y - p) AS res, y, p')}, q AS (SELECT dataset AS ds, res AS qhat FROM k WHERE i = ceil((n - 1) * {1 - a!r}::DOUBLE - 1e-12) + 1) SELECT dataset, {a!r}::DOUBLE AS alpha, round(avg((res <= qhat)::INT), 6) AS picp, round(any_value(2 * qhat), 6) AS mpiw FROM k JOIN q ON ds = dataset GROUP BY dataset)" for a in (0.05, 0.1, 0.2)))
def _(spark, d):
    res = _residuals(spark, d)
    out = None
    for alpha in (0.05, 0.1, 0.2):
        q = res.join(C.conformal(res, "res", alpha, ["dataset"]), "dataset")
        row = q.groupBy("dataset").agg(F.avg((F.col("res") <= F.col("qhat")).cast("double")).alias("picp"), F.any_value(2 * F.col("qhat")).alias("mpiw")).withColumn("alpha", F.lit(alpha))
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query("evr4_raw_interval", f"WITH {REG_SQL}, s AS (SELECT dataset AS ds, 1.645 * stddev_samp(y - p) AS h FROM reg GROUP BY dataset) SELECT dataset, round(avg((abs(y - p) <= h)::INT), 6) AS picp, round(any_value(2 * h), 6) AS mpiw FROM reg JOIN s ON ds = dataset GROUP BY dataset")
def _(spark, d):
    reg = regression(spark, d)
    half = reg.groupBy("dataset").agg((F.lit(1.645) * F.stddev_samp(F.col("y") - F.col("p"))).alias("h"))
    joined = reg.join(half, "dataset")
    return rounded(joined.groupBy("dataset").agg(F.avg((F.abs(F.col("y") - F.col("p")) <= F.col("h")).cast("double")).alias("picp"), F.any_value(2 * F.col("h")).alias("mpiw")))


@query("cal1_platt")
def _(spark, d):
    parts = stratified_split(predictions(spark, d), "y", 0.3, 42, "row_id", ("fit", "test"))
    return C.platt(parts.where("split = 'fit'"), "y", "p", parts.where("split = 'test'")).select("row_id", "y", "p", "calibrated")


@query("cal3_isotonic")
def _(spark, d):
    parts = stratified_split(predictions(spark, d), "y", 0.3, 42, "row_id", ("fit", "test"))
    return C.isotonic(parts.where("split = 'fit'"), "y", "p", parts.where("split = 'test'")).select("row_id", "y", "p", "calibrated")


@query("cal6_selected_calibrator")
def _(spark, d):
    """Validation losses of raw, Platt and isotonic probabilities, the least of them marked."""
    parts = stratified_split(predictions(spark, d), "y", 0.3, 42, "row_id", ("fit", "test"))
    fit, test = parts.where("split = 'fit'"), parts.where("split = 'test'")
    raw = M.probability_scores(test).withColumn("method", F.lit("raw"))
    pl = M.probability_scores(C.platt(fit, "y", "p", test), p="calibrated").withColumn("method", F.lit("platt"))
    iso = M.probability_scores(C.isotonic(fit, "y", "p", test), p="calibrated").withColumn("method", F.lit("isotonic"))
    table = raw.unionByName(pl).unionByName(iso)
    best = table.agg(F.min_by("method", F.struct("log_loss", "method")).alias("best"))
    return table.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("method") == F.col("best")).drop("best")  # three rows
