"""Metric queries: classification, regression, clustering and fidelity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.plans.base import (
    CLASSES, LINES_SQL, MULTI_SQL, ORACLE_SQL, PRED_SQL, REG_SQL, line_predictions, multiclass, predictions, query, regression, rounded, table,
)


@query("evc1_roc_auc", f"""WITH {LINES_SQL}, s AS (SELECT dataset, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM lines GROUP BY ALL),
 w AS (SELECT *, sum(neg) OVER (PARTITION BY dataset ORDER BY p) - neg AS below FROM s)
 SELECT dataset, round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE, 6) AS auc FROM w GROUP BY dataset""")
def _(spark, d):
    return rounded(M.roc_auc(line_predictions(spark, d), by=["dataset"]))


@query("evc2_average_precision", f"""WITH {LINES_SQL}, s AS (SELECT dataset, p, sum(y) AS pos, count(*) AS n FROM lines GROUP BY ALL),
 w AS (SELECT *, sum(pos) OVER (PARTITION BY dataset ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY dataset ORDER BY p DESC) AS al FROM s)
 SELECT dataset, round(sum(pos * tp / al::DOUBLE) / sum(pos), 6) AS pr_auc FROM w GROUP BY dataset""")
def _(spark, d):
    return rounded(M.average_precision(line_predictions(spark, d), by=["dataset"]))


_RATES = """accuracy, (recall + specificity) / 2 AS balanced_accuracy, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, recall + specificity - 1 AS youden_j"""


@query("evc3_threshold_scores", f"""WITH {LINES_SQL}, c AS (SELECT dataset, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp,
 count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM lines GROUP BY dataset),
 r AS (SELECT *, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS specificity FROM c),
 a AS (SELECT dataset, tp, fp, fn, tn, {_RATES} FROM r)
 SELECT dataset, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(youden_j, 6) AS youden_j FROM a""")
def _(spark, d):
    return rounded(M.confusion(line_predictions(spark, d), by=["dataset"]))


@query("evc5_brier_log_loss", f"""WITH {PRED_SQL}, c AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS k FROM pred)
 SELECT dataset, seed, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-y * ln(k) - (1 - y) * ln(1 - k)), 6) AS log_loss FROM c GROUP BY ALL""")
def _(spark, d):
    return rounded(M.probability_scores(predictions(spark, d), by=["dataset", "seed"]))


_EDGES = " + ".join(f"(CASE WHEN p > {i / 10!r} THEN 1 ELSE 0 END)" for i in range(1, 10))


def _ece_sql(bin_: str) -> str:
    return f"""WITH {LINES_SQL}, b AS (SELECT dataset, {bin_} AS bin, count(*) AS n, avg(p) AS c, avg(y::DOUBLE) AS a FROM lines GROUP BY ALL)
 SELECT dataset, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b GROUP BY dataset"""


@query("evc7_ece_right_closed", _ece_sql(_EDGES))
def _(spark, d):
    return rounded(M.ece(line_predictions(spark, d), by=["dataset"]))


@query("evc8_ece_left_closed", _ece_sql("least(floor(p * 10), 9)"))
def _(spark, d):
    return rounded(M.ece(line_predictions(spark, d), right_closed=False, by=["dataset"]))


@query("evc9_reliability_bins", f"""WITH {PRED_SQL}, g AS (SELECT DISTINCT dataset FROM pred), b AS (SELECT dataset, {_EDGES} AS bin, count(*) AS n, avg(p) AS c, avg(y::DOUBLE) AS a FROM pred GROUP BY ALL)
 SELECT g.dataset, r.bin, coalesce(b.n, 0)::BIGINT AS count, round(b.c, 6) AS mean_confidence, round(b.a, 6) AS accuracy FROM g CROSS JOIN (SELECT unnest(range(10)) AS bin) r LEFT JOIN b ON b.dataset = g.dataset AND b.bin = r.bin""")
def _(spark, d):
    return rounded(M.reliability(predictions(spark, d), by=["dataset"]))


_LABEL = "CASE WHEN pf >= po AND pf >= pp THEN 'F' WHEN po >= pp THEN 'O' ELSE 'P' END"


@query("evc10_multiclass_scores", f"""WITH {MULTI_SQL}, l AS (SELECT y, {_LABEL} AS label FROM multi),
 e AS (SELECT c, count(*) FILTER (y = c) AS support, count(*) FILTER (label = c) AS said, count(*) FILTER (y = c AND label = c) AS tp FROM l, (SELECT unnest(['F', 'O', 'P']) AS c) GROUP BY c),
 r AS (SELECT *, coalesce(tp / nullif(said, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS r FROM e), f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM r)
 SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS weighted_precision, round(avg(p), 6) AS macro_precision, round(sum(r * support) / sum(support), 6) AS weighted_recall,
 round(avg(r), 6) AS macro_recall, round(sum(f * support) / sum(support), 6) AS weighted_f1, round(avg(f), 6) AS macro_f1 FROM f""")
def _(spark, d):
    m = multiclass(spark, d)
    label = F.when((F.col("pf") >= F.col("po")) & (F.col("pf") >= F.col("pp")), "F").when(F.col("po") >= F.col("pp"), "O").otherwise("P")
    return rounded(M.multiclass_scores(m.withColumn("label", label)))


_LONG = "long AS (SELECT y, 'F' AS c, pf AS p FROM multi UNION ALL SELECT y, 'O', po FROM multi UNION ALL SELECT y, 'P', pp FROM multi)"


@query("evc11_one_vs_rest_auc", f"""WITH {MULTI_SQL}, {_LONG}, s AS (SELECT c, p, count(*) FILTER (y = c) AS pos, count(*) FILTER (y <> c) AS neg FROM long GROUP BY ALL),
 w AS (SELECT *, sum(neg) OVER (PARTITION BY c ORDER BY p) - neg AS below FROM s), a AS (SELECT c, sum(pos) AS support, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE AS auc FROM w GROUP BY c)
 SELECT round(avg(auc), 6) AS macro_ovr_auc, round(sum(auc * support) / sum(support), 6) AS weighted_ovr_auc FROM a""")
def _(spark, d):
    return rounded(M.one_vs_rest(multiclass(spark, d), "y", CLASSES))


@query("evc12_one_vs_one_auc", f"""WITH {MULTI_SQL}, {_LONG}, o AS (SELECT l.c AS a, b.b, l.p, CASE WHEN l.y = l.c THEN 1 ELSE 0 END AS t FROM long l, (SELECT unnest(['F', 'O', 'P']) AS b) b WHERE b.b <> l.c AND l.y IN (l.c, b.b)),
 s AS (SELECT a, b, p, sum(t) AS pos, sum(1 - t) AS neg FROM o GROUP BY ALL), w AS (SELECT *, sum(neg) OVER (PARTITION BY a, b ORDER BY p) - neg AS below FROM s),
 u AS (SELECT a, b, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE AS auc FROM w GROUP BY ALL) SELECT round(avg(auc), 6) AS ovo_auc FROM u""")
def _(spark, d):
    return rounded(M.one_vs_one(multiclass(spark, d), "y", CLASSES))


@query("evc13_multiclass_brier", f"""WITH {MULTI_SQL} SELECT round(avg(power(pf - (y = 'F')::INT, 2) + power(po - (y = 'O')::INT, 2) + power(pp - (y = 'P')::INT, 2)), 6) AS brier FROM multi""")
def _(spark, d):
    return rounded(M.multiclass_brier(multiclass(spark, d), "y", CLASSES))


@query("evr1_regression_scores", f"""WITH {REG_SQL} SELECT dataset, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(1 - sum((p - y) * (p - y)) / (count(*) * var_pop(y)), 6) AS r2,
 round(CASE WHEN min(least(y, p)) >= 0 THEN sqrt(avg(power(ln(1 + greatest(p, 0)) - ln(1 + greatest(y, 0)), 2))) END, 6) AS rmsle,
 round(CASE WHEN min(y) >= 0 THEN sqrt(avg(power(ln(1 + greatest(p, 0)) - ln(1 + greatest(y, 0)), 2))) END, 6) AS rmsle_clipped FROM reg GROUP BY dataset""")
def _(spark, d):
    return rounded(M.regression_scores(regression(spark, d), by=["dataset"]))


@query("evr3_interval_scores", f"""WITH {REG_SQL}, i AS (SELECT dataset, y, p - 20000 AS lo, p + 20000 AS hi FROM reg)
 SELECT dataset, round(avg((y >= lo AND y <= hi)::INT), 6) AS picp, round(avg(hi - lo), 6) AS mpiw, round(avg(hi - lo) / (max(y) - min(y)), 6) AS pinaw, round(abs(avg((y >= lo AND y <= hi)::INT) - 0.9), 6) AS coverage_error FROM i GROUP BY dataset""")
def _(spark, d):
    reg = regression(spark, d).withColumn("lo", F.col("p") - 20000).withColumn("hi", F.col("p") + 20000)
    return rounded(M.interval_scores(reg, "y", "lo", "hi", 0.1, ["dataset"]))


@query("fid1_teacher_student", f"""WITH {PRED_SQL} SELECT dataset, round(corr(p, q), 6) AS pearson, round(avg(abs(q - p)), 6) AS mae, round(sqrt(avg((q - p) * (q - p))), 6) AS rmse FROM pred GROUP BY dataset""")
def _(spark, d):
    return rounded(M.fidelity(predictions(spark, d), "p", "q", ["dataset"]))


@query("win7_spearman", f"""WITH {PRED_SQL}, r AS (SELECT dataset, rank() OVER (PARTITION BY dataset ORDER BY p) + (count(*) OVER (PARTITION BY dataset, p) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY dataset ORDER BY q) + (count(*) OVER (PARTITION BY dataset, q) - 1) / 2.0::DOUBLE AS b FROM pred) SELECT dataset, round(corr(a, b), 6) AS spearman FROM r GROUP BY dataset""")
def _(spark, d):
    return rounded(M.spearman(predictions(spark, d), "p", "q", ["dataset"]))


_C = "least(greatest({0}, 1e-6), 1 - 1e-6)"


@query("fid2_js_divergence", f"""WITH {PRED_SQL}, c AS (SELECT dataset, {_C.format('p')} AS p, {_C.format('q')} AS q FROM pred), m AS (SELECT *, (p + q) / 2 AS m FROM c)
 SELECT dataset, round(avg((p * ln(p / m) + (1 - p) * ln((1 - p) / (1 - m)) + q * ln(q / m) + (1 - q) * ln((1 - q) / (1 - m))) / 2), 6) AS js FROM m GROUP BY dataset""")
def _(spark, d):
    return rounded(predictions(spark, d).groupBy("dataset").agg(F.avg(M.js_divergence(F.col("p"), F.col("q"))).alias("js")))


@query("fid3_nrmse", f"""WITH {REG_SQL} SELECT dataset, round(sqrt(avg((q - p) * (q - p))) / stddev_pop(y), 6) AS nrmse FROM reg GROUP BY dataset""")
def _(spark, d):
    e = F.col("q") - F.col("p")
    return rounded(regression(spark, d).groupBy("dataset").agg(F.try_divide(F.sqrt(F.avg(e * e)), F.stddev_pop("y")).alias("nrmse")))


def _overlap_sql(k: str) -> str:
    return f"""WITH {PRED_SQL}, n AS (SELECT {k} AS k FROM pred), a AS (SELECT row_id, row_number() OVER (ORDER BY p DESC, row_id) AS ra, row_number() OVER (ORDER BY q DESC, row_id) AS rb FROM pred)
 SELECT round(count(*) FILTER (ra <= k AND rb <= k) / any_value(k)::DOUBLE, 6) AS top_overlap FROM a, n"""


@query("top2_top_overlap_round", _overlap_sql("floor(count(*) * 0.1 + 0.5)"))
def _(spark, d):
    return rounded(M.top_overlap(predictions(spark, d), "p", "q", "row_id"))


@query("top2_top_overlap_ceil", _overlap_sql("ceil(count(*) * 0.1)"))
def _(spark, d):
    return rounded(M.top_overlap(predictions(spark, d), "p", "q", "row_id", up=True))


_CUST = "cust AS (SELECT c_nationkey % 5 AS truth, c_custkey % 7 AS a, (c_custkey % 7 + (CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)) % 7 AS b, c_mktsegment AS dataset FROM customer)"


def _labels(spark, d):
    bump = F.when(F.col("c_acctbal") < 0, 1).otherwise(0)
    return table(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("truth"), (F.col("c_custkey") % 7).alias("a"), ((F.col("c_custkey") % 7 + bump) % 7).alias("b"), F.col("c_mktsegment").alias("dataset"))


_LABEL_SQL = f"""WITH {_CUST}, cells AS (SELECT dataset, a, b, count(*) AS n FROM cust GROUP BY ALL), r AS (SELECT dataset, a, sum(n) AS m FROM cells GROUP BY ALL), c AS (SELECT dataset, b, sum(n) AS m FROM cells GROUP BY ALL),
 t AS (SELECT dataset, sum(n)::DOUBLE AS t, sum(n * (n - 1) / 2.0::DOUBLE) AS s FROM cells GROUP BY dataset),
 x AS (SELECT dataset, t, s, (SELECT sum(m * (m - 1) / 2.0::DOUBLE) FROM r WHERE r.dataset = t.dataset) AS sa, (SELECT sum(m * (m - 1) / 2.0::DOUBLE) FROM c WHERE c.dataset = t.dataset) AS sb,
 (SELECT -sum(m / t.t * ln(m / t.t)) FROM r WHERE r.dataset = t.dataset) AS ha, (SELECT -sum(m / t.t * ln(m / t.t)) FROM c WHERE c.dataset = t.dataset) AS hb, (SELECT -sum(n / t.t * ln(n / t.t)) FROM cells WHERE cells.dataset = t.dataset) AS hab FROM t)
 SELECT dataset, round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round((ha + hb - hab) / ((ha + hb) / 2), 6) AS nmi, round((t * (t - 1) / 2 + 2 * s - sa - sb) / (t * (t - 1) / 2), 6) AS rand FROM x"""


@query("evk1_label_scores", _LABEL_SQL)
def _(spark, d):
    return rounded(M.label_scores(M.contingency(_labels(spark, d), "a", "b", ["dataset"]), "a", "b", by=["dataset"]))


@query("evk9_label_match", f"WITH {_CUST} SELECT dataset, round(avg((a = b)::INT), 6) AS match FROM cust GROUP BY dataset")
def _(spark, d):
    return rounded(_labels(spark, d).groupBy("dataset").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("match")))


@query("agg17_contingency", f"WITH {_CUST} SELECT truth::BIGINT AS truth, a::BIGINT AS a, count(*) AS n FROM cust GROUP BY ALL")
def _(spark, d):
    return rounded(M.contingency(_labels(spark, d), "truth", "a"))


def score_card(spark, d):
    """All binary metrics of the scored line items by dataset: rank metrics, threshold rates, losses and calibration, joined."""
    lines, by = line_predictions(spark, d), ["dataset"]
    card = M.roc_auc(lines, by=by)
    for part in (M.average_precision(lines, by=by), M.confusion(lines, by=by), M.probability_scores(lines, by=by), M.ece(lines, by=by)):
        card = card.join(part, "dataset")
    return rounded(card)


def _joined_sql(names: list[str]) -> str:
    """The rows of several queries by dataset, side by side."""
    parts = [f"({ORACLE_SQL[n]}) AS q{i}" for i, n in enumerate(names)]
    return "SELECT * FROM " + parts[0] + "".join(f" JOIN {p} USING (dataset)" for p in parts[1:])


_LOSSES = f"WITH {LINES_SQL}, k AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS c FROM lines) SELECT dataset, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-y * ln(c) - (1 - y) * ln(1 - c)), 6) AS log_loss FROM k GROUP BY dataset"
query("score_card", _joined_sql(["evc1_roc_auc", "evc2_average_precision", "evc3_threshold_scores", "evc7_ece_right_closed"]) + f" JOIN ({_LOSSES}) AS losses USING (dataset)")(score_card)
