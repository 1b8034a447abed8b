"""Queries over whole configurations: stacking variants, calibration matrices, revisions, fallbacks and cluster consensus."""

from __future__ import annotations

from pyspark.ml import classification as MC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import calibration as C
from tessera.operators import cluster as K
from tessera.operators import ensemble as N
from tessera.operators import metrics as M
from tessera.operators import models as L
from tessera.operators.consensus import coassociation_cut
from tessera.operators.mixtures import KINDS, fit_mixture
from tessera.operators.split import class_weight, random_split, stratified_split
from tessera.plans.base import MULTI_SQL, PRED_SQL, multiclass, predictions, query, rounded, table
from tessera.plans.ensembles import PERMUTATIONS_SQL
from tessera.plans.modelling import BASE, order_parts, order_task
from tessera.sources.shared import written


def _scored(spark, d) -> tuple[DataFrame, DataFrame]:
    """Predictions p (teacher) and q (student) of orders, as (val, test) tables."""
    parts = written(random_split(predictions(spark, d), 0.5, 42, "row_id"), "predictions")
    return parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split")


@query("cal2_cross_calibrated")
def _(spark, d):
    """Brier score and log loss on test: raw, and by five calibrators a method, averaged."""
    val, test = _scored(spark, d)
    out = M.probability_scores(test).withColumn("method", F.lit("none"))
    for method in ("platt", "isotonic"):
        found = C.cross_calibrated(val, "y", "p", test, "row_id", method)
        out = out.unionByName(M.probability_scores(found, p="calibrated").withColumn("method", F.lit(method)))
    return out


_B = "avg((({0}) - y) ** 2)"
_L = "avg(-y * ln(least(greatest({0}, 1e-6), 1 - 1e-6)) - (1 - y) * ln(1 - least(greatest({0}, 1e-6), 1 - 1e-6)))"


@query("cal8_deltas", f"WITH {PRED_SQL} SELECT dataset, seed::BIGINT AS seed, round({_B.format('q')} - {_B.format('p')}, 6) AS brier_delta, round({_L.format('q')} - {_L.format('p')}, 6) AS log_loss_delta, ({_B.format('q')} < {_B.format('p')})::BIGINT AS brier_improved, ({_L.format('q')} < {_L.format('p')})::BIGINT AS log_loss_improved FROM pred GROUP BY ALL")
def _(spark, d):
    df, by = predictions(spark, d), ["dataset", "seed"]
    return rounded(C.deltas(M.probability_scores(df, by=by), M.probability_scores(df, p="q", by=by), by, ["brier", "log_loss"]))


@query("cal8_share_improved", f"WITH {PRED_SQL}, d AS (SELECT dataset, seed, {_B.format('q')} - {_B.format('p')} AS b FROM pred GROUP BY ALL) SELECT dataset, round(avg((b < 0)::INT), 6) AS brier_share, round(avg(b), 6) AS brier_delta FROM d GROUP BY dataset")
def _(spark, d):
    df, by = predictions(spark, d), ["dataset", "seed"]
    rows = C.deltas(M.probability_scores(df, by=by), M.probability_scores(df, p="q", by=by), by, ["brier"])
    return rounded(C.share_improved(rows, ["dataset"], ["brier"]))


def _matrix(spark, d) -> DataFrame:
    val, test = _scored(spark, d)
    return written(C.calibration_matrix(val, test, "y", {"teacher": "p", "student": "q"}, "row_id"), "matrix")


@query("cal10_matrix")
def _(spark, d):
    """auc, Brier score, log loss and expected calibration error of each source and calibrator."""
    long, by = _matrix(spark, d), ["source", "method"]
    return M.roc_auc(long, by=by).join(M.probability_scores(long, by=by), by).join(M.ece(long, by=by), by)


@query("cal10_matrix_bins")
def _(spark, d):
    return M.reliability(_matrix(spark, d), by=["source", "method"])


@query("mod6_revision")
def _(spark, d):
    """A tree's parameters, revised step by step: every try, its validation auc and whether it was kept."""
    fit, val, _ = order_parts(spark, d)

    def score(p):
        tree = MC.DecisionTreeClassifier(featuresCol="features", labelCol="y", weightCol="weight", seed=42, **p)
        return M.roc_auc(L.fit_pool({"m": tree}, fit, val, ["row_id", "y"])).first()[0]

    _, tried = L.revise({"maxDepth": 2, "minInstancesPerNode": 1}, [{"maxDepth": 4}, {"minInstancesPerNode": 5}, {"maxDepth": 1}], score)
    return spark.createDataFrame([(i, p["maxDepth"], p["minInstancesPerNode"], s, k) for i, (p, s, k) in enumerate(tried)], "try int, depth int, least int, auc double, kept boolean")


@query("mod8_fallback")
def _(spark, d):
    """Two candidates that can't be used, then the default: what was tried, and the default's test scores."""
    fit, _, test = order_parts(spark, d)
    common = {"labelCol": "y", "weightCol": "weight"}
    candidates = [("no such column", MC.LogisticRegression(featuresCol="missing", **common)), ("one class only", MC.DecisionTreeClassifier(featuresCol="features", maxDepth=0, **common))]
    usable = lambda out: out.agg(F.count_distinct("p")).first()[0] > 1
    build = lambda m: written(L.scored(m.fit(fit), test, ["row_id", "y"]), "candidate")
    name, out, log = L.first_usable(candidates, build, usable, [("logistic", L.classifiers(42)["logistic"])])
    tried = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(log)], "place int, candidate string, outcome string")
    return tried.join(M.roc_auc(out).withColumn("candidate", F.lit(name)), "candidate", "left")


def _status(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as a task of three classes (F, O, P as 0, 1, 2), fit and test."""
    code = F.array_position(F.array(*map(F.lit, "FOP")), F.col("o_orderstatus")).cast("int") - 1
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), code.alias("y"), (F.col("o_totalprice") / 100000).alias("price"), (F.year("o_orderdate") - 1992).cast("double").alias("year"), F.month("o_orderdate").cast("double").alias("month"))
    parts = written(stratified_split(class_weight(L.assembled(t, ["price", "year", "month"]), "y"), "y", 0.25, 42, "row_id", ("fit", "test")), "status-task")
    return parts.where("split = 'fit'"), parts.where("split = 'test'")


@query("stk4_multiclass")
def _(spark, d):
    fit, test = _status(spark, d)
    pool = {n: m for n, m in L.multiclass_pool(42).items() if n in ("logistic", "tree")}
    return L.stack_multiclass(pool, fit, test, "row_id", 3, k=3)


@query("stk5_given_predictions")
def _(spark, d):
    val, test = _scored(spark, d)
    return L.stack_given(val, test, ["p", "q"], "row_id")


@query("stk6_cached_predictions")
def _(spark, d):
    """Cached columns of which one is a near copy: which are taken, and the stack by them."""
    val, test = (x.withColumn("copy", F.col("p") * 0.999 + 0.0005).withColumn("other", 1 - F.col("q") * F.col("q")) for x in _scored(spark, d))
    taken, out = L.stack_cached(val, test, ["p", "copy", "other"], "row_id", most=2)
    return out.withColumn("taken", F.lit(",".join(taken)))


_T2 = ", ".join(f"power(greatest((p{c} + 0.5 * p{c} + 1 / 6.0::DOUBLE) / 2, 1e-6), 0.5) AS e{c}" for c in "fop")


@query("stk9_multiclass_vote", f"WITH {MULTI_SQL}, e AS (SELECT row_id, {_T2} FROM multi), s AS (SELECT row_id, ef / (ef + eo + ep) AS pf, eo / (ef + eo + ep) AS po, ep / (ef + eo + ep) AS pp FROM e) SELECT row_id, round(pf, 6) AS pf, round(po, 6) AS po, round(pp, 6) AS pp FROM s")
def _(spark, d):
    """Two models of rank 1 and 2 vote at temperature 2; a third of rank 4 has no vote."""
    m = multiclass(spark, d).select("row_id", "pf", "po", "pp")
    other = m.select("row_id", *[(F.col(c) * 0.5 + 1 / 6).alias(c) for c in ("pf", "po", "pp")])
    long = m.withColumn("rank", F.lit(1)).unionByName(other.withColumn("rank", F.lit(2))).unionByName(m.select("row_id", F.lit(1.0).alias("pf"), F.lit(0.0).alias("po"), F.lit(0.0).alias("pp"), F.lit(4).alias("rank")))
    return rounded(N.vote_multiclass(long, ["pf", "po", "pp"], "row_id", 3, 2.0).drop("label"))


@query("stk12_holdout_stack")
def _(spark, d):
    """Holdout predictions under a balanced logistic, a ridge, and a single column that passes through: one score row each."""
    val, test = _scored(spark, d)
    out = M.probability_scores(L.stack_given(val, test, ["p", "q"], "row_id")).withColumn("meta", F.lit("logistic"))
    out = out.unionByName(M.probability_scores(L.stack_given(val, test, ["p"], "row_id")).withColumn("meta", F.lit("single")))
    ridge = L.stack_given(val, test, ["p", "q"], "row_id", regression=True)
    return out.unionByName(M.probability_scores(ridge).withColumn("meta", F.lit("ridge")))


@query("stk13_configurations")
def _(spark, d):
    """The four configurations of distilled or not, calibrated or not: scores a dataset and seed, then their means."""
    val, test = _scored(spark, d)
    grid = C.calibration_matrix(val, test, "y", {"teacher": "p", "student": "q"}, "row_id", ("none", "platt")).join(test.select("row_id", "dataset", "seed"), "row_id")
    each = M.probability_scores(grid, by=["source", "method", "dataset", "seed"])
    return each.groupBy((F.col("source") == "student").alias("distilled"), (F.col("method") != "none").alias("calibrated")).agg(F.avg("brier").alias("brier"), F.avg("log_loss").alias("log_loss"), F.count("*").alias("experiments"))


@query("fsel6_with_and_without")
def _(spark, d):
    parts = order_task(spark, d)
    return L.with_and_without(written(stratified_split(parts, "y", 0.25, 42, "row_id"), "order-task"), BASE, ["price_month"], "row_id", {"dataset": "orders", "prompt": "v1"})


def _points(spark, d) -> tuple[DataFrame, DataFrame]:
    """Embeddings standardised, as (fit, val) tables with the label as truth."""
    v = L.from_array(table(spark, d, "embeddings").select("vec_id", F.col("label").alias("truth"), "embedding"), "embedding")
    parts = written(random_split(v, 0.3, 42, "vec_id"), "points")
    return parts.where("split = 'train'"), parts.where("split = 'test'")


@query("clu3_light_clusterers")
def _(spark, d):
    fit, val = _points(spark, d)
    out = None
    for name, estimator in L.light_clusterers(10, 42).items():
        row = M.label_scores(M.contingency(estimator.fit(fit).transform(val), "truth", "label"), "truth", "label").withColumn("candidate", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("clu2_mixtures")
def _(spark, d):
    """Mixtures of line items by each kind of covariance: components by size with the least and largest weight, and the mean log likelihood."""
    lines = table(spark, d, "lineitem").select((F.col("l_quantity") / 10).alias("quantity"), (F.col("l_extendedprice") / 20000).alias("price"), (F.col("l_discount") * 30).alias("discount"), (F.col("l_tax") * 40).alias("tax"))
    found = [(kind, fit_mixture(lines, lines.columns, 3, kind, max_iter=15)) for kind in KINDS]
    return spark.createDataFrame([(kind, float(m.weights.min()), float(m.weights.max()), m.history[-1], all(b >= a - 1e-9 for a, b in zip(m.history, m.history[1:]))) for kind, m in found], "kind string, least double, largest double, log_likelihood double, rises boolean")


@query("clu5_materialised")
def _(spark, d):
    """The first ranked clusterer whose labels are valid; one that gives one cluster, and one that fails, are passed over."""
    fit, val = _points(spark, d)
    broken = L.clusterers(4, 42)["kmeans"].copy().setFeaturesCol("missing")
    flat = L.clusterers(2, 42)["bisecting"].copy().setMinDivisibleClusterSize(1e9)
    label = lambda m: written(m.fit(fit).transform(val).select(F.lit("c").alias("candidate"), F.col("vec_id").alias("row_id"), "label"), "labels")
    name, out, log = L.first_usable([("broken", broken), ("flat", flat)], label, lambda x: K.valid_labelings(x).count() > 0, [("kmeans", L.clusterers(4, 42)["kmeans"])])
    tried = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(log)], "place int, candidate string, outcome string")
    return tried.join(K.valid_labelings(out).select(F.lit(name).alias("candidate"), "n", "k"), "candidate", "left")


@query("clu6_teacher_candidates")
def _(spark, d):
    fit, val = _points(spark, d)
    return L.teacher_candidates(fit, val, "truth", [4, 10], 42)


@query("enc18_raw_or_scaled")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("truth"), array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    chosen, scores = L.raw_or_scaled(written(e, "raw-vectors"), "raw", "truth", 4, 42)
    return scores.withColumn("chosen", F.col("features") == chosen)


def _truth(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), (F.col("c_nationkey") % 4).cast("long").alias("y"), F.when(F.col("c_custkey") % 3 == 0, "test").otherwise("val").alias("split"))


#: Four labelings of customers: the truth shifted, and three that leave it more and more often.
_NAMED = {"a": 2, "b": 3, "c": 5, "e": 7}


def _labelings(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    kinds = [F.struct(F.lit(n).alias("candidate"), F.when(F.col("c_custkey") % k == 0, F.col("c_custkey") % 4).otherwise((F.col("c_nationkey") + i) % 4).cast("long").alias("label")) for i, (n, k) in enumerate(_NAMED.items())]
    return c.select(F.col("c_custkey").alias("row_id"), F.explode(F.array(*kinds)).alias("x")).select("row_id", "x.*")


_LAB4 = " UNION ALL ".join(f"SELECT c_custkey AS row_id, c_nationkey % 4 AS y, '{n}' AS candidate, CASE WHEN c_custkey % {k} = 0 THEN c_custkey % 4 ELSE (c_nationkey + {i}) % 4 END AS label FROM customer" for i, (n, k) in enumerate(_NAMED.items()))


_RANKED = f"""l AS ({_LAB4}), n AS (SELECT candidate, label, y, count(*)::DOUBLE AS n FROM l GROUP BY ALL), a AS (SELECT candidate, sum(x * (x - 1) / 2) AS sa FROM (SELECT candidate, label, sum(n) AS x FROM n GROUP BY ALL) GROUP BY candidate),
 b AS (SELECT candidate, sum(x * (x - 1) / 2) AS sb FROM (SELECT candidate, y, sum(n) AS x FROM n GROUP BY ALL) GROUP BY candidate), s AS (SELECT candidate, sum(n * (n - 1) / 2) AS s, sum(n) * (sum(n) - 1) / 2 AS t FROM n GROUP BY candidate),
 ranked AS (SELECT candidate, (s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t) AS ari FROM a JOIN b USING (candidate) JOIN s USING (candidate))"""


@query("cns7_ranked_candidates", f"WITH {_RANKED} SELECT candidate, round(ari, 6) AS ari FROM ranked ORDER BY ari DESC, candidate LIMIT 2")
def _(spark, d):
    """k = max(min(4 // 2, 5), 2) = 2 of four labelings go into the consensus."""
    found = K.ranked_candidates(K.candidate_scores(_labelings(spark, d), _truth(spark, d)))
    return rounded(spark.createDataFrame(found, "candidate string, ari double"))


def _consensus_sql(most: int) -> str:
    """The aligned vote of the best `most` labelings, over all one-to-one mappings of four labels."""
    return f"""WITH {_RANKED}, taken AS (SELECT candidate, row_number() OVER (ORDER BY ari DESC, candidate) AS place FROM ranked), u AS (SELECT l.row_id, l.candidate, l.label, place FROM l JOIN taken USING (candidate) WHERE place <= {most}),
 o AS (SELECT x.candidate, x.label, y.label AS ref, count(*) AS n FROM u x JOIN u y USING (row_id) WHERE x.place > 1 AND y.place = 1 GROUP BY ALL), {PERMUTATIONS_SQL}, f AS (SELECT candidate, m, sum(n) AS f FROM o, p WHERE ref = m[label + 1] GROUP BY ALL),
 g AS (SELECT candidate, m FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY f DESC, m) AS i FROM f) WHERE i = 1), v AS (SELECT row_id, CASE WHEN place = 1 THEN label ELSE m[label + 1] END AS label, count(*) AS v FROM u LEFT JOIN g USING (candidate) GROUP BY ALL)
 SELECT row_id, label::BIGINT AS label FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY v DESC, label) AS i FROM v) WHERE i = 1"""


@query("cns7_consensus_top_k", _consensus_sql(2))
def _(spark, d):
    return K.consensus_top_k(_labelings(spark, d), _truth(spark, d))


@query("cns7_consensus_all", _consensus_sql(4))
def _(spark, d):
    return K.consensus_top_k(_labelings(spark, d), _truth(spark, d), most=None)


@query("cns6_coassociation_labels")
def _(spark, d):
    """Each customer's label by the cut of the co-association of four labelings."""
    return coassociation_cut(_labelings(spark, d))


def _sources(spark, d) -> DataFrame:
    teacher = _labelings(spark, d)
    student = teacher.withColumn("label", F.when(F.col("row_id") % 11 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label")))
    return written(teacher.withColumn("source", F.lit("teacher")).unionByName(student.withColumn("source", F.lit("student"))), "labelings")


@query("cns8_output_control")
def _(spark, d):
    return K.output_control(_sources(spark, d), _truth(spark, d))


@query("cns8_output_control_cut")
def _(spark, d):
    """The same with the co-association cut among the configurations."""
    return K.output_control(_sources(spark, d), _truth(spark, d), cut=True)
