"""Queries that fit models: candidates, stacking, distillation, clustering, screening, and the flagship flow."""

from __future__ import annotations

from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import calibration as C
from tessera.operators import features as P
from tessera.operators import metrics as M
from tessera.operators import models as L
from tessera.operators.encode import encode
from tessera.operators.named_models import named
from tessera.operators.screening import screened
from tessera.operators.split import class_weight, k_fold, stratified_split, three_way_split
from tessera.operators.stacking import stack_binary
from tessera.operators.store import PredictionStore, classification_candidates
from tessera.plans.base import query, table
from tessera.sources.shared import fresh_dir, written

BASE = ["price", "customer", "month", "priority"]


def order_task(spark, d) -> DataFrame:
    """Orders as a binary task: is the status F? Row id, four features and their strongest interaction."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 1000).alias("customer"))
    t = o.join(c, "o_custkey", "left").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 100000).alias("price"),
        F.coalesce("customer", F.lit(0.0)).alias("customer"), F.month("o_orderdate").cast("double").alias("month"), F.col("o_orderpriority").alias("priority"),
    )
    return encode(t, t, ["priority"]).withColumn("priority", F.col("priority").cast("double")).withColumn("price_month", F.col("price") * F.col("month"))


def _order_table(spark, d, weight: bool = True) -> DataFrame:
    """The order task with its split, written; the splits, of which each takes several passes, read a written table too."""
    t = written(order_task(spark, d).select("row_id", "y", *BASE), "order-task")
    return written(three_way_split(class_weight(t, "y") if weight else t, "y", 42, "row_id"), "order-parts")


def _parts_of(table_: DataFrame, features: list[str]) -> list[DataFrame]:
    parts = L.assembled(table_, features).drop(*BASE)
    return [parts.where(F.col("split") == s) for s in ("fit", "val", "test")]


def order_parts(spark, d, features=None, weight=True):
    return _parts_of(_order_table(spark, d, weight), features or BASE)


@query("mod2_candidates")
def _(spark, d):
    """Validation metrics of each classifier of the pool."""
    fit, val, _ = order_parts(spark, d)
    return L.candidate_table(L.fit_pool(L.classifiers(42), fit, val, ["row_id", "y"]), ["model"])


def _prices(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.avg("l_extendedprice").alias("e"), F.avg("l_discount").alias("dc"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1000).alias("y"), "q", "e", "dc", F.col("o_orderstatus"))
    parts = stratified_split(written(o, "prices"), "o_orderstatus", 0.25, 42, "row_id", ("fit", "test"))
    parts = L.assembled(written(parts, "price-parts"), ["q", "e", "dc"])
    return [parts.where(F.col("split") == s) for s in ("fit", "test")]


@query("mod3_regressors")
def _(spark, d):
    fit, test = _prices(spark, d)
    return M.regression_scores(L.fit_pool(L.with_log_targets(L.regressors(42)), fit, test, ["row_id", "y"]), by=["model"])


@query("mod1_tuned_forest")
def _(spark, d):
    """The balanced forest over a small grid by cross-validated F1 on fixed folds."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    fit, val, _ = order_parts(spark, d)
    forest = MC.RandomForestClassifier(numTrees=10, seed=42, featuresCol="features", labelCol="y", weightCol="weight")
    grid = ParamGridBuilder().addGrid(forest.maxDepth, [3, 5]).addGrid(forest.minInstancesPerNode, [1, 5]).build()
    folds = written(k_fold(fit, 5, 42, "row_id", "y"), "folds")
    cv = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="f1"), numFolds=5, foldCol="fold", parallelism=4)
    return M.confusion(L.scored(cv.fit(folds).bestModel, val, ["row_id", "y"]))


@query("stk1_stacking")
def _(spark, d):
    """The whole pool out of fold (five folds), and a meta model tuned over its own stratified folds."""
    fit, _, test = order_parts(spark, d)
    return L.stack(L.classifiers(42), fit, test, "row_id").select("row_id", "y", "p")


def _broken():
    """A base that raises when it is fitted."""
    return MC.LogisticRegression(featuresCol="no such column", labelCol="y")


@query("stk1_full_stack")
def _(spark, d):
    """The pool and a base that raises: test metrics at the chosen threshold, which bases were used and which dropped, and the C found in three times five folds."""
    fit, _, test = order_parts(spark, d)
    found = stack_binary(L.classifiers(42) | {"broken": _broken()}, fit, test, "row_id")
    return found.scores().withColumns({"used": F.lit(",".join(found.names)), "dropped": F.lit(",".join(n for n, _ in found.dropped)), "c": F.lit(found.strength), "threshold": F.lit(found.threshold)})


@query("stk3_stacking_regression")
def _(spark, d):
    """The whole pool of regressors, out of five folds."""
    fit, test = _prices(spark, d)
    return L.stack_regression(L.regressors(42), fit.select("row_id", "y", "features"), test, "row_id")


@query("mod5_stored_candidates")
def _(spark, d):
    """Candidates over train, validation and test from stored predictions: metrics by model and split, and whether the second look fitted anything."""
    fit, val, test = order_parts(spark, d)
    store = PredictionStore(fresh_dir(spark, "predictions"))
    parts = {"fit": fit, "val": val, "test": test}
    pool = {n: m for n, m in L.classifiers(42).items() if n in ("logistic", "tree", "forest")}
    store.predictions(pool, fit, parts, "row_id")
    again = PredictionStore(store.folder)
    found = again.predictions(pool, fit, parts, "row_id")
    return classification_candidates(found).withColumn("fitted_again", F.lit(len(again.fitted)))


@query("mod4_named_classifiers")
def _(spark, d):
    """Test metrics of every classifier that a configuration can name, a vote of nearest neighbours among them."""
    fit, _, test = order_parts(spark, d)
    names = ["SVC", "LogisticRegression", "DecisionTreeClassifier", "RandomForestClassifier", "XGBClassifier", "LGBMClassifier", "CatBoostClassifier", "BaggingClassifier", "KNeighborsClassifier"]
    return L.candidate_table(L.fit_pool(named(names), fit, test, ["row_id", "y"]), ["model"])


@query("mod4_named_regressors")
def _(spark, d):
    fit, test = _prices(spark, d)
    names = ["LinearRegression", "Ridge", "Lasso", "ElasticNet", "DecisionTreeRegressor", "RandomForestRegressor", "XGBRegressor", "LGBMRegressor", "CatBoostRegressor", "BaggingRegressor", "KNeighborsRegressor"]
    return M.regression_scores(L.fit_pool(named(names, regression=True), fit, test, ["row_id", "y"]), by=["model"])


@query("dis1_hard_labels")
def _(spark, d):
    fit, _, test = order_parts(spark, d)
    teacher = L.fit_pool({"t": L.classifiers(42)["boosted"]}, fit, fit, ["row_id", "y"])
    student = MC.DecisionTreeClassifier(maxDepth=3, featuresCol="features", labelCol="y", seed=42)
    return L.distill(teacher, student, fit, test, "row_id")


@query("dis2_regression")
def _(spark, d):
    fit, test = _prices(spark, d)
    teacher = L.fit_pool({"t": L.regressors(42)["forest"]}, fit, fit, ["row_id", "y"])
    return L.distill_regression(teacher, MR.DecisionTreeRegressor(maxDepth=4, featuresCol="features", labelCol="y", seed=42), fit, test, "row_id")


def _vectors(spark, d):
    return L.from_array(table(spark, d, "embeddings").select("vec_id", F.col("label").alias("truth"), "embedding"), "embedding")


@query("clu1_clusterers")
def _(spark, d):
    """ARI, NMI and Rand index of each clusterer against the labels."""
    v, out = _vectors(spark, d).persist(), None
    for name, estimator in L.clusterers(10, 42).items():
        cells = M.contingency(estimator.fit(v).transform(v), "truth", "label")
        row = M.label_scores(cells, "truth", "label").withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("dis5_cluster_student")
def _(spark, d):
    """How often small networks agree with the cluster labels of all rows, each row judged by the one fitted without its fold."""
    v = _vectors(spark, d)
    labelled = written(k_fold(L.clusterers(4, 42)["kmeans"].fit(v).transform(v), 3, 42, "vec_id"), "clustered")
    width, out = labelled.first()["features"].size, None
    for fold in range(3):
        student = MC.MultilayerPerceptronClassifier(layers=[width, 16, 4], seed=42, maxIter=60, featuresCol="features", labelCol="label", predictionCol="student").fit(labelled.where(F.col("fold") != fold))
        part = student.transform(labelled.where(F.col("fold") == fold)).select("label", "student")
        out = part if out is None else out.unionByName(part)
    return out.agg(F.avg((F.col("label") == F.col("student")).cast("double")).alias("agreement"), F.count("*").alias("n"))


@query("evk5_silhouette")
def _(spark, d):
    """Silhouette by squared Euclidean distance, which needs no pairs of rows."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    v = _vectors(spark, d).persist()
    rows = [(k, ClusteringEvaluator(featuresCol="features", predictionCol="label").evaluate(L.clusterers(k, 42)["kmeans"].fit(v).transform(v))) for k in (2, 4, 8)]
    return spark.createDataFrame(rows, "k int, silhouette double")


@query("fsel1_importance")
def _(spark, d):
    found = L.importances(order_task(spark, d), [*BASE, "price_month"])
    return spark.createDataFrame(list(found.items()), "name string, importance double")


@query("fsel1_screen")
def _(spark, d):
    """The features that each selection keeps of orders, by mutual information over quantile bins and a forest, and of prices, by F tests."""
    task, prices = order_task(spark, d), _prices(spark, d)[0].withColumn("noise", F.xxhash64("row_id") % 1000 / 1000)
    rows = []
    for selection in ("intersection", "union"):
        rows += [(selection, "classification", i, n) for i, n in enumerate(screened(task, [*BASE, "price_month"], "y", "classification", 3, 2, selection))]
        rows += [(selection, "regression", i, n) for i, n in enumerate(screened(prices, ["q", "e", "dc", "noise"], "y", "regression", 3, 1, selection))]
    rows += [("gain", "clustering", i, n) for i, n in enumerate(screened(prices, ["q", "e", "dc"], "y", "clustering", 2))]
    return spark.createDataFrame(rows, "selection string, task string, place int, name string")


@query("fsel5_leave_one_out")
def _(spark, d):
    """Fall of the validation auc when a feature is left out; one fit a feature, all on one written table."""
    parts, rows = _order_table(spark, d), []
    for left in (None, *BASE):
        fit, val, _ = _parts_of(parts, [f for f in BASE if f != left])
        auc = M.roc_auc(L.fit_pool({"m": L.classifiers(42)["logistic"]}, fit, val, ["row_id", "y"])).first()[0]
        rows.append((left, auc))
    whole = rows[0][1]
    return spark.createDataFrame([(n, whole - a) for n, a in rows[1:]], "name string, drop double")


def flagship(spark, d, task: DataFrame | None = None) -> DataFrame:
    """metric, value on test of the calibrated stack, and which feature route and models won on validation.

    Every classifier of the pool competes on both routes; the best two of the better route are stacked out of three folds,
    the meta model's C is searched over its own three folds, and a sigmoid fitted on validation calibrates.
    """
    routes = {"raw": BASE, "interaction": [*BASE, "price_month"]}
    routes = {r: f for r, f in routes.items() if P.within_budget(BASE, f[len(BASE) :])}
    pool = L.classifiers(42)
    task = class_weight(order_task(spark, d) if task is None else task, "y")
    for route, features in routes.items():
        task = L.assembled(task, features).withColumnRenamed("features", route)
    parts = written(three_way_split(task, "y", 42, "row_id").select("row_id", "y", "weight", "split", *routes), "routes")
    seen = lambda split, route: parts.where(F.col("split") == split).withColumn("features", F.col(route))
    fitted, _ = L.together({(route, name): (lambda r=route, e=e: e.fit(seen("fit", r))) for route in routes for name, e in pool.items()}, workers=8)
    predicted = None
    for (route, name), model in fitted.items():
        part = L.scored(model, seen("val", route), ["row_id", "y"]).select("y", "p", F.lit(route).alias("route"), F.lit(name).alias("model"))
        predicted = part if predicted is None else predicted.unionByName(part)
    scores = M.roc_auc(predicted, by=["route", "model"]).orderBy(F.col("auc").desc(), F.col("route").desc(), "model").collect()  # routes and models
    route, auc = scores[0]["route"], scores[0]["auc"]
    names = [r["model"] for r in scores if r["route"] == route][:2]
    found = stack_binary({n: pool[n] for n in names}, seen("fit", route), seen("val", route).unionByName(seen("test", route)), "row_id", k=3, repeats=1, calibrate=False, optimise="log_loss", workers=8)
    told = found.predictions.join(parts.select("row_id", "split"), "row_id")
    calibrated = written(C.platt(told.where("split = 'val'"), "y", "p", told.where("split = 'test'")).select("y", "calibrated"), "calibrated")
    told = M.binary_scores(calibrated, p="calibrated").where("metric not in ('precision', 'recall', 'youden_j')")
    return told.withColumn("route", F.lit(route)).withColumn("models", F.lit(",".join(names))).withColumn("validation_auc", F.lit(auc))


query("flagship")(flagship)
