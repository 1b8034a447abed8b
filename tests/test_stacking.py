"""Many logistic fits at once, the full stack, and stored predictions."""

import numpy as np
import pytest
from pyspark.ml import classification as MC
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import models as L
from tessera.operators import newton, stacking, store


@pytest.fixture(scope="module")
def task(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.3)))).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, y int, a double, b double, c double").withColumn("weight", F.lit(1.0))
    df = L.assembled(df, ["a", "b", "c"]).repartition(4).cache()
    return x, y, df.where("row_id < 300"), df.where("row_id >= 300")


def dense(x, y, s, ridge):
    x, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    free = np.append(np.ones(x.shape[1] - 1), 0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        g, h = x.T @ (s * (p - y)) + ridge * free * w, (x * (s * p * (1 - p))[:, None]).T @ x + ridge * np.diag(free)
        w = w - np.linalg.solve(h, g)
    return w


def test_many_fits_equal_each_alone(task):
    x, y, fit, _ = task
    cols = [F.col(c) for c in "abc"]
    shares = [F.lit(1.0), (F.col("row_id") % 3 != 0).cast("double"), F.when(F.col("y") == 1, 3.0).otherwise(0.5)]
    found = newton.fit_logistics(fit, cols, F.col("y"), shares, [0.1, 5.0, 100.0])
    weights = [np.ones(300), (np.arange(300) % 3 != 0) * 1.0, np.where(y[:300] == 1, 3.0, 0.5)]
    for g, s in enumerate(weights):
        for c, ridge in enumerate([0.1, 5.0, 100.0]):
            assert np.allclose(found[g, c], dense(x[:300], y[:300], s, ridge), atol=1e-6)
    # rows that a line tells apart: the penalty keeps the coefficients finite
    apart = newton.fit_logistics(fit.withColumn("y", (F.col("a") > 0).cast("int")), cols, F.col("y"), [F.lit(1.0)], [0.01])
    assert np.isfinite(apart).all() and apart[0, 0, 0] > 3


class Raises:
    def fit(self, df):
        raise RuntimeError("cannot be fitted")


class RaisesOnAll:
    """Fits folds, not the whole."""

    def fit(self, df):
        if df.count() >= 300:
            raise RuntimeError("too many rows")
        return L.classifiers(1)["logistic"].fit(df)


def test_stack_drops_bases_and_names_them(task):
    _, _, fit, test = task
    pool = {"bad": Raises(), "logistic": L.classifiers(1)["logistic"], "late": RaisesOnAll(), "tree": L.classifiers(1)["tree"]}
    found = stacking.stack_binary(pool, fit, test, "row_id", k=3, repeats=2, seed=1)
    assert found.names == ["logistic", "tree"] and [n for n, _ in found.dropped] == ["bad", "late"] and "cannot be fitted" in found.dropped[0][1]
    told = {r.row_id: (r.p, r.label) for r in found.predictions.collect()}
    assert len(told) == 100 and all(0 < p < 1 and label == (p >= found.threshold) for p, label in told.values())
    again = stacking.stack_binary(pool, fit, test.withColumn("y", 1 - F.col("y")), "row_id", k=3, repeats=2, seed=1)
    assert {r.row_id: r.p for r in again.predictions.collect()} == pytest.approx({i: p for i, (p, _) in told.items()}, abs=1e-9)
    scores = found.scores().first()
    assert scores["auc"] > 0.7 and scores["accuracy"] > 0.6
    search = {r.c: r for r in found.search.collect()}
    assert list(sorted(search)) == list(stacking.STRENGTHS) and search[found.strength].accuracy == max(r.accuracy for r in search.values())
    plain = stacking.stack_binary({"logistic": pool["logistic"]}, fit, test, "row_id", k=3, repeats=1, calibrate=False, optimise="log_loss", balanced=True)
    assert plain.scores().first()["auc"] > 0.7
    with pytest.raises(ValueError, match="bad"):
        stacking.stack_binary({"bad": Raises()}, fit, test, "row_id", k=3)
    with pytest.raises(ValueError):
        L.fit_pool({"bad": Raises()}, fit, test, ["row_id"])
    log = []
    assert L.fit_pool(pool | {"late": Raises()}, fit, test, ["row_id", "y"], log).select("model").distinct().count() == 2 and len(log) == 2
    assert L.stack({"bad": Raises(), "tree": pool["tree"]}, fit, test, "row_id", k=3).count() == 100


def test_stored_predictions_are_not_fitted_again(spark, task, tmp_path, monkeypatch):
    _, _, fit, test = task
    pool = {"logistic": MC.LogisticRegression(regParam=0.1, featuresCol="features", labelCol="y"), "tree": L.classifiers(1)["tree"], "bad": Raises()}
    first = store.PredictionStore(str(tmp_path))
    rows = first.predictions(pool, fit, {"val": test, "train": fit}, "row_id")
    assert sorted(first.fitted) == ["logistic", "tree"] and [n for n, _ in first.failed] == ["bad"]
    told = sorted(map(tuple, rows.collect()))
    assert len(told) == 800
    fits = []
    monkeypatch.setattr(MC.LogisticRegression, "fit", lambda self, df: fits.append(self))
    again = store.PredictionStore(str(tmp_path))
    assert sorted(map(tuple, again.predictions({n: pool[n] for n in ("logistic", "tree")}, fit.repartition(7), {"train": fit, "val": test}, "row_id").collect())) == told
    assert again.fitted == [] and fits == []
    monkeypatch.undo()
    for other in (
        again.predictions({"logistic": pool["logistic"].copy().setRegParam(0.2)}, fit, {"val": test}, "row_id"),
        again.predictions({"logistic": pool["logistic"]}, fit.where("row_id <> 3"), {"val": test}, "row_id"),
    ):
        assert other.count() == 100
    assert again.fitted == ["logistic", "logistic"]
    table = {(r.model, r.split): r for r in store.classification_candidates(rows).collect()}
    assert table.keys() == {(m, s) for m in ("logistic", "tree") for s in ("val", "train")}
    assert table["logistic", "val"].auc == pytest.approx(M.roc_auc(rows.where("model = 'logistic' and split = 'val'")).first()[0])
    assert store.regression_candidates(rows).count() == 4


def test_a_table_cut_off_is_made_again(spark, task, tmp_path):
    _, _, fit, test = task
    pool = {"tree": L.classifiers(1)["tree"]}
    store.PredictionStore(str(tmp_path)).predictions(pool, fit, {"val": test}, "row_id")
    (mark,) = tmp_path.glob("*/_SUCCESS")
    mark.unlink()
    again = store.PredictionStore(str(tmp_path))
    assert again.predictions(pool, fit, {"val": test}, "row_id").count() == 100 and again.fitted == ["tree"]


def test_binary_scores_equal_each_alone(task):
    _, _, fit, test = task
    told = L.fit_pool({"m": L.classifiers(1)["tree"]}, fit, test, ["row_id", "y"]).withColumn("p", F.round("p", 1)).cache()
    got = {r.metric: r.value for r in M.binary_scores(told, threshold=0.4).collect()}
    wanted = {}
    for part in (M.roc_auc(told), M.average_precision(told), M.probability_scores(told), M.ece(told), M.confusion(told, threshold=0.4).drop("tp", "fp", "fn", "tn")):
        wanted |= part.first().asDict()
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k]) for k in wanted)


def test_wide_scores_equal_the_pivoted_ones(task, monkeypatch):
    _, _, fit, test = task
    pool = {"tree": L.classifiers(1)["tree"], "bad": Raises(), "logistic": L.classifiers(1)["logistic"]}
    log = []
    told = {r.row_id: (r.y, r.tree, r.logistic) for r in L.out_of_fold_wide(pool, fit, "row_id", 3, 1, log=log).collect()}
    long = L.wide(L.out_of_fold({n: pool[n] for n in ("tree", "logistic")}, fit, "row_id", 3, 1), "row_id", ["tree", "logistic"])
    assert len(told) == 300 and [n for n, _ in log] == ["bad"]
    for r in long.collect():
        assert told[r.row_id] == pytest.approx((r.y, r.tree, r.logistic))


def test_stacks_pivot_no_rows(task, monkeypatch):
    _, _, fit, test = task

    def pivoted(*a):
        raise AssertionError("every row of every model is shuffled")

    monkeypatch.setattr(L, "wide", pivoted)
    pool = {"late": RaisesOnAll(), "tree": L.classifiers(1)["tree"], "logistic": L.classifiers(1)["logistic"]}
    assert L.stack(pool, fit, test, "row_id", k=3, tune=False).where("p between 0 and 1").count() == 100
    assert L.stack_regression({n: L.regressors(1)[n] for n in ("ridge", "huber")}, fit, test, "row_id", k=3).select("row_id").distinct().count() == 100
