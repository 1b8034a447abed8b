"""Stacks, calibrators, revisions and consensus: invariants and plain versions on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import calibration as C
from tessera.operators import cluster as K
from tessera.operators import features as P
from tessera.operators import metrics as M
from tessera.operators import models as L
from tessera.operators import ranking as R
from tessera.operators import tables as T
from tessera.operators.split import class_weight, three_way_split
from tessera.plans.modelling import flagship


@pytest.fixture(scope="module")
def demo(spark):
    """240 rows of six features in two classes that an interaction tells apart."""
    rng = np.random.default_rng(42)
    x = rng.normal(size=(240, 4))
    y = (x[:, 0] * x[:, 1] + 0.8 * x[:, 2] + 0.2 * rng.normal(size=240) > 0).astype(int)
    pdf = pd.DataFrame({"row_id": range(240), "y": y, "price": x[:, 0], "customer": x[:, 2], "month": x[:, 1], "priority": x[:, 3], "price_month": x[:, 0] * x[:, 1]})
    return spark.createDataFrame(pdf)


def test_demo_reaches_its_score_and_never_sees_test_labels(spark, demo):
    rows = {r.metric: r for r in flagship(spark, None, demo).collect()}
    assert rows["auc"].value > 0.9 and rows["auc"].route == "interaction" and len(rows) == 8
    parts = three_way_split(class_weight(L.assembled(demo, ["price", "month", "customer", "price_month"]), "y"), "y", 42, "row_id")
    fit, test = parts.where("split = 'fit'"), parts.where("split = 'test'")
    pool = {"logistic": L.classifiers(42)["logistic"]}
    once = {r.row_id: r.p for r in L.stack(pool, fit, test, "row_id", k=3).collect()}
    flipped = {r.row_id: r.p for r in L.stack(pool, fit, test.withColumn("y", 1 - F.col("y")), "row_id", k=3).collect()}
    assert flipped == pytest.approx(once, abs=1e-9) and len(once) == test.count()  # sums come in any order


def test_calibrators_keep_the_order_and_mend_the_level(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=4000)
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"row_id": range(4000), "y": y, "p": 1 / (1 + np.exp(-3 * z - 1))}))
    raw = M.probability_scores(df).first()["log_loss"]
    for name, method in C.METHODS.items():
        out = method(df, "y", "p")
        loss = M.probability_scores(out, p="calibrated").first()["log_loss"]
        assert loss <= raw + 1e-9 and (name == "none" or loss < raw - 0.02)
        pairs = out.orderBy("p", "calibrated").select("p", "calibrated").toPandas()
        assert (np.diff(pairs["calibrated"]) >= -1e-12).all()
    # isotonic by pooling neighbours: the same as pooling all rows
    iso = C.isotonic(df, "y", "p").groupBy("calibrated").agg(F.avg("y").alias("m"), F.count("*").alias("n")).collect()
    assert sum(abs(r.m - r.calibrated) * r.n for r in iso) / 4000 < 1e-3
    cross = C.cross_calibrated(df, "y", "p", df, "row_id", "platt", 3)
    assert M.probability_scores(cross, p="calibrated").first()["log_loss"] < raw - 0.02
    t = C.fit_temperature(df.withColumn("z", 3 * F.log(F.col("p") / (1 - F.col("p")))), "y", "z")
    assert 0.05 <= t <= 20


def test_stacks_from_given_predictions(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 600)
    pdf = pd.DataFrame({"row_id": range(600), "y": y, "a": np.clip(y * 0.4 + rng.uniform(0, 0.6, 600), 0, 1)})
    pdf["b"], pdf["c"] = pdf["a"] * 0.99, np.clip(y * 0.3 + rng.uniform(0, 0.7, 600), 0, 1)
    df = spark.createDataFrame(pdf)
    taken, out = L.stack_cached(df, df, ["a", "b", "c"], "row_id")
    assert taken == ["a", "c"] and M.roc_auc(out).first()[0] >= M.roc_auc(df, p="a").first()[0] - 0.01
    single = L.stack_given(df, df, ["a"], "row_id").collect()
    assert {(r.row_id, r.p) for r in single} == set(zip(pdf["row_id"], pdf["a"], strict=True))
    ridge = L.stack_given(df, df, ["a", "c"], "row_id", regression=True)
    assert M.regression_scores(ridge).first()["r2"] > 0.3


def test_multiclass_stack_and_missing_class(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 360)
    pdf = pd.DataFrame({"row_id": range(360), "y": y, "u": y + rng.normal(0, 0.4, 360), "v": rng.normal(size=360)})
    df = class_weight(L.assembled(spark.createDataFrame(pdf), ["u", "v"]), "y")
    pool = {n: m for n, m in L.multiclass_pool(1).items() if n != "forest"}
    out = L.stack_multiclass(pool, df.where("row_id % 4 > 0"), df.where("row_id % 4 = 0"), "row_id", 3, k=3).collect()
    assert len(out) == 90 and all(abs(sum(r.p) - 1) < 1e-9 and len(r.p) == 3 for r in out)
    assert np.mean([r.label == r.y for r in out]) > 0.75


def test_revision_fallback_and_holdout(spark, demo):
    best, tried = L.revise({"d": 1}, [{"d": 3}, {"d": 2}, {"e": 1}], lambda p: {1: 0.5, 3: 0.7, 2: 0.6}[p["d"]] + 0.01 * p.get("e", 0))
    assert best == {"d": 3, "e": 1} and [k for _, _, k in tried] == [True, True, False, True]
    name, result, log = L.first_usable([("a", 1), ("b", 0)], lambda x: 1 / x if x != 1 else None, lambda r: r is not None, [("c", 4)])
    assert (name, result) == ("c", 0.25) and log == [("a", "unusable"), ("b", "ZeroDivisionError"), ("c", "used")]
    with pytest.raises(ValueError):
        L.first_usable([("a", 0)], lambda x: 1 / x, bool, [])
    sizes = L.repeated_holdout(demo, lambda train, val: val.count() / (train.count() + val.count()), "row_id", "y", 2, 7).collect()
    assert [r.repeat for r in sizes] == [0, 1] and all(r.score == pytest.approx(0.25, abs=0.01) for r in sizes)


def test_consensus_of_permuted_labelings(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 300)
    rows = []
    for name, shift, noise in (("a", 0, 0.05), ("b", 1, 0.1), ("c", 2, 0.15), ("d", 0, 0.9)):
        for i, v in enumerate(y):
            rows.append((name, i, int(rng.integers(0, 3)) if rng.uniform() < noise else int((v + shift) % 3)))
    long = spark.createDataFrame(rows, "candidate string, row_id long, label long")
    truth = spark.createDataFrame([(i, int(v), "val" if i % 2 else "test") for i, v in enumerate(y)], "row_id long, y long, split string")
    ranked = K.ranked_candidates(K.candidate_scores(long, truth))
    assert [c for c, _ in ranked] == ["a", "b"]
    labels = {r.row_id: r.label for r in K.consensus_top_k(long.where("candidate <> 'd'"), truth, most=None).collect()}
    assert np.mean([labels[i] == v for i, v in enumerate(y)]) > 0.95
    out = {(r.source, r.config): r.ari for r in K.output_control(long.withColumn("source", F.lit("teacher")), truth).collect()}
    assert set(c for _, c in out) == {"single", "majority", "weighted", "auto"} and out["teacher", "auto"] in [out["teacher", c] for c in ("single", "majority", "weighted")]


def test_ewm_equals_pandas_at_any_length(spark):
    rng = np.random.default_rng(7)
    rows = [(g, i, None if rng.uniform() < 0.2 else float(rng.normal())) for g, n in ((0, 900), (1, 3), (2, 1)) for i in range(n)]
    rows += [(3, i, 100.0 if i < 100 else 0.0) for i in range(200)] + [(4, 0, 1.0), (4, 1, None), (4, 2, 2.0)] + [(5, 0, None), (5, 1, 3.0)]
    df = spark.createDataFrame(rows, "g long, i long, x double")
    pdf = pd.DataFrame(rows, columns=["g", "i", "x"])
    for alpha in (0.01, 0.5, 0.99):
        want = pdf.groupby("g")["x"].transform(lambda s: s.ewm(alpha=alpha, adjust=True, ignore_na=False).mean())
        got = {(r.g, r.i): r.ewm for r in P.ewm_mean(df, "x", ["g"], ["i"], alpha).collect()}
        for g, i, w in zip(pdf["g"], pdf["i"], want, strict=True):
            assert (got[g, i] is None) if math.isnan(w) else got[g, i] == pytest.approx(w, rel=1e-9, abs=1e-12)


def test_buckets_never_decrease_and_quantiles_are_exact(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1e6, 2000), rng.uniform(0, 1, 2000), -(10.0 ** rng.uniform(-300, 300, 500)), 2.0 ** np.arange(-60, 60), [0.0, -0.0, np.inf, -np.inf, np.nan, 5e-324]])
    df = spark.createDataFrame(pd.DataFrame({"x": x})).withColumn("b", R.value_bucket("x"))
    rows = [(r.x, r.b) for r in df.orderBy("x").collect()]
    assert all(a[1] <= b[1] for a, b in zip(rows[:-1], rows[1:], strict=True))
    v = pd.DataFrame({"g": rng.integers(0, 3, 5000), "x": np.round(rng.normal(0, 50, 5000), 1)})
    got = {r.g: (r.a, r.m, r.z) for r in R.linear_quantiles(spark.createDataFrame(v), "x", {"a": 0.1, "m": 0.5, "z": 0.975}, ["g"]).collect()}
    for g, part in v.groupby("g"):
        assert got[g] == pytest.approx(tuple(part["x"].quantile([0.1, 0.5, 0.975])))
    ranked = {r.x: r["rank"] for r in R.range_rank(spark.createDataFrame(v).select("x").distinct().repartition(4), "x").collect()}
    assert ranked == {x: i for i, x in enumerate(sorted(v["x"].unique()))}
    counted = spark.createDataFrame([(float(i) / 10,) for i in range(11)], "p double").withColumn("n", R.step_count(F.col("p"), [0.2, 0.5, 0.9])).collect()
    assert [r.n for r in counted] == [0, 0, 1, 1, 1, 2, 2, 2, 2, 3, 3]


def test_best_per_group_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    best = T.best_per_group(df, ["g"], [F.desc("id")])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert {(r.g, r.id) for r in best.collect()} == {(0, 999), (1, 997), (2, 998)}


def test_dry_run_reports_every_fold(spark, demo):
    good = P.dry_run([P.Feature("q", "price * month"), P.Feature("m", group_by="y", statistic="avg(price)")], demo, "row_id", 4, 2, 1, "y").collect()
    assert len(good) == 8 and all(r.error is None for r in good) and sum(r.rows for r in good) == 480
    bad = P.dry_run([P.Feature("q", "cast(raise_error('boom') as double)")], demo, "row_id", 2).collect()
    assert len(bad) == 2 and all("boom" in r.error for r in bad)
