"""Feature screens, log targets and grouped running operators against plain versions."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tessera.operators import features as P
from tessera.operators import models as L
from tessera.operators import screening as S


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    rows = [(i, float(x[i, 0]), float(x[i, 1]), float(x[i, 2]), ["low", "high"][int(x[i, 3] > 0)], int(x[i, 0] + 0.3 * x[i, 1] > 0), float(3 * x[i, 1] + 0.1 * x[i, 2] + rng.normal()), 1.0) for i in range(400)]
    rows[3] = (3, float("nan"), None, *rows[3][3:])
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, t string, y int, z double, flat double").repartition(4)


def test_screens(table):
    names = ["a", "b", "c", "t", "flat"]
    both, either = (S.screened(table, names, "y", "classification", 2, 1, s) for s in ("intersection", "union"))
    assert both[0] == either[0] == "a" and set(both) <= set(either) and len(either) == 2
    assert S.screened(table, names, "z", "regression", 3, 1)[0] == "b" and "flat" not in S.screened(table, names, "z", "regression", 3, 1)
    # nothing below the threshold: the least p value stays; fewer than min_keep: the model's come first
    assert len(S.screened(table, ["flat", "a"], "z", "regression", 2, 2, p_threshold=0.0)) == 2
    assert S.screened(table, ["a", "flat"], "", "clustering") == ["a"] and S.screened(table, [], "y", "classification") == []
    for bad in ({"selection": "both"}, {"task": "ranking"}):
        with pytest.raises(ValueError):
            S.screened(table, names, "y", **({"task": "classification"} | bad))


def test_quantile_edges_and_p_values(table):
    edges = S.quantile_edges(table, ["a", "flat"], 4)
    a = [r.a for r in table.where("not isnan(a)").select("a").collect()]
    assert edges["a"] == pytest.approx(np.quantile(a, [0.25, 0.5, 0.75]).tolist()) and edges["flat"] == [1.0]
    # two degrees of freedom by hand; many near the normal distribution
    assert S.f_p_value(4.0, 4) == pytest.approx(1 - math.sqrt(4 / (4 + 2)))
    assert S.f_p_value(3.841458820694124, 10**7) == pytest.approx(0.05, abs=1e-6) and S.f_p_value(6.6348966, 10**7) == pytest.approx(0.01, abs=1e-6)
    assert S.f_p_value(0.0, 100) == pytest.approx(1) and S.f_p_value(1e9, 100) < 1e-100 and S.f_p_value(None, 5) == 1 and S.f_p_value(math.inf, 9) == 0
    t = [S.f_p_value(x, 12) for x in np.linspace(0, 50, 200)]
    assert all(b < a for a, b in zip(t, t[1:]))


def test_log_targets(table):
    df = L.assembled(table.where("row_id <> 3"), ["a", "c"]).withColumn("y", F.expm1("a"))
    pool = L.with_log_targets({"line": LinearRegression(labelCol="y"), "other": LinearRegression(labelCol="y")}, 1)
    told = {(r.model, r.row_id): (r.y, r.p) for r in L.fit_pool(pool, df, df, ["row_id", "y"]).collect()}
    error = {m: np.mean([abs(y - p) for (n, _), (y, p) in told.items() if n == m]) for m in pool}
    assert set(pool) == {"line", "other", "log1p_line"} and error["log1p_line"] < 0.01 * error["line"] == 0.01 * error["other"]


def test_running_products_and_average_ranks(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), int(k), float(rng.choice([-2.0, 0.5, 1.5, 3.0]) if k != 40 or g else 0.0), float(v) if v < 5 else None) for g in range(3) for k, v in enumerate(rng.integers(0, 6, 60))]
    df = spark.createDataFrame(rows, "g int, k int, x double, v double").repartition(5)
    got = {(r.g, r.k): r.p for r in P.running_product(df, "x", ["g"], "k", "p").collect()}
    ranks = {(r.g, r.k): r.r for r in P.average_rank(df, "v", ["g"], "r").collect()}
    assert len(got) == len(ranks) == len(rows)
    for g in range(3):
        product = 1.0
        for _, k, x, v in sorted(r for r in rows if r[0] == g):
            product *= x
            assert got[g, k] == pytest.approx(product)
            others = [r[3] for r in rows if r[0] == g and r[3] is not None]
            assert ranks[g, k] == (None if v is None else sum(o < v for o in others) + (sum(o == v for o in others) + 1) / 2)
