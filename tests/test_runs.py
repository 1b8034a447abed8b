"""Log files, keyed tables, own models, soft students and principal components against plain versions."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import distill as D
from tessera.operators import models as L
from tessera.operators.encode import principal_components
from tessera.operators.user_models import fit_groups
from tessera.sources import logs as G
from tessera.streaming.keyed import KeyedTable, merge_stream

LOG = """Dataset: alpha
AUC: 0.1
【配置1: plain 】
准确率: 0.75
AUC： 0.8
RMAE: 9
【配置2: other】
Accuracy: 91.5  F1 Score: .5
auc: 0.95
Recall: N/A
=====

Total experiment time: 3
AUC: 0.99
"""


def test_logs_become_tables(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.log").write_text(LOG, encoding="utf-8")
    (tmp_path / "deep" / "b.log").write_text("stacking\nacc: 0.5\nauc: 0.6\n", encoding="utf-8")
    (tmp_path / "c.log").write_text("", encoding="utf-8")
    (tmp_path / "d.log").write_text("AUC: nan\n", encoding="utf-8")
    (tmp_path / "skip.txt").write_text(LOG, encoding="utf-8")
    logs = G.read_logs(spark, str(tmp_path))
    found = {(r.path.split("/")[-1], r.block): r for r in G.log_metrics(logs, "classification").collect()}
    assert set(found) == {("a.log", 1), ("a.log", 2), ("b.log", 0)}
    one, two, whole = found["a.log", 1], found["a.log", 2], found["b.log", 0]
    assert (one.configuration, one.acc, one.auc, one.f1) == ("plain", 75.0, 80.0, None) and (two.configuration, two.acc, two.auc, two.f1, two.recall) == ("other", 91.5, 95.0, 50.0, None)
    assert (whole.configuration, whole.acc, whole.auc) == ("whole", 50.0, 60.0)
    regression = G.log_metrics(spark.createDataFrame([("x", "RMAE: 1 R2: 0.5 mae: 2e1 RMSE: -3.")], "path string, text string"), "regression").first()
    assert (regression.mae, regression.r2, regression.rmse) == (20.0, 0.5, -3.0)
    best = G.best_block(G.log_metrics(logs, "classification"), "classification", ["path"])
    assert {(r.path.split("/")[-1], r.block, r.parsed) for r in best.collect()} == {("a.log", 2, 2), ("b.log", 0, 1)}
    status = G.status_rows([
        (spark.createDataFrame([(1, "C:\\runs\\a.log", "completed"), (2, None, "failed")], "job_no int, stdout string, state string"), "v1", {"job": "job_no", "log": "stdout", "status": "state"}),
        (spark.createDataFrame([("3", "alpha", "/x/b.log")], "job string, dataset string, log string"), "v2", {}),
    ])
    rows = {r.job: r for r in G.joined_metrics(status, best).collect()}
    assert (rows["1"].auc, rows["1"].status, rows["1"].version) == (95.0, "completed", "v1") and rows["2"].auc is None and (rows["3"].auc, rows["3"].dataset) == (60.0, "alpha")
    repeated = G.repeated_metrics(logs.where(F.col("path").endswith("a.log")), {"auc": ["AUC"], "acc": ["准确率", "Accuracy"]}).collect()
    assert {(r.metric, r.place, r.value) for r in repeated} == {("auc", 1, 0.1), ("auc", 2, 0.8), ("auc", 3, 0.95), ("auc", 4, 0.99), ("acc", 1, 0.75), ("acc", 2, 91.5)}


def newest(rows):
    out = {}
    for k, t, v in rows:
        if k not in out or (t is not None, t or 0, v) > (out[k][0] is not None, out[k][0] or 0, out[k][1]):
            out[k] = (t, v)
    return out


def test_keyed_table_keeps_the_newest_whatever_is_replayed(spark, tmp_path):
    rng = random.Random(1)
    batches = [[(rng.randrange(30), rng.choice([None, *range(50)]), 1000 * n + i) for i in range(80)] for n in range(9)]
    frame = lambda rows: spark.createDataFrame(rows, "key int, t int, v int")
    table = KeyedTable(spark, str(tmp_path / "t"), ["key"], ["t", "v"], compact_after=4)
    for n in (0, 1, 2, 1, 3, 4, 0, 4, 5, 6, 7, 8, 3, 8):  # replays before and after their compaction
        table.merge(frame(batches[n]), n)
    wanted = newest([r for b in batches for r in b])
    assert {r.key: (r.t, r.v) for r in table.read().collect()} == wanted
    held = table.pointer()
    assert held["version"] == 1 and held["batch"] == 7 and table._names(r"batch-(\d+)") == [8]
    (tmp_path / "t" / "pointer-7.json").write_text('{"version": 7, "ba')  # a pointer cut off, and a base without its mark, are not there
    (tmp_path / "t" / "batch-99").mkdir()
    again = KeyedTable(spark, str(tmp_path / "t"), ["key"], ["t", "v"], compact_after=4)
    assert {r.key: (r.t, r.v) for r in again.read().collect()} == wanted
    again.merge(frame(batches[0]).limit(0), 9)
    assert again.compact() == 2 and again.compact() == 2 and {r.key: (r.t, r.v) for r in again.read().collect()} == wanted
    assert KeyedTable(spark, str(tmp_path / "none"), ["key"], ["t"]).pointer() == {"version": -1, "batch": -1}
    keys = KeyedTable(spark, str(tmp_path / "keys"), ["key"], ["key"])
    keys.merge(frame(batches[0]).select("key"), 0)
    assert keys.read().count() == len({k for k, _, _ in batches[0]})


def test_stream_restarts_give_the_batch_result(spark, tmp_path):
    rows = [(i % 7, i, i * 10) for i in range(300)]
    for n in range(6):
        spark.createDataFrame(rows[n::6], "key int, t int, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(3):  # each run is a new query from the checkpoint; the last has nothing to do
        stream = spark.readStream.schema("key int, t int, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        table = KeyedTable(spark, str(tmp_path / "out"), ["key"], ["t"], compact_after=2)
        merge_stream(stream, table, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert {r.key: (r.t, r.v) for r in KeyedTable(spark, str(tmp_path / "out"), ["key"], ["t"]).read().collect()} == newest(rows)


def own_models():
    """Two models of a user's own, defined here so that they travel to the tasks by value."""

    class Means:
        """The mean of y by the sign of the first feature."""

        def fit(self, x, y):
            if len(y) < 3:
                raise ValueError("too few rows")
            self.by = y.groupby(x["a"] > 0).mean()

        def predict_proba(self, x):
            p = (x["a"] > 0).map(self.by).fillna(0.5).to_numpy()
            return np.stack([1 - p, p], axis=1)

    class Level:
        def fit(self, x, y):
            self.level = float(y.mean())

        def predict(self, x):
            return [self.level] * len(x)

    return Means, Level


def test_own_models_by_group(spark):
    Means, Level = own_models()
    rng = np.random.default_rng(3)
    rows = [(g, s, i, float(rng.normal()), float(rng.integers(0, 2)), "fit" if i % 3 else "val") for g, n in (("x", 60), ("y", 300), (None, 30), ("z", 3)) for s in (1, 2) for i in range(n)]
    df = spark.createDataFrame(rows, "dataset string, seed int, row_id long, a double, y double, split string").repartition(5)
    told, log = fit_groups(df, ["dataset", "seed"], "row_id", ["a"], Means)
    got = {(r.dataset, r.seed, r.row_id): r.p for r in told.collect()}
    for g, n in (("x", 60), ("y", 300), (None, 30)):
        for s in (1, 2):
            fit = [r for r in rows if r[0] == g and r[1] == s and r[5] == "fit"]
            mean = {side: np.mean([r[4] for r in fit if (r[3] > 0) == side]) for side in (True, False)}
            val = [r for r in rows if r[0] == g and r[1] == s and r[5] == "val"]
            assert all(got[g, s, r[2]] == pytest.approx(mean[r[3] > 0]) for r in val)
    assert not any(k[0] == "z" for k in got) and {(r.dataset, r.way, r.error is None, r.rows) for r in log.collect()} == {("x", "task", True, 60), ("y", "task", True, 300), (None, "task", True, 30), ("z", "task", False, 3)}
    level, _ = fit_groups(df, ["dataset", "seed"], "row_id", ["a"], Level)
    assert level.where("dataset = 'x' and seed = 1").select("p").distinct().count() == 1
    # groups beyond the bound are tables of their own
    told, log = fit_groups(df, ["dataset", "seed"], "row_id", ["a"], Level, lambda: LogisticRegression(labelCol="y"), most_bytes=8 * 3 * 100)
    assert {(r.dataset, r.way) for r in log.collect()} == {("x", "task"), ("y", "table"), (None, "task"), ("z", "task")}
    assert told.where("dataset = 'y'").count() == 200 and told.where("dataset = 'y'").select("p").distinct().count() > 2
    with pytest.raises(ValueError, match="estimator"):
        fit_groups(df, ["dataset", "seed"], "row_id", ["a"], Level, most_bytes=100)


def test_soft_students_follow_the_teacher(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 2))
    z = np.stack([x[:, 0], x[:, 1], -x.sum(axis=1)], axis=1)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = [int(rng.choice(3, p=row)) for row in p]
    df = spark.createDataFrame([(i, y[i], [float(v) for v in x[i]], [float(v) for v in p[i]]) for i in range(900)], "row_id long, y int, v array<double>, p array<double>").withColumn("features", array_to_vector("v")).cache()
    fit, val = df.where("row_id < 150"), df.where("row_id >= 150")
    teacher = df.select("row_id", "p")
    told = lambda m: L.class_probabilities(m, val, ["row_id", "y"], 3).withColumnRenamed("p", "s").join(teacher.select("row_id", F.col("p").alias("t")), "row_id")
    hard, soft = D.distillation_losses(told(D.hard_student(fit)), 1.0).first(), D.distillation_losses(told(D.soft_student(teacher, fit, "row_id", 3, temperature=1.0, share=1.0)), 1.0).first()
    assert soft.kd < hard.kd and soft.squared < hard.squared
    rows = told(D.hard_student(fit)).collect()
    t, s = (np.clip(np.array([r[c] for r in rows]), 1e-6, 1 - 1e-6) for c in "ts")
    soften = lambda q: (lambda e: e / e.sum(axis=1, keepdims=True))(np.exp(np.log(q) / 3))
    kd = 9 * (soften(t) * np.log(soften(t) / soften(s))).sum(axis=1).mean()
    got = D.distillation_losses(told(D.hard_student(fit)), 3.0, 0.25).first()
    assert got.kd == pytest.approx(kd) and got.squared == pytest.approx(((t - s) ** 2).mean()) and got.hard == pytest.approx(-np.log([r.s[r.y] for r in rows]).mean()) and got.blend == pytest.approx(0.75 * got.hard + 0.25 * got.kd)
    _, share, losses = D.chosen_student(teacher, fit, val, "row_id", 3, temperature=1.0)
    table = {r.share: r.squared for r in losses.collect()}
    assert share == min(table, key=table.get) == 0.9 and len(table) == 3


def test_principal_components_equal_a_decomposition(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 7)) + 0.05 * rng.normal(size=(300, 7)) + 5
    x[:, 6] = 2.0  # constant
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "row_id long, v array<double>").withColumn("features", F.when(F.col("v").isNotNull(), array_to_vector("v")))
    got = {r.row_id: r.features for r in principal_components(df)(df).collect()}
    assert got.pop(999) is None
    y = x - x.mean(axis=0)
    std = x.std(axis=0, ddof=1)
    y = np.divide(y, std, out=np.zeros_like(y), where=std > 1e-12)
    _, s, v = np.linalg.svd(y, full_matrices=False)
    many = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.95) + 1)
    v = v[:many].T
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(many)])
    assert np.allclose(np.array([got[i].toArray() for i in range(300)]), y @ v, atol=1e-8) and many < 6
