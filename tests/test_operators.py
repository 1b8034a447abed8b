"""Edge cases with hand-computed results, and properties of fitted models."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import calibration as C
from tessera.operators import cluster as K
from tessera.operators import encode as E
from tessera.operators import metrics as M
from tessera.operators import models as L
from tessera.operators import split as S
from tessera.sources import files
from tessera.spec import TaskSpec


def test_task_spec_checks_metric_and_constraints():
    assert TaskSpec("classification", "d").primary_metric == "auc"
    with pytest.raises(ValueError):
        TaskSpec("regression", "d", "auc")
    with pytest.raises(ValueError):
        TaskSpec("clustering", "d", constraints={"nope": 1})


def test_auc_ties_single_class_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.9), ("a", 0, 0.1), ("b", 1, 0.3), ("b", 1, 0.4)], "g string, y int, p double")
    assert {r.g: r.auc for r in M.roc_auc(df, by=["g"]).collect()} == {"a": 0.75, "b": None}
    assert M.roc_auc(df.limit(0)).first().auc is None


def test_bin_edges_differ_between_the_two_eces(spark):
    df = spark.createDataFrame([(i / 10,) for i in range(11)], "p double")
    right = [r[0] for r in df.select(M.right_closed_bin("p").alias("b")).collect()]
    left = [r[0] for r in df.select(M.left_closed_bin("p").alias("b")).collect()]
    assert right == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert left == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]


@pytest.mark.parametrize("n,want", [(9, 9.0), (10, 10.0), (11, 10.0)])
def test_conformal_takes_the_higher_order_statistic(spark, n, want):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, n + 1)], "g string, r double")
    assert C.conformal(df, "r", 0.1, ["g"]).first().qhat == want


def test_labels_identical_permuted_and_trivial(spark):
    def scores(pairs):
        df = spark.createDataFrame(pairs, "a int, b int")
        return M.label_scores(M.contingency(df, "a", "b"), "a", "b").first()

    assert scores([(0, 1), (0, 1), (1, 0), (1, 0)]).ari == 1.0
    assert scores([(0, 0), (0, 0), (0, 0)]).nmi == 1.0
    assert scores([(0, 0), (0, 1), (1, 0), (1, 1)]).ari < 0


def test_optimal_alignment_is_one_to_one_and_best(spark):
    cells = spark.createDataFrame([("x", 0, 0, 5), ("x", 0, 1, 4), ("x", 1, 0, 4), ("x", 1, 1, 0), ("x", 2, 1, 1)], "g string, l long, r long, n long")
    got = {r.l: r.aligned for r in K.align_optimal(cells, "g", "l", "r").collect()}
    assert got == {0: 1, 1: 0, 2: 2}


def test_encoding_unknown_missing_and_padding(spark):
    fit = spark.createDataFrame([("b ",), ("a",), (None,)], "c string")
    df = spark.createDataFrame([(1, "a"), (2, " b"), (3, None), (4, "z")], "i int, c string")
    assert {r.i: r.c for r in E.encode(fit, df, ["c"]).collect()} == {1: 1, 2: 2, 3: 0, 4: -1}


def test_splits_are_exact_whatever_the_partitioning(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    one, two = (S.stratified_split(x, "y", 0.2, 42, "id").where("split = 'test'") for x in (df.coalesce(1), df.repartition(7)))
    assert {r.id for r in one.collect()} == {r.id for r in two.collect()}
    assert one.where("y = 1").count() == 20
    single = spark.createDataFrame([(i, int(i == 0)) for i in range(10)], "id long, y int")
    assert S.stratified_split(single, "y", 0.2, 42, "id").where("split = 'test'").count() == 2
    folds = [r["count"] for r in S.k_fold(df, 3, 1, "id", "y").groupBy("fold").count().collect()]
    assert sum(folds) == 1000 and max(folds) - min(folds) <= 2


def test_stack_never_sees_test_labels(spark):
    rows = [(i, (i * 37 % 100) / 50 - 1, (i * 53 % 100) / 50 - 1) for i in range(160)]
    df = L.assembled(spark.createDataFrame(rows, "row_id long, a double, b double").withColumn("y", (F.col("a") + 0.3 * F.col("b") > 0).cast("int")), ["a", "b"])
    fit, test = S.class_weight(df.where("row_id < 120"), "y"), df.where("row_id >= 120")
    pool = {n: m for n, m in L.classifiers(1).items() if n in ("logistic", "tree")}
    first = {r.row_id: r.p for r in L.stack(pool, fit, test, "row_id").collect()}
    flipped = {r.row_id: r.p for r in L.stack(pool, fit, test.withColumn("y", 1 - F.col("y")), "row_id").collect()}
    assert flipped == pytest.approx(first, abs=1e-9) and all(0 <= p <= 1 for p in first.values())  # sums come in any order


def test_isotonic_is_monotone(spark):
    df = spark.createDataFrame([(i / 50, int((i * 7) % 10 < i / 5)) for i in range(50)], "p double, y int")
    values = [r.calibrated for r in C.isotonic(df, "y", "p").orderBy("p").collect()]
    assert values == sorted(values)


def test_csv_round_trip_types_and_bundle(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,y\n1,x,0\n2,,1\n3,z,\n")
    df, spec = files.task_csv(spark, str(tmp_path / "t.csv"))
    assert df.count() == 2 and spec.target == "y" and spec.categorical == ("b",) and dict(df.dtypes)["a"] == "double"
    assert files.csv_or_empty(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    manifest = files.write_bundle({"t": df}, str(tmp_path / "bundle"))
    assert manifest.first().rows == 2
    files.append_rows(df, str(tmp_path / "p"))
    files.append_rows(df.withColumn("more", F.lit(1)), str(tmp_path / "p"))
    assert spark.read.option("mergeSchema", True).parquet(str(tmp_path / "p")).count() == 4
    assert files.checksums(spark, str(tmp_path), "*.csv").count() == 1
