"""Queries that SQL does not cover, over whole tables and against brute force."""

import math
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow.parquet as pq

from tessera.functions import scalar as X
from tessera.operators import cluster as K
from tessera.operators import models as L
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def test_mean_std_cells_of_every_order(spark):
    orders = {r["o_orderkey"]: r["o_custkey"] % 90 / 100 for r in pq.read_table(f"{SF}/orders.parquet").to_pylist()}
    rows = registry.QUERIES["str8_mean_std_cells_whole"](spark, SF).collect()
    assert len(rows) == len(orders) and 0 in orders.values()
    for r in rows:
        want = -orders[r.o_orderkey] or 0.0
        assert r.mean == want and math.copysign(1, r.mean) == math.copysign(1, want)
        assert r.std == (None if r.o_orderkey % 3 == 0 else 0.02)


def test_display_repair_of_every_customer(spark):
    customers = {r["c_custkey"]: r for r in pq.read_table(f"{SF}/customer.parquet").to_pylist()}
    rows = registry.QUERIES["str17_display_repair_whole"](spark, SF).collect()
    assert len(rows) == len(customers) and any(re.search(r"\.\d5$", repr(c["c_acctbal"])) for c in customers.values())
    for r in rows:
        c = customers[r.c_custkey]
        assert r.c_acctbal == float(Decimal(repr(c["c_acctbal"])).quantize(Decimal("0.1"), ROUND_HALF_UP))
        name = re.sub(r"(?<=\d)\?(?=\d)", "±", f"{c['c_nationkey']} {c['c_name']}?")
        assert r.cell.endswith(f"±{name}") and float(r.cell.split("±")[0]) == c["c_acctbal"]


def test_half_up_ties_and_the_sign_of_zero(spark):
    values = [0.25, -0.25, 0.05, -0.05, -0.04, 1.45, 2.675, 1e16]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = [r[0] for r in df.select(X.half_up("x", 1)).collect()]
    assert found == [0.3, -0.3, 0.1, -0.1, 0.0, 1.5, 2.7, 1e16] and math.copysign(1, found[4]) == 1


def test_clusters_see_the_last_places_of_a_vector(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, [0.0] * 8 + ((1 if i % 2 else -1) + 0.05 * rng.standard_normal(56)).tolist(), i % 2) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.k: r.silhouette for r in registry.QUERIES["evk5_silhouette"](spark, str(tmp_path)).collect()}[2] > 0.9
    assert registry.QUERIES["dis5_cluster_student"](spark, str(tmp_path)).first().n == 60
    labels = registry.QUERIES["clu4_principal_bins"](spark, str(tmp_path)).collect()
    assert len({(r.vec_id % 2, r.label // 2) for r in labels}) == 2


def test_principal_bins_match_svd(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    x = np.array(t["embedding"].to_pylist(), float)
    x = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    direction = np.linalg.svd(x, full_matrices=False)[2][0]
    score = x @ (direction * np.sign(direction[np.argmax(np.abs(direction))]))
    want = dict(zip(t["vec_id"].to_pylist(), np.digitize(score, np.quantile(score, [0.25, 0.5, 0.75])).tolist(), strict=True))
    found = {r.vec_id: r.label for r in registry.QUERIES["clu4_principal_bins"](spark, SF).collect()}
    assert found == want


def test_collapsed_bins_are_cut_by_rank(spark):
    rows = [(i, [float(i in (3, 5)), 0.0]) for i in range(10)]
    features = L.from_array(spark.createDataFrame(rows, "i long, x array<double>"), "x")
    found = {r.i: r.label for r in K.projection_bins(features, "i", 4).collect()}
    order = [0, 1, 2, 4, 6, 7, 8, 9, 3, 5]
    assert found == {i: label for label, part in enumerate(np.array_split(order, 4)) for i in part.tolist()}
