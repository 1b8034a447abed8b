"""Consensus cuts, mixtures and light clusterers against dense versions in NumPy."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import batches, consensus, mixtures
from tessera.operators import models as L
from tessera.operators.metrics import contingency, label_scores


def ari(spark, a, b):
    frame = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a int, b int")
    return label_scores(contingency(frame, "a", "b"), "a", "b").first()["ari"]


@pytest.fixture(scope="module")
def labelings():
    rng = random.Random(3)
    truth = {i: i % 3 for i in range(200)}
    long = [(name, i, (t + shift) % 3 if rng.random() > noise else rng.randrange(3)) for name, shift, noise in (("a", 0, 0.1), ("b", 1, 0.2), ("c", 2, 0.15), ("d", 0, 0.3)) for i, t in truth.items()]
    return truth, long


def dense_walk(long, k):
    names = sorted({c for c, _, _ in long})
    labels = np.array([[x for c, _, x in sorted(r for r in long if r[0] == n)] for n in names])
    s = np.mean([row[:, None] == row[None, :] for row in labels], axis=0)
    d = s.sum(axis=1)
    value, vector = np.linalg.eigh(s / np.sqrt(d[:, None] * d[None, :]))
    top = np.argsort(-value)[:k]
    return vector[:, top] / np.sqrt(d)[:, None], value[top]


def test_coassociation_places_equal_the_dense_eigenvectors(spark, labelings):
    _, long = labelings
    frame = spark.createDataFrame(long, "candidate string, row_id long, label int").repartition(5)
    rows, placed = consensus.coassociation_embedding(frame, 3)
    got = {r.row_id: r.features for r in rows.join(placed, "cells").collect()}
    mine, (wanted, value) = np.array([got[i] for i in range(200)]), dense_walk(long, 3)
    assert value[0] == pytest.approx(1) and np.ptp(value) > 0.01
    for j in range(3):  # eigenvectors up to their sign
        assert min(np.abs(mine[:, j] - s * wanted[:, j]).max() for s in (1, -1)) < 1e-9


def test_coassociation_cut(spark, labelings):
    truth, long = labelings
    frame = spark.createDataFrame(long + [("flat", i, 7) for i in truth], "candidate string, row_id long, label int").repartition(5)
    got = {r.row_id: r.label for r in consensus.coassociation_cut(frame).collect()}
    assert got.keys() == truth.keys() and set(got.values()) == {0, 1, 2} and ari(spark, list(truth.values()), [got[i] for i in truth]) > 0.9
    assert consensus.coassociation_cut(frame, k=2).select("label").distinct().count() == 2
    with pytest.raises(ValueError):
        consensus.coassociation_cut(frame.where("candidate in ('a', 'flat')"))
    with pytest.raises(ValueError):
        consensus.coassociation_embedding(frame, 3, most_cells=5)


def numpy_step(x, model, kind, ridge):
    logs = []
    for w, m, c in zip(model.weights, model.means, model.covariances, strict=True):
        y = x - m
        logs.append(np.log(w) - 0.5 * (np.einsum("ni,ij,nj->n", y, np.linalg.inv(c), y) + np.linalg.slogdet(2 * np.pi * c)[1]))
    logs = np.array(logs).T
    top = logs.max(axis=1)
    total = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
    r = np.exp(logs - total[:, None])
    n, d = r.sum(axis=0), x.shape[1]
    means = (r.T @ x) / n[:, None]
    cov = np.array([((r[:, c, None] * (x - means[c])).T @ (x - means[c])) / n[c] for c in range(len(n))])
    if kind == "tied":
        cov = np.tile(np.einsum("c,cij->ij", n, cov) / n.sum(), (len(n), 1, 1))
    if kind == "diag":
        cov = np.array([np.diag(np.diag(c)) for c in cov])
    if kind == "spherical":
        cov = np.array([np.eye(d) * np.trace(c) / d for c in cov])
    return n / n.sum(), means, cov + ridge * np.eye(d), total.mean()


@pytest.mark.parametrize("kind", mixtures.KINDS)
def test_mixture_steps_equal_numpy(spark, kind):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(m, s, (100, 3)) for m, s in ((0, 1), (6, 0.5), ([8, -4, 1], 2))])
    rows = [(float(a), float(b), float(c)) for a, b, c in x] + [(None, 1.0, 1.0), (float("nan"), 0.0, 0.0), (float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(4)
    start = mixtures.fit_mixture(df, ["a", "b", "c"], 3, kind, max_iter=0)
    model = mixtures.fit_mixture(df, ["a", "b", "c"], 3, kind, max_iter=6, tolerance=-1.0, start=start)
    weights, means, cov = start.weights, start.means, start.covariances
    for got in model.history:
        weights, means, cov, log = numpy_step(x, mixtures.Mixture([], kind, weights, means, cov, []), kind, 1e-6)
        assert got == pytest.approx(log, abs=1e-9)
    assert np.allclose(model.weights, weights) and np.allclose(model.means, means) and np.allclose(model.covariances, cov)
    assert all(b >= a - 1e-9 for a, b in zip(model.history, model.history[1:])) and len(model.history) == 6
    labelled = model.transform(df.where("a is not null and not isnan(a) and a < 1e300")).collect()
    assert ari(spark, np.argmin(((x[:, None, :] - means[None]) ** 2).sum(axis=2), axis=1), [r.label for r in sorted(labelled, key=lambda r: [tuple(v) for v in x].index((r.a, r.b, r.c)))]) > 0.9
    assert mixtures.fit_mixture(df, ["a", "b", "c"], 1, kind).weights.tolist() == [1.0]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    x = np.round(np.vstack([rng.normal(m, 0.6, (500, 5)) for m in (0, 4, 9, -6)]) * 64) / 64  # sums of these are exact
    rows = [(i, [float(v) for v in row], int(i // 500)) for i, row in enumerate(x)]
    df = spark.createDataFrame([*rows, (9999, None, 0)], "row_id long, v array<double>, truth int").repartition(7)
    return x, df.withColumn("features", F.when(F.col("v").isNotNull(), array_to_vector("v")))


def test_entries_hold_every_row_once(blobs):
    x, df = blobs
    for threshold, most in ((0.5, 2000), (0.5, 30), (0.0, 100)):
        entries = batches.feature_entries(df, threshold, most).collect()
        assert len(entries) <= most and sum(e.n for e in entries) == len(x)
        assert np.array_equal(np.sum([e.sums for e in entries], axis=0), x.sum(axis=0)) and sum(e.squares for e in entries) == (x**2).sum()
    assert batches.feature_entries(df.limit(0)).count() == 0


def test_trees_split_and_grow_their_threshold():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 3, (3000, 2)) * 16) / 16
    for most in (10, 100, 5000):
        tree = batches.FeatureTree(2, 0.1, most, branching=4)
        for p in x:
            tree.insert(1.0, p, float((p**2).sum()))
        held = list(tree.leaves())
        assert len(held) == tree.entries <= most and sum(n for n, _, _ in held) == 3000 and np.array_equal(sum(s for _, s, _ in held), x.sum(axis=0))
        assert all(q / n - ((s / n) ** 2).sum() <= tree.threshold**2 + 1e-9 for n, s, q in held)
    same = batches.FeatureTree(1, 0.0, 3, branching=2)
    for v in [1.0, 2.0, 1.0, 3.0, 4.0, 5.0] * 5:
        same.insert(1.0, np.array([v]), v * v)
    assert sum(n for n, _, _ in same.leaves()) == 30


def test_light_clusterers_find_the_blobs(spark, blobs):
    _, df = blobs
    df = df.where("features is not null")
    for model in (batches.Birch(4).fit(df), batches.MiniBatchKMeans(4, batch_rows=300, steps=8).fit(df), batches.MiniBatchKMeans(4, batch_rows=10**6, steps=3).fit(df)):
        rows = model.transform(df).select("truth", "label").collect()
        assert ari(spark, [r.truth for r in rows], [r.label for r in rows]) > 0.95


def test_minibatch_moves_by_shares(spark, blobs):
    x, df = blobs
    centres = np.array([[0.0] * 5, [4.0] * 5])
    n, sums = batches.cluster_sums(df.where("features is not null"), centres)
    of = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert n.tolist() == np.bincount(of).tolist() and np.allclose(sums, [x[of == c].sum(axis=0) for c in (0, 1)])


def test_thresholds_grow_no_further_than_they_must():
    """Points of many features are about equally far apart: at one threshold none share an entry, at twice it all do."""
    x = np.random.default_rng(3).normal(size=(1500, 64))
    tree = batches.FeatureTree(64, 0.5, most=100)
    for p in x:
        tree.insert(1.0, p, float((p**2).sum()))
    assert 50 <= tree.entries <= 100 and sum(n for n, _, _ in tree.leaves()) == pytest.approx(1500)
    for v in (1.0, 0.0):  # the same point over and over, and two of them
        tree = batches.FeatureTree(1, 0.0, most=1)
        for i in range(20):
            tree.insert(1.0, np.array([v * (i % 2)]), v * (i % 2))
        assert tree.entries == 1


def test_light_clusterers_of_fewer_rows_than_clusters(spark):
    rng = np.random.default_rng(3)
    wide = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(5000, 64)))], "row_id long, v array<double>").repartition(4)
    wide = wide.select("row_id", array_to_vector("v").alias("features"))
    found = batches.Birch(10).fit(wide)
    assert len(found.centres) > 500 and len(set(found.labels)) == 10 and wide.count() == found.transform(wide).where("label between 0 and 9").count()
    few = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(90)], "row_id long, v array<double>").select("row_id", array_to_vector("v").alias("features"))
    for model in (batches.Birch(10).fit(few), batches.MiniBatchKMeans(10).fit(few)):
        told = {r.row_id: r.label for r in model.transform(few).collect()}
        assert len(set(told.values())) == 3 and all(told[i] == told[i % 3] for i in range(90))
    far = [(i, [1e3**i, 0.0]) for i in range(12)]  # of such rows KMeans draws fewer places than it needs
    far = spark.createDataFrame(far, "row_id long, v array<double>").select("row_id", array_to_vector("v").alias("features"))
    assert batches.started(far, 10, 42).shape == (10, 2)


def test_teacher_candidates_of_many_features(spark, monkeypatch):
    """Every size has a row a candidate, on points that are about equally far apart."""
    monkeypatch.setattr(L, "clusterers", lambda k, seed: {})
    x = np.random.default_rng(3).normal(size=(5000, 64))
    df = spark.createDataFrame([(int(i % 7), [float(v) for v in row]) for i, row in enumerate(x)], "truth int, v array<double>").repartition(4).select("truth", array_to_vector("v").alias("features")).cache()
    told = L.teacher_candidates(df, df, "truth", [10, 12], 42).collect()
    assert {(r.candidate, r.k) for r in told} == {(c, k) for c in ("minibatch", "birch") for k in (10, 12)} and all(r.rand > 0.5 for r in told)
