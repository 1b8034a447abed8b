"""Gaussian mixtures with full, diagonal, tied or spherical covariances: expectation-maximisation by aggregation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import written

KINDS = ("full", "diag", "tied", "spherical")


@dataclass(frozen=True)
class Mixture:
    """weights (k), means (k, d) and covariances (k, d, d) over `features`; history: the mean log likelihood before each step."""

    features: list[str]
    kind: str
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    history: list[float]

    def log_densities(self) -> list[Column]:
        """Each component's weighted log density of a row."""
        out = []
        for weight, mean, cov in zip(self.weights, self.means, self.covariances, strict=True):
            root = np.linalg.inv(np.linalg.cholesky(cov))  # of the precision
            away = [F.col(f) - float(m) for f, m in zip(self.features, mean, strict=True)]
            squares = F.lit(0.0)
            for i, row in enumerate(root):
                terms = [away[j] * float(row[j]) for j in range(i + 1) if row[j] != 0]
                squares = squares + F.pow(sum(terms[1:], terms[0]), F.lit(2.0))
            constant = np.log(weight) + np.log(np.diag(root)).sum() - len(mean) / 2 * np.log(2 * np.pi)
            out.append(F.lit(float(constant)) - squares / 2)
        return out

    def responsibilities(self, df: DataFrame) -> DataFrame:
        """df with _r0, _r1, ... and _log, a row's log likelihood; a row far from all components has no zero sums."""
        k = len(self.weights)
        out = df.select("*", *[d.alias(f"_l{c}") for c, d in enumerate(self.log_densities())])
        out = out.withColumn("_top", F.greatest(*[F.col(f"_l{c}") for c in range(k)]) if k > 1 else F.col("_l0"))
        out = out.select("*", *[F.exp(F.col(f"_l{c}") - F.col("_top")).alias(f"_e{c}") for c in range(k)])
        out = out.withColumn("_sum", sum((F.col(f"_e{c}") for c in range(1, k)), F.col("_e0")))
        return out.select(*df.columns, *[(F.col(f"_e{c}") / F.col("_sum")).alias(f"_r{c}") for c in range(k)], (F.col("_top") + F.log("_sum")).alias("_log"))

    def transform(self, df: DataFrame, label: str = "label") -> DataFrame:
        """df with the most responsible component, the first of several, and log_likelihood."""
        r = [F.col(f"_r{c}") for c in range(len(self.weights))]
        found = self.responsibilities(df)
        return found.select(*df.columns, (F.array_position(F.array(*r), F.greatest(*r) if len(r) > 1 else r[0]) - 1).cast("int").alias(label), F.col("_log").alias("log_likelihood"))


def _maximised(rows: DataFrame, features: list[str], kind: str, centres: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means, covariances and the mean of _log from rows with _r0, ...: one aggregation of sums about the given centres."""
    k, d = centres.shape
    pairs = [(i, j) for i in range(d) for j in range(i + 1) if kind in ("full", "tied") or i == j]
    away = [[F.col(f) - float(centres[c, i]) for i, f in enumerate(features)] for c in range(k)]
    r = [F.col(f"_r{c}") for c in range(k)]
    sums = {"log": F.avg("_log"), "n": F.count("*").cast("double")}
    for c in range(k):
        sums[f"n{c}"] = F.sum(r[c])
        sums |= {f"a{c}_{i}": F.sum(r[c] * away[c][i]) for i in range(d)}
    for i, j in pairs:
        each = [r[c] * away[c][i] * away[c][j] for c in range(k)]
        sums |= {f"s{c}_{i}_{j}": F.sum(x) for c, x in enumerate(each)} if kind != "tied" else {f"s_{i}_{j}": F.sum(sum(each[1:], each[0]))}
    got = rows.agg(*[x.alias(n) for n, x in sums.items()]).first()
    n = np.array([max(got[f"n{c}"], 1e-12) for c in range(k)])
    shift = np.array([[got[f"a{c}_{i}"] for i in range(d)] for c in range(k)]) / n[:, None]

    def square(name: str) -> np.ndarray:
        out = np.zeros((d, d))
        for i, j in pairs:
            out[i, j] = out[j, i] = got[f"{name}_{i}_{j}"]
        return out

    if kind == "tied":
        whole = square("s") - np.einsum("c,ci,cj->ij", n, shift, shift)
        cov = np.tile(whole / n.sum(), (k, 1, 1))
    else:
        cov = np.stack([square(f"s{c}") / n[c] for c in range(k)]) - np.einsum("ci,cj->cij", shift, shift)
    if kind in ("diag", "spherical"):
        cov = np.stack([np.diag(np.diag(x)) if kind == "diag" else np.eye(d) * np.trace(x) / d for x in cov])
    return n / n.sum(), centres + shift, cov + ridge * np.eye(d), got["log"]


def fit_mixture(df: DataFrame, features: list[str], k: int, kind: str = "full", seed: int = 42, max_iter: int = 100, tolerance: float = 1e-3, ridge: float = 1e-6, start: Mixture | None = None) -> Mixture:
    """A mixture of k components, from a k-means start or the given one, until a step adds less than tolerance to the mean log likelihood.

    Rows with a null or non-finite feature are left out. Every step is one aggregation over the rows; only sums reach the
    driver: k (1 + d + d (d + 1) / 2) of them at most. A covariance is kept positive by `ridge` on its diagonal.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")
    finite = [F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf")) for f in features]
    rows = written(df.select(*[F.col(f).cast("double").alias(f) for f in features]).where(sum_all(finite)), "mixture-rows")
    if start is None:
        vectors = VectorAssembler(inputCols=features, outputCol="_v").transform(rows)
        labelled = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(vectors).transform(vectors) if k > 1 else vectors.withColumn("_c", F.lit(0))
        hard = labelled.select(*features, *[(F.col("_c") == c).cast("double").alias(f"_r{c}") for c in range(k)], F.lit(0.0).alias("_log"))
        middle = np.array(rows.agg(*[F.avg(f) for f in features]).first(), float)
        weights, means, cov, _ = _maximised(hard, features, kind, np.tile(middle, (k, 1)), ridge)
        start = Mixture(features, kind, weights, means, cov, [])
    model = start
    for _ in range(max_iter):
        weights, means, cov, log = _maximised(model.responsibilities(rows), features, kind, model.means, ridge)
        done = bool(model.history) and log - model.history[-1] < tolerance
        model = Mixture(features, kind, weights, means, cov, [*model.history, log])
        if done:
            break
    return model


def sum_all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
