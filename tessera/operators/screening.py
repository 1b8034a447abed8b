"""Which generated features to keep: a statistic and a model's importances, joined or intersected, with a least number."""

from __future__ import annotations

import math

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.encode import finite, numeric_frame, quantile_row
from tessera.operators.features import f_test, mutual_information, split_gain
from tessera.operators.models import assembled, importances


def quantile_edges(df: DataFrame, names: list[str], bins: int = 10) -> dict[str, list[float]]:
    """Distinct inner quantiles of each column, exact, one pass for all."""
    levels = [i / bins for i in range(1, bins)]
    found = quantile_row(df, {n: finite(n) for n in names}, levels).first()["_q"]
    return {n: sorted(set(found.get(n) or [])) for n in names}


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    some = lambda v: v if abs(v) > 1e-300 else 1e-300
    above, below = 1.0, 1 / some(1 - (a + b) * x / (a + 1))
    value = below
    for m in range(1, 100_000):
        steps = (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        for step in steps:
            below, above = 1 / some(1 + step * below), some(1 + step / above)
            value *= below * above
        if abs(below * above - 1) < 1e-15:
            break
    return front * value


def f_p_value(f: float | None, n: int) -> float:
    """How likely a univariate regression of n rows has an F of f and more by chance; 1 without a value."""
    if f is None or math.isnan(f) or n < 3:
        return 1.0
    return beta_share((n - 2) / 2, 0.5, (n - 2) / (n - 2 + f)) if math.isfinite(f) else 0.0


def screened(df: DataFrame, names: list[str], target: str, task: str, top_k: int = 5, min_keep: int = 1, selection: str = "intersection", p_threshold: float = 0.05, variance_threshold: float = 1e-3, bins: int = 10) -> list[str]:
    """Names to keep, at most top_k, best by the statistic first.

    classification: the top_k by mutual information over quantile bins; regression: those whose F test is below
    p_threshold, or the least one; both against the top_k by a forest's importance. `selection` is intersection or union;
    if fewer than min_keep remain, the model's come first, then the statistic's. clustering: the top_k by the gain of a
    cut in two among those of more than variance_threshold. Text counts as codes, nulls and non-finite values as 0; ties go
    by name; a target of text is coded.
    """
    if selection not in ("intersection", "union"):
        raise ValueError(f"unknown selection {selection!r}")
    if not names:
        return []
    most = min(top_k, len(names))
    x = numeric_frame(df.select(*names, *([target] if task != "clustering" else [])))
    if task == "clustering":
        spread = x.agg(*[F.var_samp(n).alias(n) for n in names]).first()
        kept = [n for n in names if (spread[n] or 0) > variance_threshold]
        gains = {r["name"]: r["gain"] or 0.0 for r in split_gain(x.select(*[F.col(n).cast("double").alias(n) for n in kept]), kept).collect()} if kept else {}  # names
        return sorted(kept, key=lambda n: (-gains.get(n, 0.0), n))[:most]
    x = x.withColumn("y", F.col(target).cast("double"))
    if task == "classification":
        scores = {r["name"]: r["mi"] for r in mutual_information(x, names, "y", quantile_edges(x, names, bins)).collect()}
        statistic = sorted(names, key=lambda n: (-scores.get(n, 0.0), n))[:most]
        weight = importances(x, names)
    elif task == "regression":
        n = x.count()
        p = {r["name"]: f_p_value(r["f"], n) for r in f_test(x, names, "y").collect()}
        statistic = [v for v in names if p[v] < p_threshold] or [min(names, key=lambda v: (p[v], v))]
        forest = RandomForestRegressor(numTrees=20, maxDepth=5, seed=42, featuresCol="features", labelCol="y").fit(assembled(x, names))
        weight = dict(zip(names, forest.featureImportances.toArray().tolist(), strict=True))
    else:
        raise ValueError(f"unknown task {task!r}")
    model = sorted(names, key=lambda v: (-weight[v], v))[:most]
    kept = list(dict.fromkeys([*statistic, *model])) if selection == "union" else [v for v in statistic if v in model]
    if len(kept) < min_keep:
        kept = list(dict.fromkeys([*model, *statistic]))[:min_keep]
    return kept[:most]
