"""Voting, stacking weights, distillation targets and candidate selection over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import softmax
from tessera.operators.ranking import linear_quantiles


def soft_vote(long: DataFrame, row_id: str = "row_id", p: str = "p") -> DataFrame:
    """Mean over models of a long table (row_id, model, p)."""
    return long.groupBy(row_id).agg(F.avg(p).alias("vote"))


def vote_multiclass(long: DataFrame, classes: list[str], row_id: str, most: int = 3, temperature: float | None = None) -> DataFrame:
    """row_id, a probability a class and label: the mean of the first `most` models by `rank`, softened by a temperature if given.

    long: row_id, rank (from 1), and a probability column a class. Ties of the label go to the class named first.
    """
    mean = long.where(F.col("rank") <= most).groupBy(row_id).agg(*[F.avg(c).alias(c) for c in classes])
    if temperature is not None:
        soft = softmax(F.array(*[F.log(F.greatest(F.col(c), F.lit(1e-6))) for c in classes]), temperature)
        mean = mean.withColumn("_s", soft).select(row_id, *[F.element_at("_s", i + 1).alias(c) for i, c in enumerate(classes)])
    top = F.greatest(*map(F.col, classes))
    return mean.withColumn("label", F.coalesce(*[F.when(F.col(c) == top, c) for c in classes]))


def normalised_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights that sum to one; negative, non-finite or all-zero weights are an error."""
    values = list(weights.values())
    if any(w < 0 or w != w or w == float("inf") for w in values) or not sum(values):
        raise ValueError("weights must be finite, not negative, and not all zero")
    return {m: w / sum(values) for m, w in weights.items()}


def weighted(weights: dict[str, float]) -> Column:
    """The weighted mean of model columns."""
    return sum((F.col(m) * w for m, w in normalised_weights(weights).items()), F.lit(0.0))


def weighted_features(df: DataFrame, weights: dict[str, float], how: str) -> DataFrame:
    """How weights enter a meta model: ignore, as_feature (a column more), scale_features, or multiply_proba."""
    w = normalised_weights(weights)
    if how == "ignore":
        return df
    if how == "as_feature":
        return df.withColumn("weighted_mean", weighted(weights))
    if how == "scale_features":
        return df.withColumns({m: F.col(m) * x * len(w) for m, x in w.items()})
    if how == "multiply_proba":
        return df.withColumns({m: F.col(m) * x for m, x in w.items()})
    raise ValueError(f"unknown weight handling {how!r}")


def inverse_rmse_weights(df: DataFrame, y: str, models: list[str]) -> dict[str, float]:
    """1 / rmse^2 of each model, normalised; one pass for all."""
    row = df.agg(*[F.avg(F.pow(F.col(m) - F.col(y), 2)).alias(m) for m in models]).first()
    return normalised_weights({m: 1 / max(row[m], 1e-12) for m in models})


def prefix_means(long: DataFrame, rank: str, by: list[str], p: str = "p") -> DataFrame:
    """For each row and k, the mean of the k best ranked models: a running mean over the rank."""
    w = Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("mean", F.avg(p).over(w)).withColumnRenamed(rank, "k")


def soft_targets(df: DataFrame, y: str, logits: Column, classes: list[str], temperature: float = 3.0, share: float = 0.5) -> DataFrame:
    """Each row once a class, with weight (1 - share) * [y = class] + share * softmax(logits / T)."""
    soft = softmax(logits, temperature)
    each = F.posexplode(F.array(*map(F.lit, classes))).alias("_i", "class")
    rows = df.withColumn("_soft", soft).select("*", each)
    weight = (1 - share) * (F.col(y) == F.col("class")).cast("double") + share * F.element_at("_soft", F.col("_i") + 1)
    return rows.withColumn("weight", weight).drop("_soft", "_i")


def delivery_ratios(df: DataFrame, teacher: str, student: str, by: list[str]) -> DataFrame:
    """Medians of a measure of both models, and how many times the student is smaller or faster."""
    out = linear_quantiles(df, teacher, {"teacher": 0.5}, by).join(linear_quantiles(df, student, {"student": 0.5}, by), by)
    return out.withColumn("factor", F.try_divide("teacher", "student"))
