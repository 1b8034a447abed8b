"""Reproducible splits, folds and samples by row hash: exact sizes, the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import hash_rank, hash_threshold


def _counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("_n"))


def random_split(df: DataFrame, test_size: float, seed: int, row_id: str) -> DataFrame:
    """df with split = test for ceil(n * test_size) rows, else train."""
    parted = hash_threshold(df, seed, row_id, F.ceil(F.col("_n") * test_size), name="_test")
    return parted.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def stratified_split(df: DataFrame, target: str, test_size: float, seed: int, row_id: str, names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Like random_split, with floor(n_c * test_size + 0.5) test rows of each class; unstratified if a class has a single row."""
    smallest = _counts(df, [target]).agg(F.min("_n")).first()[0]
    if smallest is not None and smallest < 2:
        out = random_split(df, test_size, seed, row_id)
        return out.withColumn("split", F.when(F.col("split") == "test", names[1]).otherwise(names[0]))
    parted = hash_threshold(df, seed, row_id, F.floor(F.col("_n") * test_size + 0.5), [target], "_test")
    return parted.withColumn("split", F.when(F.col("_test"), names[1]).otherwise(names[0])).drop("_test")


def three_way_split(df: DataFrame, target: str, seed: int, row_id: str, test_size: float = 0.2, val_size: float = 0.25) -> DataFrame:
    """fit, val and test: a stratified test part, then a stratified part of the rest with seed + 17."""
    first = stratified_split(df, target, test_size, seed, row_id, ("dev", "test"))
    rest = stratified_split(first.where("split = 'dev'").drop("split"), target, val_size, seed + 17, row_id, ("fit", "val"))
    return rest.unionByName(first.where("split = 'test'"))


def stratified_take(df: DataFrame, target: str, most: int, seed: int, row_id: str) -> DataFrame:
    """At most about `most` rows, each class in proportion and with one row at least; all rows if there are no more."""
    total = df.count()
    if total <= most:
        return df
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") * (most / total)))
    return hash_threshold(df, seed, row_id, quota, [target], "_taken").where("_taken").drop("_taken")


def k_fold(df: DataFrame, k: int, seed: int, row_id: str, target: str | None = None, name: str = "fold") -> DataFrame:
    """df with a fold from 0 to k - 1; with a target, each class is dealt evenly."""
    ranked = hash_rank(df, seed, row_id, [target] if target else [], "_rank")
    return ranked.withColumn(name, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def repeated_k_fold(df: DataFrame, k: int, repeats: int, seed: int, row_id: str, target: str | None = None) -> DataFrame:
    """k_fold for each repeat with seed + repeat, repeats from 0."""
    parts = [k_fold(df, k, seed + r, row_id, target).withColumn("repeat", F.lit(r)) for r in range(repeats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_rows(df: DataFrame, n: int, seed: int, row_id: str) -> DataFrame:
    """The n rows of the least hash."""
    return hash_threshold(df, seed, row_id, F.lit(n), name="_taken").where("_taken").drop("_taken")


def balanced_subsample(df: DataFrame, target: str, seed: int, row_id: str) -> DataFrame:
    """All rows of the rarest class and as many of each other class."""
    least = _counts(df, [target]).agg(F.min("_n").alias("_least"))
    ranked = hash_rank(df, seed, row_id, [target], "_rank").crossJoin(F.broadcast(least))  # one row
    return ranked.where(F.col("_rank") <= F.col("_least")).drop("_rank", "_least")


def fraction(df: DataFrame, share: float, seed: int, row_id: str) -> DataFrame:
    """Rows whose hash lies in the first `share` of its range; no ranks needed."""
    from tessera.operators.ranking import row_hash

    return df.where(row_hash(seed, row_id) < int(share * (1 << 32)))


def class_weight(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """df with the balanced weight n / (K * n_c)."""
    counts = _counts(df, [target])
    totals = counts.agg(F.sum("_n").alias("_total"), F.count("*").alias("_k"))
    weights = counts.crossJoin(F.broadcast(totals)).select(target, (F.col("_total") / (F.col("_k") * F.col("_n"))).alias(name))
    return df.join(weights, target)


