"""One call from a CSV file to a typed, encoded and split task. Whatever is fitted is fitted on the training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import encode as E
from tessera.operators.split import random_split, stratified_split
from tessera.operators.tables import class_cap, row_cap
from tessera.sources.files import description, first_path, task_csv


def _typed(spark: SparkSession, path: str, target: str | None, row_id: str) -> tuple[DataFrame, list[str], list[str], str]:
    """The table with numbers as double but the row id as it is written, its numeric and categorical features, and its target."""
    df, spec = task_csv(spark, path, target, coerce_features=False)
    features = [c for c in spec.features if c != row_id]
    df = E.coerce(df, features) if features else df
    kinds = dict(df.dtypes)
    return df, [c for c in features if kinds[c] != "string"], [c for c in features if kinds[c] == "string"], spec.target


def csv_dataset(spark: SparkSession, candidates: list[str], seed: int, test_size: float, row_id: str, target: str | None = None, described: str | None = None) -> tuple[DataFrame, int, str | None]:
    """(rows with split, number of classes, description text): the first candidate path that can be read, split by seed."""
    df, _, _, target = _typed(spark, first_path(spark, candidates), target, row_id)
    classes = df.agg(F.count_distinct(target)).first()[0]
    text = description(spark, described).select("text").first()[0] if described else None
    return random_split(df, test_size, seed, row_id), classes, text


def binary_task(spark: SparkSession, path: str, row_id: str, seed: int = 42, test_size: float = 0.2, target: str | None = None) -> DataFrame:
    """row_id, float features, int category codes, y (0 or 1) and split; more than two classes are an error.

    Numbers: null to 0. Categories: null is a category, codes are those of the training rows, others -1.
    """
    df, numeric, categorical, target = _typed(spark, path, target, row_id)
    df = df.withColumn("y", E.target_to_int(target)).where("y is not null")
    if (n := df.agg(F.count_distinct("y")).first()[0]) > 2:
        raise ValueError(f"{n} classes in a binary task")
    parts = random_split(df.select(row_id, *numeric, *categorical, "y"), test_size, seed, row_id)
    out = E.column_transform(parts.where("split = 'train'"), parts, numeric, categorical)
    return out.withColumns({c: F.col(c).cast("float") for c in numeric} | {c: F.col(c).cast("int") for c in categorical})


def multiclass_task(spark: SparkSession, path: str, row_id: str, seed: int = 42, test_size: float = 0.2, target: str | None = None) -> DataFrame:
    """row_id, features, y (code of the class) and split: stratified where every class has two rows, infinities 0, nulls the training median."""
    df, numeric, categorical, target = _typed(spark, path, target, row_id)
    codes = E.mapping(df, target, None)
    df = E.apply_mapping(df, codes, target, missing=None, to="y").withColumns({c: F.when(F.abs(F.col(c)) == float("inf"), 0.0).otherwise(F.col(c)) for c in numeric})
    parts = stratified_split(df.select(row_id, *numeric, *categorical, "y"), "y", test_size, seed, row_id)
    train = parts.where("split = 'train'")
    return E.encode(train, E.median_fill(train, parts, numeric) if numeric else parts, categorical)


def regression_task(spark: SparkSession, path: str, row_id: str, seed: int = 42, test_size: float = 0.2, target: str | None = None) -> DataFrame:
    """row_id, features, y (double; rows whose target is no number go) and split."""
    df, numeric, categorical, target = _typed(spark, path, target, row_id)
    df = df.withColumn("y", F.expr(f"try_cast(`{target}` as double)")).where("y is not null and not isnan(y)")
    parts = random_split(df.select(row_id, *numeric, *categorical, "y"), test_size, seed, row_id)
    return E.column_transform(parts.where("split = 'train'"), parts, numeric, categorical)


def all_tasks(sources: dict[str, DataFrame], target: str, row_id: str, most_rows: int, most_classes: int, seed: int) -> DataFrame:
    """Several sources as one table with `dataset`, after caps a source on classes and rows (by hash); columns by name, missing ones null."""
    out = None
    for name, df in sources.items():
        part = row_cap(class_cap(df, target, most_classes), most_rows, seed, row_id).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_predictions(df: DataFrame, path: str, row_id: str, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """row_index, target, probability and prediction as a Parquet table; returns it as read back."""
    out = df.select(F.col(row_id).alias("row_index"), F.col(y).alias("target"), F.col(p).alias("probability"), (F.col(p) >= threshold).cast("int").alias("prediction"))
    out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)
