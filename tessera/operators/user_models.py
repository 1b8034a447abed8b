"""A user's own models, one a group: small groups each in a task by the user's fit and predict, large ones by any estimator over Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.models import scored
from tessera.sources.shared import written


def group_sizes(df: DataFrame, by: list[str], width: int) -> DataFrame:
    """by, rows and bytes (8 a cell) of each group."""
    return df.groupBy(*by).agg(F.count("*").alias("rows")).withColumn("bytes", F.col("rows") * (8 * width))


def fit_groups(df: DataFrame, by: list[str], row_id: str, features: list[str], make: Callable[[], object], estimator: Callable[[], object] | None = None, most_bytes: int = 256 << 20, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """(predictions, log): each group's model, fitted on its rows of split 'fit', on its other rows.

    df has by, row_id, the features, y and split. make() gives an object with fit(X, y) and predict_proba(X) or predict(X),
    X a pandas table: it is run in one task with its whole group, if that has most_bytes at most. A larger group is
    fitted as a table by estimator(), which takes `features` and `y` and may be any of pyspark.ml; without one it is an
    error that names it, as no group is cut or sampled. predictions: by, row_id, y, split, p. log: by, rows, way (task or
    table) and error (null, or what the model raised; such a group has no predictions).
    """
    import pandas as pd

    width = len(features) + 2
    sizes = written(group_sizes(df, by, width), "group-sizes")
    large = sizes.where(F.col("bytes") > most_bytes).select(*by).collect()  # each of most_bytes and more
    if large and estimator is None:
        raise ValueError(f"groups of more than {most_bytes} bytes need an estimator: {[tuple(r) for r in large[:5]]}")
    fields = {f.name: f for f in df.schema}
    schema = T.StructType([*(fields[c] for c in by), T.StructField(row_id, T.LongType()), T.StructField("y", T.DoubleType()), T.StructField(split, T.StringType()), T.StructField("p", T.DoubleType()), T.StructField("error", T.StringType())])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        fit, other = pdf[pdf[split] == "fit"], pdf[pdf[split] != "fit"]
        out = other[[*by, row_id, "y", split]].copy()
        try:
            model = make()
            model.fit(fit[features], fit["y"])
            if hasattr(model, "predict_proba"):
                p = model.predict_proba(other[features])
                p = p[:, 1] if getattr(p, "ndim", 1) > 1 else p
            else:
                p = model.predict(other[features])
            out["p"] = [float(v) for v in p]
            out["error"] = None
        except Exception as e:  # noqa: BLE001 - whatever the user's model raises
            out = pd.DataFrame([dict(zip(by, key, strict=True)) | {row_id: None, "y": None, split: None, "p": None, "error": f"{type(e).__name__}: {e}"[:200]}])
        return out[[*by, row_id, "y", split, "p", "error"]].astype({row_id: "Int64"})

    plain = df.select(*by, F.col(row_id).cast("long").alias(row_id), *[F.col(f).cast("double").alias(f) for f in features], F.col("y").cast("double").alias("y"), split)
    small = plain.join(F.broadcast(sizes.where(F.col("bytes") > most_bytes).select(*by)), by, "left_anti") if large else plain
    told = written(small.groupBy(*by).applyInPandas(run, schema), "group-models")
    predictions = told.where("error is null").drop("error")
    log = sizes.select(*by, "rows").join(told.where("error is not null").select(*by, "error"), by, "left").withColumn("way", F.lit("task"))
    rows: list[tuple] = []
    for key in large:
        own = plain.where(sum((F.col(c).eqNullSafe(F.lit(v)).cast("int") for c, v in zip(by, key, strict=True)), F.lit(0)) == len(by))
        try:
            from tessera.operators.models import assembled

            own = assembled(own, features)
            part = scored(estimator().fit(own.where(F.col(split) == "fit")), own.where(F.col(split) != "fit"), [*by, row_id, "y", split])
            predictions = predictions.unionByName(written(part.withColumn("p", F.col("p").cast("double")), "group-model"))
            rows.append((*key, None))
        except Exception as e:  # noqa: BLE001
            rows.append((*key, f"{type(e).__name__}: {e}".splitlines()[0][:200]))
    if rows:
        ways = df.sparkSession.createDataFrame(rows, T.StructType([*(fields[c] for c in by), T.StructField("_error", T.StringType())])).withColumn("_large", F.lit(True))
        log = log.join(F.broadcast(ways), by, "left").select(*by, "rows", F.coalesce("error", "_error").alias("error"), F.when(F.col("_large"), "table").otherwise(F.col("way")).alias("way"))  # large groups
    return predictions, log.select(*by, "rows", "way", "error")
