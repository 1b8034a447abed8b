"""Probability calibration, thresholds and prediction intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import logit, sigmoid, softmax
from tessera.operators.metrics import clip, threshold_scores
from tessera.operators.ranking import linear_quantiles, running, step_count, value_bucket


def temperature_losses(df: DataFrame, y: str, z: str, grid: list[float]) -> DataFrame:
    """t and loss: mean log loss of sigmoid(z / t) for each temperature; all in one pass over the rows."""
    p = {t: clip(sigmoid(F.col(z) / t)) for t in grid}
    losses = [F.struct(F.lit(float(t)).alias("t"), F.avg(-F.col(y) * F.log(q) - (1 - F.col(y)) * F.log(1 - q)).alias("loss")) for t, q in p.items()]
    return df.agg(F.array(*losses).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def fit_temperature(df: DataFrame, y: str, z: str, rounds: int = 3, points: int = 25, low: float = 0.05, high: float = 20.0) -> float:
    """The temperature of least loss: a logarithmic grid, refined around its best point in each round."""
    best = 1.0
    for _ in range(rounds):
        step = (math.log(high) - math.log(low)) / (points - 1)
        grid = [math.exp(math.log(low) + i * step) for i in range(points)]
        best = temperature_losses(df, y, z, grid).orderBy("loss", "t").first()["t"]
        low, high = max(0.05, best * math.exp(-step)), min(20.0, best * math.exp(step))
    return best


def multiclass_temperature_losses(df: DataFrame, y: str, probabilities: dict[str, str], grid: list[float]) -> DataFrame:
    """t and loss for an array of class probabilities, whose logarithms are the logits."""
    logits = F.array(*[F.log(clip(F.col(c))) for c in probabilities.values()])
    place = F.array_position(F.array(*map(F.lit, probabilities)), F.col(y).cast("string")).cast("int")
    losses = [F.struct(F.lit(float(t)).alias("t"), F.avg(-F.log(clip(F.element_at(softmax(logits, t), place)))).alias("loss")) for t in grid]
    return df.where(place > 0).agg(F.array(*losses).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def threshold_table(df: DataFrame, y: str, p: str, grid: list[float], by: list[str] | None = None) -> DataFrame:
    """Scores at each threshold of a grid. Rows are first summed by how many thresholds they reach, so only as many remain."""
    by = by or []
    reached = step_count(F.col(p), sorted(grid))
    scores = df.groupBy(*by, p).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.sum(1 - F.col(y).cast("long")).alias("_neg"))
    cells = scores.groupBy(*by, reached.alias("_reached")).agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    rows = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(sorted(grid))], "_i int, threshold double")
    hit = F.col("_reached") > F.col("_i")
    counted = cells.crossJoin(F.broadcast(rows)).groupBy(*by, "threshold").agg(  # grid by grid
        F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("_pos")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, F.col("_neg")).otherwise(0)).alias("tn"),
    )
    return counted.withColumns(threshold_scores(*[F.col(n) for n in ("tp", "fp", "fn", "tn")]))


def best_threshold(table: DataFrame, metric: str, by: list[str] | None = None) -> DataFrame:
    """The smallest threshold of the greatest value of a metric."""
    return table.groupBy(*(by or [])).agg(F.max_by("threshold", F.struct(F.col(metric), -F.col("threshold"))).alias("threshold"), F.max(metric).alias(metric))


def order_statistic(df: DataFrame, value: str, level: Column, by: list[str]) -> DataFrame:
    """The value at place ceil((n - 1) * level) + 1 of each group's sorted values: the `higher` quantile."""
    sizes = df.groupBy(*by).agg(F.count(value).alias("_n"))
    place = F.least(F.ceil((F.col("_n") - 1) * F.least(level, F.lit(1.0)) - 1e-12) + 1, F.col("_n"))
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_k"))
    ranked = running(counted, value_bucket(value), [F.col(value)], {"_upto": F.col("_k")}, by)
    return ranked.join(sizes, by).where(F.col("_upto") >= place).groupBy(*by).agg(F.min(value).alias("qhat"))


def conformal(df: DataFrame, residual: str, alpha: float, by: list[str], kind: str = "higher") -> DataFrame:
    """qhat of absolute residuals: `higher` quantile of 1 - alpha, its `finite` sample level, or the `linear` one."""
    if kind == "linear":
        return linear_quantiles(df, residual, {"qhat": 1 - alpha}, by)
    n = F.col("_n")
    level = F.lit(1 - alpha) if kind == "higher" else F.ceil((n + 1) * (1 - alpha)) / n
    return order_statistic(df, residual, level, by)


def platt(df: DataFrame, y: str, p: str, apply_to: DataFrame | None = None, c: float = 1.0) -> DataFrame:
    """`calibrated` by a logistic regression on logit(p)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def featured(x: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=["_z"], outputCol="_features").transform(x.withColumn("_z", logit(F.col(p))))

    n = df.count()
    model = LogisticRegression(featuresCol="_features", labelCol=y, regParam=1 / (c * max(n, 1)), probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_said").fit(featured(df))
    out = model.transform(featured(df if apply_to is None else apply_to))
    return out.withColumn("calibrated", vector_to_array("_probability")[1]).drop("_z", "_features", "_probability", "_raw", "_said")


def isotonic(df: DataFrame, y: str, p: str, apply_to: DataFrame | None = None) -> DataFrame:
    """`calibrated` by isotonic regression; scores outside the fitted range get its ends.

    Rows are summed by score first, so the fit, which ends in one partition, takes distinct scores with their weights.
    """
    from pyspark.ml.regression import IsotonicRegression

    points = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(p).agg(F.avg(F.col(y).cast("double")).alias(y), F.count("*").cast("double").alias("_weight"))
    model = IsotonicRegression(featuresCol=p, labelCol=y, weightCol="_weight", predictionCol="calibrated").fit(points)
    return model.transform(df if apply_to is None else apply_to)


def tempered(df: DataFrame, y: str, p: str, apply_to: DataFrame | None = None) -> DataFrame:
    """`calibrated` by the temperature of least log loss on df."""
    t = fit_temperature(df.withColumn("_z", logit(F.col(p))), y, "_z")
    return (df if apply_to is None else apply_to).withColumn("calibrated", sigmoid(logit(F.col(p)) / t))


#: Calibrators by name: each takes (df, y, p, apply_to) and gives apply_to with `calibrated`.
METHODS = {"none": lambda df, y, p, apply_to=None: (df if apply_to is None else apply_to).withColumn("calibrated", F.col(p)), "temperature": tempered, "platt": platt, "isotonic": isotonic}


def cross_calibrated(df: DataFrame, y: str, p: str, apply_to: DataFrame, row_id: str, method: str = "platt", k: int = 5, seed: int = 42) -> DataFrame:
    """apply_to with `calibrated`: the mean of k calibrators, each fitted on one stratified fold of df."""
    from tessera.operators.split import k_fold
    from tessera.sources.shared import written

    folded, out = written(k_fold(df, k, seed, row_id, y), "calibration-folds"), apply_to
    for fold in range(k):
        out = METHODS[method](folded.where(F.col("fold") == fold), y, p, out).withColumnRenamed("calibrated", f"_c{fold}")
    names = [f"_c{i}" for i in range(k)]
    return out.withColumn("calibrated", sum(map(F.col, names), F.lit(0.0)) / k).drop(*names)


def calibration_matrix(fit: DataFrame, test: DataFrame, y: str, sources: dict[str, str], row_id: str, methods: tuple[str, ...] = tuple(METHODS)) -> DataFrame:
    """Long predictions (source, method, row_id, y, p) on test of each source column under each calibrator fitted on fit."""
    out = None
    for source, p in sources.items():
        for method in methods:
            part = METHODS[method](fit, y, p, test).select(F.lit(source).alias("source"), F.lit(method).alias("method"), row_id, F.col(y).alias("y"), F.col("calibrated").alias("p"))
            out = part if out is None else out.unionByName(part)
    return out


def deltas(raw: DataFrame, calibrated: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """by and, for each metric, calibrated less raw, and whether it fell."""
    joined = raw.alias("r").join(calibrated.alias("c"), by)
    out = [(F.col(f"c.{m}") - F.col(f"r.{m}")).alias(f"{m}_delta") for m in metrics]
    return joined.select(*by, *out).withColumns({f"{m}_improved": (F.col(f"{m}_delta") < 0).cast("int") for m in metrics})


def share_improved(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Share of rows whose metric fell, and the mean delta."""
    return rows.groupBy(*by).agg(*[F.avg(f"{m}_improved").alias(f"{m}_share") for m in metrics], *[F.avg(f"{m}_delta").alias(f"{m}_delta") for m in metrics])
