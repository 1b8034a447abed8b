"""Students that learn a teacher's class probabilities, and the losses that choose among them."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import binary_kd
from tessera.operators.ensemble import soft_targets
from tessera.operators.models import class_probabilities
from tessera.sources.shared import written


def logits(p: str) -> Column:
    """Logarithms of the class probabilities of an array column, from 1e-6 to 1 - 1e-6."""
    return F.transform(p, lambda x: F.log(F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))))


def soft_student(teacher: DataFrame, fit: DataFrame, row_id: str, classes: int, temperature: float = 3.0, share: float = 0.5, strength: float = 0.001):
    """A multinomial student of the features on the teacher's softened probabilities: each row stands once a class, weighing its target.

    teacher has row_id and p, an array of probabilities by class code; fit has row_id, y (a code) and features. A target is
    (1 - share) of the true class and share of softmax(log p / temperature). A row without a teacher is left out; of
    weight 0, too, as it adds nothing.
    """
    rows = fit.select(row_id, F.col("y").cast("int").alias("y"), "features").join(teacher.select(row_id, logits("p").alias("_z")), row_id)
    named = soft_targets(rows, "y", F.col("_z"), [str(c) for c in range(classes)], temperature, share)
    expanded = written(named.select("features", F.col("class").cast("double").alias("y"), "weight").where("weight > 0"), "soft-targets")
    return LogisticRegression(family="multinomial", featuresCol="features", labelCol="y", weightCol="weight", regParam=strength, maxIter=60).fit(expanded)


def hard_student(fit: DataFrame, strength: float = 0.001):
    """The same student on true labels."""
    return LogisticRegression(family="multinomial", featuresCol="features", labelCol="y", regParam=strength, maxIter=60).fit(fit.withColumn("y", F.col("y").cast("double")))


def distillation_losses(rows: DataFrame, temperature: float = 3.0, share: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """hard (cross entropy of y), kd (T^2 KL of softened teacher to student), blend of the two, and squared (mean squared difference of probabilities).

    rows has y (a code), t and s, arrays of the teacher's and the student's probabilities.
    """
    mine = F.element_at("s", F.col("y") + 1)
    apart = F.aggregate(F.zip_with("t", "s", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) / F.size("t")
    out = rows.groupBy(*(by or [])).agg(F.avg(-F.log(F.greatest(mine, F.lit(1e-6)))).alias("hard"), F.avg(binary_kd(logits("t"), logits("s"), temperature)).alias("kd"), F.avg(apart).alias("squared"))
    return out.withColumn("blend", (1 - share) * F.col("hard") + share * F.col("kd"))


def chosen_student(teacher: DataFrame, fit: DataFrame, val: DataFrame, row_id: str, classes: int, temperature: float = 3.0, shares: tuple[float, ...] = (0.0, 0.5, 0.9)):
    """(model, share, losses of every share on val): the student of the least squared difference to the teacher's probabilities on validation rows.

    teacher has p of rows of fit and val; a share of 0 learns the true labels alone.
    """
    models = {s: soft_student(teacher, fit, row_id, classes, temperature, s) for s in shares}
    told = None
    for s, model in models.items():
        part = class_probabilities(model, val, [row_id, F.col("y").cast("int").alias("y")], classes).withColumn("share", F.lit(s)).withColumnRenamed("p", "s")
        told = part if told is None else told.unionByName(part)
    losses = written(distillation_losses(told.join(teacher.select(row_id, F.col("p").alias("t")), row_id), temperature, by=["share"]), "student-losses")
    share = losses.orderBy("squared", "share").first()["share"]  # a row a share
    return models[share], share, losses


