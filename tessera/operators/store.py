"""Predictions kept by what made them: read back instead of fitted again."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators.models import _reason, scored, together


def data_fingerprint(df: DataFrame) -> str:
    """Of a table's columns and rows, whatever their order: their number, and sum and exclusive or of their hashes. One pass."""
    values = [F.col(c).cast("string") if "struct" in kind or "vector" in kind or "map" in kind else F.col(c) for c, kind in df.dtypes]
    h = F.xxhash64(*values)
    n, total, mixed = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return hashlib.sha256(json.dumps([df.dtypes, n, str(total), mixed]).encode()).hexdigest()


def model_fingerprint(estimator) -> str:
    """Of an estimator's kind and all its parameters, defaults included; of an own one, its class and attributes."""
    if hasattr(estimator, "extractParamMap"):
        params = sorted((p.name, repr(v)) for p, v in estimator.extractParamMap().items())
    else:
        params = sorted((k, repr(v)) for k, v in vars(estimator).items())
    return hashlib.sha256(json.dumps([type(estimator).__module__, type(estimator).__qualname__, params]).encode()).hexdigest()


class PredictionStore:
    """A folder of prediction tables, each named by a fingerprint of training rows, predicted rows, and model with parameters.

    fitted and failed tell which models this object had to fit, and which could not be. A table counts once its write is
    complete, so a job that was cut off fits again.
    """

    def __init__(self, folder: str, workers: int = 4):
        self.folder, self.workers = folder.rstrip("/"), workers
        self.fitted: list[str] = []
        self.failed: list[tuple[str, str]] = []

    def _complete(self, spark, path: str) -> bool:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def predictions(self, pool: dict, train: DataFrame, parts: dict[str, DataFrame], row_id: str) -> DataFrame:
        """row_id, y, split, model, p of every model of the pool on every part; models whose table is there are not fitted.

        A changed row, feature, parameter or part makes another fingerprint. A model that cannot be fitted has no rows.
        """
        spark = train.sparkSession
        data = hashlib.sha256("".join([data_fingerprint(train), *(f"{s}:{data_fingerprint(p)}" for s, p in sorted(parts.items()))]).encode()).hexdigest()
        paths = {name: f"{self.folder}/{hashlib.sha256((data + model_fingerprint(e) + row_id).encode()).hexdigest()}" for name, e in pool.items()}

        def make(name: str):
            model, out = pool[name].fit(train), None
            for split, part in parts.items():
                told = scored(model, part, [row_id, "y"]).withColumn("split", F.lit(split))
                out = told if out is None else out.unionByName(told)
            out.write.mode("overwrite").parquet(paths[name])

        missing = [n for n in pool if not self._complete(spark, paths[n])]
        _, errors = together({n: (lambda n=n: make(n)) for n in missing}, self.workers)
        self.fitted += [n for n in missing if n not in errors]
        self.failed += [(n, _reason(e)) for n, e in errors.items()]
        out = None
        for name in pool:
            if name not in errors:
                part = spark.read.parquet(paths[name]).withColumn("model", F.lit(name))
                out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError(f"no model could be fitted: {self.failed}")
        return out


def classification_candidates(predictions: DataFrame) -> DataFrame:
    """model, split, auc, brier, log_loss, accuracy: grouped metrics of a prediction table, whatever the number of models."""
    by = ["model", "split"]
    return M.roc_auc(predictions, by=by).join(M.probability_scores(predictions, by=by), by).join(M.confusion(predictions, by=by).select(*by, "accuracy"), by)


def regression_candidates(predictions: DataFrame) -> DataFrame:
    """model, split and the regression metrics of each."""
    return M.regression_scores(predictions, by=["model", "split"])
