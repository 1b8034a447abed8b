"""Log files to metric tables: whole files as rows, blocks of a configuration, numbers by label, joined to status tables of several schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a block of a configuration begins, and labels by metric, in the logs' two languages.
BLOCK = r"【配置(\d+):\s*([^】]+)】"
LABELS = {
    "classification": {"acc": ["准确率", "Accuracy", "acc"], "f1": ["F1分数", "F1 Score", "f1"], "auc": ["AUC"], "precision": ["精确率", "Precision", "pre"], "recall": ["召回率", "Recall", "rec"]},
    "regression": {"mae": ["MAE"], "rmse": ["RMSE"], "r2": ["R2", "R²"], "rmsle": ["RMSLE"]},
    "clustering": {"ari": ["ARI"], "nmi": ["NMI"], "silhouette": ["Silhouette"]},
}
PRIMARY = {"classification": "auc", "regression": "r2", "clustering": "ari"}
NUMBER = r"([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|N/A|nan)"


def read_logs(spark: SparkSession, path: str, pattern: str = "*.log") -> DataFrame:
    """path and text of every log file below a folder, each a row."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def number_after(text: Column, labels: list[str]) -> Column:
    """The number after the first of some labels and a colon, whatever the letters' case; null if there is none or it is N/A or nan."""
    # a label is no end of a longer word, as MAE is none of RMAE
    found = F.regexp_extract(text, rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(map(re.escape, labels))})\s*[:：]\s*{NUMBER}", 1)
    return F.when(~F.lower(found).isin("", "n/a", "nan"), found.try_cast("double"))


def blocks(logs: DataFrame, end: str = r"\n=+\s*\n|\nTotal experiment time") -> DataFrame:
    """The columns of logs, block (its number), configuration and body of every block, which ends at the next one or at `end`."""
    parts = F.split("text", rf"(?={BLOCK})")  # a text's start, then a part a block
    each = logs.select("*", F.posexplode(F.filter(parts, lambda x: F.regexp_like(x, F.lit(rf"^{BLOCK}")))).alias("_i", "_part")).drop("text")
    body = F.split(F.regexp_replace("_part", rf"^{BLOCK}", ""), end, 2)[0]
    return each.select(*[c for c in logs.columns if c != "text"], F.regexp_extract("_part", BLOCK, 1).cast("int").alias("block"), F.trim(F.regexp_extract("_part", BLOCK, 2)).alias("configuration"), body.alias("body"))


def log_metrics(logs: DataFrame, task: str) -> DataFrame:
    """A row a block with the task's metrics, or for a text without blocks one of its whole text; rows without the primary metric are left out.

    Shares up to 1.5 become percentages for classification and clustering. Columns: those of logs but text, block (0 for
    the whole), configuration, and the metrics.
    """
    keep = [c for c in logs.columns if c != "text"]
    found = blocks(logs)
    rest = logs.where(~F.regexp_like("text", F.lit(BLOCK))).select(*keep, F.lit(0).alias("block"), F.lit("whole").alias("configuration"), F.col("text").alias("body"))
    scale = (lambda x: F.when(F.abs(x) <= 1.5, x * 100).otherwise(x)) if task != "regression" else (lambda x: x)
    every = found.unionByName(rest)
    return every.select(*keep, "block", "configuration", *[scale(number_after(F.col("body"), labels)).alias(m) for m, labels in LABELS[task].items()]).where(F.col(PRIMARY[task]).isNotNull())


def best_block(metrics: DataFrame, task: str, keys: list[str]) -> DataFrame:
    """The block of the greatest primary metric of each key, the first of several, and how many blocks there were."""
    rest = [c for c in metrics.columns if c not in keys]
    return metrics.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(PRIMARY[task], -F.col("block"))).alias("_b"), F.count("*").alias("parsed")).select(*keys, "_b.*", "parsed")


def repeated_metrics(logs: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """path, metric, place (from 1) and value of every number after a label: of repeated rounds, pair by pair with arrays_zip."""
    arrays = [F.transform(F.regexp_extract_all("text", F.lit(rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(map(re.escape, names))})\s*[:=：]\s*{NUMBER}"), F.lit(1)), lambda x: x.try_cast("double")).alias(m) for m, names in labels.items()]
    zipped = logs.select("path", F.posexplode(F.arrays_zip(*arrays)).alias("_i", "_m"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_m.{m}").alias("value")) for m in labels])).alias("x")
    return zipped.select("path", (F.col("_i") + 1).alias("place"), each).select("path", "x.metric", "place", "x.value").where("value is not null")


def status_rows(tables: list[tuple[DataFrame, str, dict[str, str]]]) -> DataFrame:
    """One table of status rows from several schemas: each with its version and the names that its columns go by; missing ones are null."""
    names = ["job", "task", "dataset", "seed", "setting", "status", "log"]
    out = None
    for df, version, named in tables:
        at = {n: named.get(n, n) for n in names}
        part = df.select(F.lit(version).alias("version"), *[(F.col(at[n]) if at[n] in df.columns else F.lit(None)).cast("string").alias(n) for n in names])
        out = part if out is None else out.unionByName(part)
    return out


def file_name(path: Column) -> Column:
    """The last component of a path of either kind."""
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def joined_metrics(status: DataFrame, best: DataFrame, key=file_name) -> DataFrame:
    """Status rows with the metrics of the log that they name: by the file's name, or what `key` makes of both paths. A row without a log has nulls."""
    return status.withColumn("_key", key(F.col("log"))).join(best.withColumn("_key", key(F.col("path"))).drop("path"), "_key", "left").drop("_key")
