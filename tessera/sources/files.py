"""Sources and sinks: task tables from CSV, logs, nested JSON artifacts, text, sectioned tables; result bundles and manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.encode import coerce
from tessera.spec import TableSpec


def task_csv(spark: SparkSession, paths: str | list[str], target: str | None = None, drop_missing_target: bool = True, coerce_features: bool = True) -> tuple[DataFrame, TableSpec]:
    """A CSV task table: the last column is the target unless named; rows without one go; features that parse as numbers become double."""
    df = spark.read.csv(paths, header=True)
    target = target or df.columns[-1]
    if drop_missing_target:
        df = df.dropna(subset=[target])
    features = [c for c in df.columns if c != target]
    if coerce_features and features:
        df = coerce(df, features)
    kinds = dict(df.dtypes)
    return df.select(*features, target), TableSpec(tuple(features), target, categorical=tuple(c for c in features if kinds[c] == "string"))


def first_path(spark: SparkSession, candidates: list[str]) -> str:
    """The first candidate path that Spark can read as CSV."""
    for path in candidates:
        try:
            spark.read.csv(path, header=True)
        except AnalysisException:
            continue
        return path
    raise FileNotFoundError(f"none of {candidates}")


def first_that_exists(spark: SparkSession, candidates: list[str], **options) -> DataFrame:
    """The table at the first candidate path that Spark can read as CSV."""
    return spark.read.options(**options).csv(first_path(spark, candidates), header=True)


def csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV of a declared schema, empty if it is not there."""
    try:
        return spark.read.schema(schema).csv(path, header=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def description(spark: SparkSession, path: str) -> DataFrame:
    """name and text of side-car description files (<name>-description.txt, or data_description.txt in the data set's folder)."""
    whole = spark.read.text(path, wholetext=True).withColumn("_f", F.input_file_name())
    own = F.regexp_extract("_f", r"([^/]+)-description\.txt$", 1)
    return whole.select(F.when(own != "", own).otherwise(F.regexp_extract("_f", r"([^/]+)/data_description\.txt$", 1)).alias("name"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; strict fails on a bad line, otherwise such lines are rows with `_corrupt`."""
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt string")
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def path_keys(path: Column) -> list[Column]:
    """task, dataset, seed and condition out of .../task/dataset/seed_42/condition.json."""
    part = lambda i: F.regexp_extract(path, r"([^/]+)/([^/]+)/seed_(\d+)/([^/]+)\.json", i)
    return [part(1).alias("task"), part(2).alias("dataset"), F.nullif(part(3), F.lit("")).cast("long").alias("seed"), part(4).alias("condition")]


def artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested JSON artifacts below a folder, with the keys in their paths."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return df.select(*path_keys(F.input_file_name()), "*")


def parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Part CSVs of several runs, columns by name, missing ones null, with the file each row is from."""
    out = None
    for p in paths:
        df = spark.read.csv(p, header=True).withColumn("source_file", F.input_file_name())
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def section_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line and text of every line of whole files, numbered in its file: what `sections` takes by path, a file a group."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return whole.select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))


def sections(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sectioned tables out of (line, text): a title line, a header line, rows until a blank one. Gives title, row name, column, cell."""
    w = Window.partitionBy(*(by or [])).orderBy("line")
    blank = F.trim("text") == ""
    starts = F.when(~blank & F.coalesce(F.lag(blank).over(w), F.lit(True)), F.col("line"))
    marked = lines.withColumn("_start", F.last(starts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~blank)
    group = Window.partitionBy(*(by or []), "_start")
    title = F.max(F.when(F.col("line") == F.col("_start"), F.col("text"))).over(group)
    header = F.max(F.when(F.col("line") == F.col("_start") + 1, F.col("text"))).over(group)
    rows = marked.withColumn("title", title).withColumn("header", header).where(F.col("line") > F.col("_start") + 1)
    cells = F.explode(F.arrays_zip(F.split("header", ",").alias("column"), F.split("text", ",").alias("cell"))).alias("x")
    flat = rows.select(*(by or []), "title", F.split("text", ",")[0].alias("name"), cells)
    return flat.select(*(by or []), "title", "name", "x.column", "x.cell").where("cell <> name")


def write_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as Parquet below path, and a manifest of their rows."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    counts = [(name, spark.read.parquet(f"{path}/{name}").count()) for name in tables]
    manifest = spark.createDataFrame(counts, "name string, rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def append_rows(df: DataFrame, path: str) -> None:
    """Appends to a Parquet table; new columns widen it when read with mergeSchema, and a commit is atomic by file."""
    df.write.mode("append").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    df.select(*(fields or df.columns)).write.mode("overwrite").csv(path, header=True)


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
