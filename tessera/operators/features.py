"""Declarative feature programs: an ordered list of named Spark expressions, with lineage and screening."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feature:
    """A name and a SQL expression over earlier columns, or a statistic of a group that is fitted on one frame and joined to any."""

    name: str
    expression: str = ""
    group_by: str = ""
    statistic: str = ""


def apply_program(program: list[Feature], df: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """df with the program's features, in order; group statistics come from `fit` (df itself by default)."""
    source = df if fit is None else fit
    for f in program:
        if f.group_by:
            stats = source.groupBy(f.group_by).agg(F.expr(f.statistic).alias(f.name))
            df = df.join(stats, f.group_by, "left")
            source = source.join(stats, f.group_by, "left") if fit is not None else df
        else:
            df = df.withColumn(f.name, F.expr(f.expression))
            source = source.withColumn(f.name, F.expr(f.expression)) if fit is not None else df
    return df


def within_budget(columns: list[str], added: list[str], factor: int = 4) -> bool:
    return len(columns) + len(added) <= factor * len(columns)


def pairwise(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the sum and the product of every pair of the columns, in one projection."""
    out = {}
    for a, b in itertools.combinations(names, 2):
        out |= {f"{a}_plus_{b}": F.col(a) + F.col(b), f"{a}_times_{b}": F.col(a) * F.col(b)}
    return df.withColumns(out)


def univariate(df: DataFrame, names: list[str]) -> DataFrame:
    """df with square, cube, inverse, root of the size, logarithm and size of each column; null where undefined."""
    out = {}
    for n in names:
        x = F.col(n)
        out |= {
            f"{n}_sq": x * x, f"{n}_cube": x * x * x, f"{n}_inv": F.try_divide(F.lit(1.0), x), f"{n}_root": F.sqrt(F.abs(x)),
            f"{n}_ln": F.when(x > 0, F.log(x)), f"{n}_abs": F.abs(x),
        }
    return df.withColumns(out)


def cumulative_product(x: Column, window) -> Column:
    """exp of summed logarithms, with the sign and any zero so far."""
    some_zero = F.max((x == 0).cast("int")).over(window)
    sign = F.when(F.sum((x < 0).cast("int")).over(window) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(some_zero == 1, 0.0).otherwise(sign * F.exp(F.sum(F.log(F.abs(F.nullif(x, F.lit(0.0))))).over(window)))


def running_product(df: DataFrame, value: str, by: list[str], order: str, name: str) -> DataFrame:
    """df with the cumulative product of a column along a numeric order column within `by`: sums of logarithms, minus signs and zeros by bucket, so that no group is one task's work."""
    from tessera.operators.ranking import running, value_bucket

    x = F.col(value)
    sums = {"_log": F.coalesce(F.log(F.abs(F.nullif(x, F.lit(0.0)))), F.lit(0.0)), "_minus": (x < 0).cast("long"), "_zeros": (x == 0).cast("long")}
    found = running(df, value_bucket(order), [F.col(order)], sums, by)
    sign = F.when(F.col("_minus") % 2 == 1, -1.0).otherwise(1.0)
    return found.withColumn(name, F.when(F.col("_zeros") > 0, 0.0).otherwise(sign * F.exp("_log"))).drop(*sums)


def average_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """df with the mean rank of a value within `by`, from counts of distinct values by bucket; nulls have none."""
    from tessera.operators.ranking import running, value_bucket

    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running(counted, value_bucket(value), [F.col(value)], {"_upto": F.col("_n")}, by)
    return df.join(ranked.select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name)), [*by, value], "left")


def ewm_mean(df: DataFrame, value: str, by: list[str], order: list[str], alpha: float, name: str = "ewm") -> DataFrame:
    """df with the weighted mean of all values so far, weights (1 - alpha)^age; ages count rows, those of nulls too, and a null repeats the last mean.

    Rows are cut into blocks so long that a block's weights fit a double: a row sums its own block up to itself and the
    one before whole. Older ones weigh less than 1e-150 of the row's own value. A group without values so far has null.
    """
    block = max(1, int(150 / -math.log10(1 - alpha))) if 0 < alpha < 1 else 1
    keep = 1 - alpha
    place = Window.partitionBy(*by).orderBy(*order)
    at = df.withColumn("_i", F.row_number().over(place) - 1).withColumn("_b", F.floor(F.col("_i") / block)).withColumn("_k", F.col("_i") % block)
    there = F.col(value).isNotNull().cast("double")
    own = Window.partitionBy(*by, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy(*by).orderBy("_b").rangeBetween(-1, -1)
    sums = {}
    for n, x in (("n", F.coalesce(F.col(value).cast("double"), F.lit(0.0))), ("d", there)):
        inside = F.sum(x * F.pow(F.lit(keep), -F.col("_k"))).over(own) * F.pow(F.lit(keep), F.col("_k"))
        before = F.coalesce(F.sum(x * F.pow(F.lit(keep), F.lit(block) - F.col("_k"))).over(last), F.lit(0.0)) * F.pow(F.lit(keep), F.col("_k"))
        sums[f"_{n}"] = inside + before
    found = at.withColumns(sums).withColumn("_m", F.when(F.col(value).isNotNull(), F.try_divide("_n", "_d")))
    filled = F.last("_m", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn(name, filled).select(*[c for c in df.columns if c != name], name)


def dry_run(program: list[Feature], df: DataFrame, row_id: str, k: int = 5, repeats: int = 1, seed: int = 42, target: str | None = None) -> DataFrame:
    """repeat, fold, rows and the first error of a program on every fold, fitted on the other folds; error is null where all is well.

    A program that does not even resolve gives one row, with repeat and fold null.
    """
    from tessera.operators.split import k_fold
    from tessera.sources.shared import written

    spark = df.sparkSession
    rows: list[tuple] = []
    try:
        apply_program(program, df)
    except Exception as e:  # noqa: BLE001 - the error is the result
        return spark.createDataFrame([(None, None, None, _first_line(e))], "repeat int, fold int, rows long, error string")
    names = [f.name for f in program]
    for repeat in range(repeats):
        folded = written(k_fold(df, k, seed + repeat, row_id, target), "dry-run-folds")
        for fold in range(k):
            part = folded.where(F.col("fold") == fold)
            try:
                seen = apply_program(program, part, folded.where(F.col("fold") != fold)).agg(F.count("*"), *[F.count(n) for n in names]).first()
                rows.append((repeat, fold, seen[0], None))
            except Exception as e:  # noqa: BLE001
                rows.append((repeat, fold, None, _first_line(e)))
    return spark.createDataFrame(rows, "repeat int, fold int, rows long, error string")


def _first_line(error: Exception) -> str:
    return str(error).strip().splitlines()[0][:200]


def top_intersection(ranks: list[dict[str, float]], most: int = 7) -> list[str]:
    """Names among the `most` highest of every screen, in the order of the first; none may be left."""
    tops = [sorted(r, key=lambda n: (-r[n], n))[:most] for r in ranks]
    return [n for n in tops[0] if all(n in t for t in tops[1:])]


#: User functions by name: features (series to series) and metrics (y, p to a number).
FEATURE_FUNCTIONS: dict[str, object] = {}
METRIC_FUNCTIONS: dict[str, object] = {}


def feature_function(name: str, f) -> None:
    """Registers a function of pandas series as a feature; Spark calls it on Arrow batches."""

    def run(*columns: pd.Series) -> pd.Series:
        return f(*columns)

    FEATURE_FUNCTIONS[name] = run


def apply_feature(df: DataFrame, name: str, columns: list[str], to: str) -> DataFrame:
    """df with a registered function of the columns."""
    return df.withColumn(to, F.pandas_udf(FEATURE_FUNCTIONS[name], "double")(*map(F.col, columns)))


def metric_function(name: str, sums: dict[str, object], finish) -> None:
    """Registers a metric that adds up: `sums` are functions of (y, p) columns whose sums, and the count `n`, go to `finish`.

    As only sums meet, a metric of any number of rows is no single task's work.
    """
    METRIC_FUNCTIONS[name] = (sums, finish)


def apply_metric(df: DataFrame, name: str, y: str, p: str, by: list[str]) -> DataFrame:
    """by and the registered metric of each group."""
    sums, finish = METRIC_FUNCTIONS[name]
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(f(F.col(y), F.col(p))).alias(k) for k, f in sums.items()])
    return out.select(*by, finish(F.col("n"), **{k: F.col(k) for k in sums}).alias(name))


def lineage(programs: DataFrame, code: str = "code") -> DataFrame:
    """One row a feature of programs (program_id, code) written as df['x'] = ... lines: feature, source_fields, operators, code_sha256."""
    line = F.explode(F.split(code, "\n")).alias("line")
    rows = programs.select("program_id", F.sha2(code, 256).alias("code_sha256"), line).where(F.col("line").rlike(r"^\s*df\['\w+'\]\s*="))
    right = F.regexp_extract("line", r"^\s*df\['\w+'\]\s*=(.*)$", 1)
    return rows.select(
        "program_id", F.regexp_extract("line", r"^\s*df\['(\w+)'\]", 1).alias("feature"), F.array_sort(F.array_distinct(F.regexp_extract_all(right, F.lit(r"df\['(\w+)'\]"), F.lit(1)))).alias("source_fields"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(right, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\("), F.lit(1)))).alias("operators"), "code_sha256",
    )


def f_test(df: DataFrame, names: list[str], y: str) -> DataFrame:
    """name and f of each feature's univariate linear regression: r^2 / (1 - r^2) * (n - 2), all in one pass."""
    correlation = lambda n: F.try_divide(F.covar_pop(n, y), F.stddev_pop(n) * F.stddev_pop(y))  # noqa: E731  a constant has none
    row = df.agg(F.count("*").alias("_n"), *[correlation(n).alias(n) for n in names])
    long = row.unpivot(["_n"], names, "name", "r")
    return long.select("name", (F.try_divide(F.pow("r", 2), 1 - F.pow("r", 2)) * (F.col("_n") - 2)).alias("f"))


def mutual_information(df: DataFrame, names: list[str], y: str, edges: dict[str, list[float]]) -> DataFrame:
    """name and mi (nats) of each feature, binned at the edges, with a class column."""
    binned = {n: sum((F.when(F.col(n) > e, 1).otherwise(0) for e in edges[n]), F.lit(0)) for n in names}
    long = df.select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), b.alias("b")) for n, b in binned.items()])).alias("x")).select("y", "x.*")
    cells = long.groupBy("name", "b", "y").agg(F.count("*").cast("double").alias("n"))
    w = lambda *c: F.sum("n").over(Window.partitionBy("name", *c))
    p = cells.select("name", (F.col("n") / w()).alias("p"), (F.col("n") * w() / (w("b") * w("y"))).alias("lift"))
    return p.groupBy("name").agg(F.sum(F.col("p") * F.log("lift")).alias("mi"))


def split_gain(df: DataFrame, names: list[str]) -> DataFrame:
    """name and silhouette-like gain of the best two-means cut of each column: 1 - within / total sum of squares.

    Cuts lie between distinct values; sums before a cut are running sums over distinct values.
    """
    from tessera.operators.ranking import running, value_bucket

    long = df.unpivot([], names, "name", "x").where("x is not null").groupBy("name", "x").agg(F.count("*").alias("n"))
    sums = running(long, value_bucket("x"), [F.col("x")], {"k": F.col("n"), "s": F.col("n") * F.col("x")}, ["name"])
    total = long.groupBy("name").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("x")).alias("whole"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("squares"))
    joined = sums.join(total, "name").where("k < rows")
    part = F.pow("s", 2) / F.col("k") + F.pow(F.col("whole") - F.col("s"), 2) / (F.col("rows") - F.col("k")) - F.pow("whole", 2) / F.col("rows")
    return joined.groupBy("name").agg(F.max(part / (F.col("squares") - F.pow("whole", 2) / F.col("rows"))).alias("gain"))
