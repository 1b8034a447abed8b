"""Typing, encoding and imputing of task tables; whatever is fitted is fitted on one frame and applied to any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import linear_quantiles, range_rank
from tessera.sources.shared import written

#: What counts as yes and no in a target, and the marks of missing categories.
POSITIVE, NEGATIVE = ("1", "pos", "positive", "t", "true", "y", "yes"), ("0", "f", "false", "n", "neg", "negative", "no")
MISSING, MISSING_UPPER = "__missing__", "__MISSING__"


def finite(name: str) -> Column:
    """The column with NaN and infinities as null."""
    c = F.col(name)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clean(df: DataFrame, fill: float | None = None) -> DataFrame:
    """NaN and infinities to null in all floating columns; `fill` then replaces nulls."""
    out = [(finite(n) if fill is None else F.coalesce(finite(n), F.lit(fill))).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes]
    return df.select(*out)


def numeric_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Those of the columns of which every value that is there parses as a number; one pass for all."""
    bad = df.agg(*[F.count_if(F.col(n).isNotNull() & F.expr(f"try_cast(`{n}` as double)").isNull()).alias(n) for n in names]).first()
    return [n for n in names if bad[n] == 0]


def coerce(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns that parse as a whole become double, the others stay."""
    return df.withColumns({n: F.expr(f"try_cast(`{n}` as double)") for n in numeric_columns(df, names)})


def target_to_int(name: str) -> Column:
    """1 and 0 for the usual words, rounded numbers for numbers, null for the rest."""
    text = F.lower(F.trim(F.col(name).cast("string")))
    number = F.expr(f"try_cast(`{name}` as double)")
    return F.when(text.isin(*POSITIVE), 1).when(text.isin(*NEGATIVE), 0).otherwise(F.round(number)).cast("int")


def mappings(df: DataFrame, names: list[str], missing: str | None = MISSING) -> DataFrame:
    """(name, value, code) of several columns: the sorted distinct values of each, from 0. One pass over df for all; a written table of a row a category; `missing` stands for null."""
    def value(name: str) -> Column:
        text = F.trim(F.col(name).cast("string"))
        return F.coalesce(text, F.lit(missing)) if missing is not None else text

    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), value(n).alias("value")) for n in names])).alias("x")
    ranked = range_rank(df.select(each).select("x.*").where("value is not null").distinct(), ["name", "value"], "_at")
    first = ranked.groupBy("name").agg(F.min("_at").alias("_first"))  # a row a column
    return written(ranked.join(F.broadcast(first), "name").select("name", "value", (F.col("_at") - F.col("_first")).cast("int").alias("code")), "categories")


def mapping(df: DataFrame, name: str, missing: str | None = MISSING) -> DataFrame:
    """(value, code) of one column."""
    return mappings(df, [name], missing).drop("name")


def of_column(codes: DataFrame, name: str) -> DataFrame:
    """One column's (value, code) out of those of several."""
    return codes.where(F.col("name") == name).drop("name")


def apply_mapping(df: DataFrame, codes: DataFrame, name: str, unknown: int = -1, missing: str | None = MISSING, to: str | None = None) -> DataFrame:
    """df with name (or `to`) as its code; values that the fitted frame never had get `unknown`."""
    value = F.trim(F.col(name).cast("string"))
    keyed = df.withColumn("_value", F.coalesce(value, F.lit(missing)) if missing is not None else value)
    joined = keyed.join(codes.select(F.col("value").alias("_value"), F.col("code").alias("_code")), "_value", "left")
    return joined.withColumn(to or name, F.coalesce("_code", F.lit(unknown))).drop("_value", "_code")


def encode(fit: DataFrame, df: DataFrame, names: list[str], unknown: int = -1) -> DataFrame:
    """All the columns of df by the categories of `fit`."""
    codes = mappings(fit, names) if names else None
    for name in names:
        df = apply_mapping(df, of_column(codes, name), name, unknown)
    return df


def encode_split(df: DataFrame, names: list[str], fit_on: str = "train", unknown: int = -1) -> DataFrame:
    """df (with split) by the categories of its training rows, or with fit_on="all" of all rows, test vocabulary included."""
    if fit_on not in ("train", "all"):
        raise ValueError(f"unknown fit_on {fit_on!r}")
    return encode(df.where("split = 'train'") if fit_on == "train" else df, df, names, unknown)


def column_transform(fit: DataFrame, df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """df with nulls, NaN and infinities of numeric columns as 0, and categories as codes of `fit` (null is one, others -1)."""
    df = df.withColumns({n: F.coalesce(finite(n), F.lit(0.0)) for n in numeric})
    codes = mappings(fit, categorical, MISSING_UPPER) if categorical else None
    for name in categorical:
        df = apply_mapping(df, of_column(codes, name), name, missing=MISSING_UPPER)
    return df


def numeric_frame(df: DataFrame) -> DataFrame:
    """Every column as a number: text that does not parse as codes of its sorted values, truth values 0 and 1, nulls and non-finite 0."""
    text = [n for n, t in df.dtypes if t == "string"]
    plain = numeric_columns(df, text) if text else []
    coded = [n for n in text if n not in plain]
    codes = mappings(df, coded, None) if coded else None
    for name in coded:
        df = apply_mapping(df, of_column(codes, name), name, missing=None)
    out = []
    for name, kind in df.dtypes:
        number = F.expr(f"try_cast(`{name}` as double)") if kind == "string" else F.col(name).cast("int") if kind == "boolean" else F.col(name)
        value = F.when(F.isnan(number.cast("double")) | (F.abs(number.cast("double")) == float("inf")), None).otherwise(number)
        out.append(F.coalesce(value, F.lit(0)).alias(name))
    return df.select(*out)


def final_columns(df: DataFrame, original: list[str], selected: list[str], target: str) -> DataFrame:
    """The original columns, then selected ones that are not among them, the target last."""
    names = list(dict.fromkeys([*original, *selected]))
    return df.select(*[n for n in names if n != target], target)


def quantile_row(df: DataFrame, columns: dict[str, Column], levels: list[float]) -> DataFrame:
    """One row with `_q`, a map of name to the exact quantiles of a column: all columns in one pass, as counts of distinct values by name."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in columns.items()])).alias("x")
    found = linear_quantiles(df.select(each).select("x.*"), "value", {f"q{i}": level for i, level in enumerate(levels)}, ["name"])
    return found.agg(F.map_from_entries(F.collect_list(F.struct("name", F.array(*[f"q{i}" for i in range(len(levels))])))).alias("_q"))  # a row a column


def median_fill(fit: DataFrame, df: DataFrame, names: list[str]) -> DataFrame:
    """Nulls to the exact median of `fit` (0 if it has none). One row of medians joins."""
    joined = df.crossJoin(F.broadcast(quantile_row(fit, {n: finite(n) for n in names}, [0.5])))  # one row
    return joined.withColumns({n: F.coalesce(finite(n), F.try_element_at("_q", F.lit(n))[0], F.lit(0.0)) for n in names}).drop("_q")


def standardize(fit: DataFrame, df: DataFrame, names: list[str]) -> DataFrame:
    """(x - mean) / population deviation of `fit`; a constant column is only centred."""
    stats = fit.agg(*[F.struct(F.avg(n).alias("m"), F.stddev_pop(n).alias("s")).alias(f"_s_{n}") for n in names])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    scaled = {n: (F.col(n) - F.col(f"_s_{n}.m")) / F.when(F.col(f"_s_{n}.s") > 0, F.col(f"_s_{n}.s")).otherwise(1.0) for n in names}
    return joined.withColumns(scaled).drop(*[f"_s_{n}" for n in names])


def robust_scale(fit: DataFrame, df: DataFrame, names: list[str]) -> DataFrame:
    """(x - median) / interquartile range of `fit`."""
    joined = df.crossJoin(F.broadcast(quantile_row(fit, {n: F.col(n) for n in names}, [0.25, 0.5, 0.75])))  # one row
    q = {n: F.try_element_at("_q", F.lit(n)) for n in names}
    return joined.withColumns({n: (F.col(n) - q[n][1]) / F.when(q[n][2] > q[n][0], q[n][2] - q[n][0]).otherwise(1.0) for n in names}).drop("_q")


def yeo_johnson(name: str, lam: float) -> Column:
    x = F.col(name)
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, lam) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, 2 - lam) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_fit(df: DataFrame, name: str, grid: list[float] | None = None) -> float:
    """The lambda of greatest log likelihood on a grid; one aggregation for the whole grid."""
    grid = grid or [i / 10 for i in range(-20, 41)]
    jacobian = F.signum(F.col(name)) * F.log1p(F.abs(F.col(name)))
    row = df.agg(F.count(name).alias("n"), F.sum(jacobian).alias("j"), *[F.var_pop(yeo_johnson(name, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
    import math

    score = [(-row["n"] / 2 * math.log(row[f"v{i}"]) + (g - 1) * row["j"], g) for i, g in enumerate(grid) if row[f"v{i}"]]
    return max(score)[1]


def quantile_normal(df: DataFrame, name: str, row_id: str) -> DataFrame:
    """df with the column as the normal score of its mid rank, by bucketed ranks and a rational approximation of the inverse normal."""
    from tessera.operators.ranking import running

    n = df.where(F.col(name).isNotNull()).count()
    edges = df.approxQuantile(name, [i / 64 for i in range(1, 64)], 0.001)
    bucket = sum((F.when(F.col(name) > e, 1).otherwise(0) for e in edges), F.lit(0))
    ranked = running(df.where(F.col(name).isNotNull()), bucket, [F.col(name), F.col(row_id)], {"_r": F.lit(1)})
    p = (F.col("_r") - 0.5) / n
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    # The rational approximation 26.2.23 of Abramowitz and Stegun
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return ranked.withColumn(name, F.when(p < 0.5, -z).otherwise(z)).drop("_r")


def one_hot(fit: DataFrame, df: DataFrame, name: str, most: int = 1000) -> DataFrame:
    """One 0/1 column for each category of `fit` and one for null; others are 0 throughout. More than `most` categories are an error."""
    values = sorted(r[0] for r in fit.select(F.col(name).cast("string")).where(F.col(name).isNotNull()).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"{name} has more than {most} categories, which are no columns")
    hot = {f"{name}_{v}": F.coalesce((F.col(name).cast("string") == v).cast("int"), F.lit(0)) for v in values}
    return df.withColumns(hot | {f"{name}_nan": F.col(name).isNull().cast("int")}).drop(name)


def low_cardinality(df: DataFrame, names: list[str], most: int = 50) -> list[str]:
    """Those of the columns with at most `most` distinct values, in one pass."""
    row = df.agg(*[F.count_distinct(n).alias(n) for n in names]).first()
    return [n for n in names if row[n] <= most]


def to_epoch(name: str) -> Column:
    """Microseconds since 1970 of a timestamp or of text that parses as one, as double."""
    return F.unix_micros(F.try_to_timestamp(F.col(name).cast("string"))).cast("double")


def violations(df: DataFrame) -> dict[str, int]:
    """For each column the number of null, NaN or infinite values; text columns count wholly. One pass."""
    checks = {n: F.count("*") if t == "string" else F.count_if(F.col(n).isNull() | (F.isnan(n) | (F.abs(F.col(n)) == float("inf")) if t in ("double", "float") else F.lit(False))) for n, t in df.dtypes}
    return df.agg(*[c.alias(n) for n, c in checks.items()]).first().asDict()


def require_numeric(df: DataFrame) -> DataFrame:
    """df itself, or an error that names the columns with text, nulls, NaN or infinities."""
    if bad := {n: k for n, k in violations(df).items() if k}:
        raise ValueError(f"not numeric and finite: {bad}")
    return df


def principal_components(fit: DataFrame, share: float = 0.95, standardise: bool = True):
    """A function of a table that replaces `features` by its first principal components, as many as explain `share` of fit's variance.

    One pass gives means and deviations, one the covariances; loadings are applied as array expressions. Each component's
    largest loading is above zero. A constant feature only counts as centred; rows with a null vector keep a null.
    """
    import numpy as np
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scaler = StandardScaler(inputCol="features", outputCol="_s", withMean=True, withStd=True).fit(fit.where("features is not null"))
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    scale = np.where(std > 0, 1 / np.where(std > 0, std, 1), 0.0) if standardise else np.ones(len(mean))
    whole = lambda values: F.array(*[F.lit(float(v)) for v in values])
    x = F.zip_with(F.zip_with(F.when(F.col("features").isNotNull(), vector_to_array("features")), whole(mean), lambda a, m: a - m), whole(scale), lambda a, w: a * w)
    model = PCA(k=len(mean), inputCol="_x", outputCol="_p").fit(fit.where("features is not null").select(array_to_vector(x).alias("_x")))
    explained = model.explainedVariance.toArray()
    many = int(min(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1, len(mean)))
    loadings = model.pc.toArray()[:, :many]
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(many)])

    def apply(df: DataFrame) -> DataFrame:
        centred = df.withColumn("_x", x)
        each = [F.aggregate(F.zip_with("_x", whole(column), lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v) for column in loadings.T]
        return centred.withColumn("features", F.when(F.col("features").isNotNull(), array_to_vector(F.array(*each)))).drop("_x")

    return apply
