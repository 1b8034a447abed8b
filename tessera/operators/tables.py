"""Joins, aggregations, windows, selections and reshaping of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import row_hash


def grouped_summary(df: DataFrame, by: list[str], metrics: list[str], single_std: float | None = 0.0) -> DataFrame:
    """mean, sample deviation and count of each metric, nulls skipped; the deviation of one value is single_std."""
    out = []
    for m in metrics:
        out += [F.avg(m).alias(f"{m}_mean"), F.when(F.count(m) == 1, F.lit(single_std).cast("double")).otherwise(F.stddev_samp(m)).alias(f"{m}_std"), F.count(m).alias(f"{m}_n")]
    return df.groupBy(*by).agg(*out)


def two_level(df: DataFrame, outer: str, inner: str, aggs: list[Column], label: str = "ALL") -> DataFrame:
    """Totals for each outer key (inner = label) and for each pair, from one pass."""
    sets = [[F.col(outer)], [F.col(outer), F.col(inner)]]
    grouped = df.groupingSets(sets, F.col(outer), F.col(inner)).agg(F.grouping(inner).alias("_g"), *aggs)
    return grouped.withColumn(inner, F.when(F.col("_g") == 1, label).otherwise(F.col(inner))).drop("_g")


def win_tie_loss(df: DataFrame, base: DataFrame, keys: list[str], by: list[str], value: str, higher: bool, tolerance: float = 1e-12) -> DataFrame:
    """wins, ties and losses of rows against the base row with the same keys, and margin."""
    joined = df.join(base.select(*keys, F.col(value).alias("_base")), keys)
    gain = (F.col(value) - F.col("_base")) * (1 if higher else -1)
    out = joined.groupBy(*by).agg(F.count_if(gain > tolerance).alias("win"), F.count_if(F.abs(gain) <= tolerance).alias("tie"), F.count_if(gain < -tolerance).alias("loss"))
    return out.withColumn("margin", F.col("win") - F.col("loss"))


def best_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in `order`. Spark cuts every group to its first row inside each partition before the
    shuffle (WindowGroupLimit), so a group sends a row a partition, however many it has."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def class_cap(df: DataFrame, target: str, most: int) -> DataFrame:
    """Rows of the first `most` classes in their order."""
    return df.join(df.select(target).distinct().orderBy(target).limit(most), target, "left_semi").select(*df.columns)


def row_cap(df: DataFrame, most: int, seed: int, row_id: str, by: list[str] | None = None) -> DataFrame:
    """The `most` rows of the least hash of each group, or all if there are no more."""
    from tessera.operators.ranking import hash_threshold

    return hash_threshold(df, seed, row_id, F.lit(most), by, "_taken").where("_taken").drop("_taken")


def adaptive_threshold(df: DataFrame, by: list[str], values: list[str], share: float, most: int, ties: list[str]) -> DataFrame:
    """Rows of which every value is at least `share` of its group's greatest, the `most` of greatest sum, ties by columns."""
    tops = df.groupBy(*by).agg(*[F.max(v).alias(f"_top_{v}") for v in values])
    kept = df.join(tops, by).where(" and ".join(f"{v} >= {share}D * _top_{v}" for v in values)).drop(*[f"_top_{v}" for v in values])
    order = [sum((F.col(v) for v in values[1:]), F.col(values[0])).desc(), *map(F.col, ties)]
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def gap_selection(df: DataFrame, by: list[str], value: str, gap: float, least: int, most: int, ties: list[str]) -> DataFrame:
    """Of each group's `most` lowest rows, those within a relative gap of the best, and the `least` first in any case."""
    best = df.groupBy(*by).agg(F.min(value).alias("_best"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(value, *ties))).where(F.col("_r") <= most)
    return ranked.join(best, by).where((F.col(value) <= F.col("_best") * (1 + gap)) | (F.col("_r") <= least)).drop("_r", "_best")


def merge_by_keys(records: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """records with the values of `extra` that are there for their keys; its other columns are added, null where it has no row."""
    shared = [c for c in records.columns if c in extra.columns and c not in keys]
    named = extra.withColumnsRenamed({c: f"_new_{c}" for c in shared})
    joined = records.join(named, keys, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in shared}).drop(*[f"_new_{c}" for c in shared]).select(*records.columns, *[c for c in extra.columns if c not in keys and c not in shared])


def min_max(df: DataFrame, by: list[str], value: str, higher: bool, to: str = "score") -> DataFrame:
    """Values scaled to [0, 1] inside each group, 1 the best; a group without spread gives 1."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    scaled = (F.col(value) - low) / (high - low) if higher else (high - F.col(value)) / (high - low)
    return df.withColumn(to, F.when(high - low < 1e-12, 1.0).otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))))


def bootstrap_ci(df: DataFrame, by: list[str], value: str, position: str, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """mean, ci_low and ci_high of each group by resampled means. Groups are small report groups, numbered by `position` from 0.

    Replicate r draws for each place the row whose position is hash(r, place) modulo the group's size.
    """
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(value).alias("mean"))
    draws = sizes.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_place", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    draws = draws.withColumn(position, F.pmod(row_hash(seed, "_r", "_place"), F.col("_n")))
    means = draws.join(df.select(*by, position, value), [*by, position]).groupBy(*by, "mean", "_r").agg(F.avg(value).alias("_m"))
    tail = (1 - level) / 2
    ends = F.percentile("_m", F.array(F.lit(tail), F.lit(1 - tail)))
    return means.groupBy(*by, "mean").agg(ends.alias("_e")).select(*by, "mean", F.col("_e")[0].alias("ci_low"), F.col("_e")[1].alias("ci_high"))


def mean_std_text(mean: Column, std: Column, digits: int = 2) -> Column:
    return F.when(mean.isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f±%.{digits}f", mean, std))


def reasons(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, joined by semicolons."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()])), ";")


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) >= 1e-12, a / b)


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a successful result."""
    return jobs.join(done.where("status = 'completed'").select(*keys).distinct(), keys, "left_anti")


def coverage_grid(dims: list[DataFrame], actual: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected combination of small dimension tables, with `present`."""
    grid = dims[0]
    for d in dims[1:]:
        grid = grid.crossJoin(d)
    found = actual.select(*keys).distinct().withColumn("present", F.lit(True))
    return grid.join(found, keys, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def greedy_uncorrelated(df: DataFrame, names: list[str], cut: float = 0.995, most: int = 5) -> list[str]:
    """Columns in the given order, without those whose |correlation| to one taken before reaches the cut. One pass for all pairs."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).first() if pairs else {}
    taken: list[str] = []
    for name in names:
        if len(taken) < most and all(abs(row[f"{t}|{name}"] or 0.0) < cut for t in taken):
            taken.append(name)
    return taken
