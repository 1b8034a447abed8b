"""Global ranks and running sums without a single-partition window: totals by bucket first, windows inside buckets after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKETS = 1024


def hash_buckets(df: DataFrame, per_bucket: int = 65_536) -> int:
    """How many buckets of hashes keep a bucket of df's rows to about per_bucket: a power of two from HASH_BUCKETS to 2^20.

    A count of a written table reads its footers only.
    """
    return min(1 << 20, max(HASH_BUCKETS, 1 << max(0, (df.count() // per_bucket).bit_length())))


def row_hash(seed: int, *columns: str) -> Column:
    """The first 32 bits of md5(seed|columns) as a long: the same integer in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("long")


def running(df: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """df with running sums (own row included) in `order` within `by`.

    `bucket` must not decrease along `order`. Its totals are summed first (a row for each bucket), so a window only
    ever sorts the rows of one bucket.
    """
    by = by or []
    dealt = df.withColumn("_bucket", bucket)
    names = {n: f"_sum_{n}" for n in sums}
    totals = dealt.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(names[n]) for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*by, "_bucket", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in names.values()])
    inner = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *[F.sum(c).over(inner).alias(n) for n, c in sums.items()])
    keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*by, "_bucket"]]
    joined = out.alias("l").join(base.alias("r"), keys)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *[(F.col(f"l.{n}") + F.col(f"r.{v}")).alias(n) for n, v in names.items()])


def value_bucket(name: str, steps: int = 1024) -> Column:
    """A bucket that does not decrease along a numeric column: `steps` to each power of two, so any range of values spreads.

    The number of buckets follows from the powers of two that the values span (some ten thousand for most columns),
    whatever the number of rows. A rounding of the logarithm moves no value past another, as the steps join up.
    """
    x = F.col(name).cast("double")
    size = F.abs(x)
    power = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), power) - 1) * steps)
    code = (power + 1100) * steps + step
    top = 3000 * steps
    finite = F.when(size == float("inf"), top).when(x == 0, 0).otherwise(code)
    return F.when(F.isnan(x), top + 1).otherwise(F.signum(x) * finite).cast("long")


def step_count(x: Column, edges: list[float], strict: bool = False) -> Column:
    """How many of the sorted edges x reaches (passes, if strict), by a binary search written out as an expression."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        there = x > edges[middle] if strict else x >= edges[middle]
        return F.when(there, among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(edges))


def linear_quantiles(df: DataFrame, value: str, levels: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by and the interpolated quantiles (name to level) of each group, exactly: from counts of distinct values by bucket.

    No group's values are held in one task. Nulls are left out; a group without values has no row.
    """
    by = by or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    sizes = counted.groupBy(*by).agg(F.sum("_k").alias("_n"))
    ranked = running(counted, value_bucket("_v"), [F.col("_v")], {"_upto": F.col("_k")}, by)
    keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    joined = ranked.alias("l").join(F.broadcast(sizes).alias("r"), keys).select("l.*", "r._n") if by else ranked.crossJoin(F.broadcast(sizes))  # a row a group
    out = []
    for name, level in levels.items():
        place = (F.col("_n") - 1) * F.lit(float(level))
        low = F.floor(place + 1e-9)
        first = lambda at: F.min(F.when(F.col("_upto") >= at, F.col("_v")))
        share = F.greatest(F.max(place - low), F.lit(0.0))
        a, b = first(low + 1), first(F.least(low + 2, F.col("_n")))
        out.append((a + (b - a) * share).alias(name))
    return joined.groupBy(*by).agg(*out)


def range_rank(df: DataFrame, column: str | list[str], name: str = "rank") -> DataFrame:
    """df with each row's place, from 0, in the order of a column, or of several; every task sorts a range of values of its own."""
    from tessera.sources.shared import written

    column = [column] if isinstance(column, str) else column
    dealt = written(df.repartitionByRange(*column).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*column)) - 1
    return dealt.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + inside).drop("_part", "_base")


def hash_threshold(df: DataFrame, seed: int, row_id: str, quota: Column, by: list[str] | None = None, name: str = "taken") -> DataFrame:
    """df with whether a row is among the `quota` rows of the least hash (then row_id) of its group; quota is of _n, the group's rows.

    Counts by hash bucket find the bucket in which a group's last row lies; only that bucket's rows are sorted. Buckets
    follow the number of rows, so that one stays small.
    """
    by = by or []
    width = (1 << 32) // hash_buckets(df)
    hashed = df.withColumn("_h", row_hash(seed, row_id)).withColumn("_bucket", F.floor(F.col("_h") / width))
    counts = hashed.groupBy(*by, "_bucket").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)
    sums = counts.withColumn("_n", F.sum("_c").over(group)).withColumn("_upto", F.sum("_c").over(group.orderBy("_bucket")))  # a row a bucket and group
    edge = sums.withColumn("_quota", quota).where((F.col("_upto") > F.col("_quota")) & (F.col("_upto") - F.col("_c") <= F.col("_quota")))
    edge = edge.select(*by, F.col("_bucket").alias("_edge"), (F.col("_quota") - F.col("_upto") + F.col("_c")).alias("_rest"))
    keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    met = hashed.alias("l").join(edge.alias("r"), keys, "left").select("l.*", "r._edge", "r._rest") if by else hashed.join(F.broadcast(edge), how="left")  # one row
    sure = met.where(F.col("_edge").isNull() | (F.col("_bucket") != F.col("_edge"))).withColumn(name, F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge")))
    order = Window.partitionBy(*by).orderBy("_h", row_id)
    close = met.where(F.col("_bucket") == F.col("_edge")).withColumn(name, F.row_number().over(order) <= F.col("_rest"))
    return sure.unionByName(close).select(*df.columns, name)


def hash_rank(df: DataFrame, seed: int, row_id: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) in the order of its hash, then row_id, within `by`. Hashes are even, so buckets are too."""
    hashed = df.withColumn("_h", row_hash(seed, row_id))
    width = (1 << 32) // hash_buckets(df)
    ranked = running(hashed, F.floor(F.col("_h") / width), [F.col("_h"), F.col(row_id)], {name: F.lit(1)}, by)
    return ranked.drop("_h")
