"""Shared helpers: the shared folder, written tables, Arrow batches of texts and distributed components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import fresh_dir, shared_dir, written  # noqa: F401 - the other modules' way to them

#: Bytes of text that one vectorised step works on; bounds the memory of a task.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, name: str, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets) for runs of rows of at most `most` bytes, or one longer row.

    Null texts count as empty. Offsets are relative to the bytes and one longer than the rows.
    """
    column = batch.column(name)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high, whole[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def local_stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with each partition's own components as stars around their smallest vertex: same components, fewer edges."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        vertices = [v for v in list(parent) if root(v) != v]
        for i in range(0, len(vertices), 65536):
            part = vertices[i : i + 65536]
            yield pa.RecordBatch.from_pydict({"a": pa.array(part, pa.int64()), "b": pa.array([parent[v] for v in part], pa.int64())})

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of edges (a, b), component the smallest vertex reachable.

    Edges become stars inside each partition first. Then large-star and small-star rounds: each takes minima by vertex
    with partial aggregation, and joins them to the edges; the join's partition of a vertex with very many edges is
    split at run time by Spark's skew join. Every round is a written table. Nulls in an edge drop it; an edge from a
    vertex to itself and repeated edges change nothing.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(local_stars(edges).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select("b", "low").where("b <> low").select(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b"))
        edges = written(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        seen = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.count_distinct("a")).first()
        if seen == before or seen[0] == seen[2] and not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(edges.select("b").distinct().select("b", "b"))


def attach(rows: DataFrame, values: DataFrame, key: list[str], size: str, per_task: int = 50_000) -> DataFrame:
    """rows joined to values, one for each key, where a key with `size` rows is dealt over size / per_task salts, by the rows' places in their table."""
    rows = rows.withColumn("_place", F.monotonically_increasing_id())  # before any shuffle, so that a task that runs again gives the same
    salts = F.greatest(F.lit(1), F.ceil(F.col(size) / per_task)).cast("int")
    hot = values.where(F.col(size) > per_task).select(*key, salts.alias("salts"))
    # keys above per_task rows: at most rows / per_task of them
    salted = rows.join(hot, key, "left").withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_place"), F.col("salts")).cast("int"))).drop("salts")
    spread = values.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(spread, [*key, "salt"]).drop("salt", "_place")


def possible_members(ids: DataFrame, spots: int = 33_554_393):
    """A function of an array of ids that is true for every id of ids(id), and for few others while the map has room.

    The map has `spots` bits (a prime), whatever the number of ids, so it may be broadcast; it spares a later join most
    rows, and once it is full it spares none.
    """
    spark = ids.sparkSession
    spot = F.pmod(F.col("id"), F.lit(spots).cast("long")) + 1
    rows = ids.select(F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    whole = np.zeros((spots // 32768 + 1) * 4096, np.uint8)
    for bucket, part in rows.collect():  # 4 KB for each 32768 bits
        low = (bucket - 1) * 4096
        whole[low : low + 4096] = np.frombuffer(part, np.uint8)
    held = spark.sparkContext.broadcast(whole)

    def inside(values: np.ndarray) -> np.ndarray:
        at = np.mod(values.astype(np.int64), spots)
        return (held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    return inside
