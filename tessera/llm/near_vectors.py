"""Near-duplicate vectors by cosine: Euclidean p-stable hashing of normalised vectors in several tables, then exact checks.

A hash is floor((a . v + b) / width) for a Gaussian a; a table's bucket joins several. The number of hashes grows with
the logarithm of the number of vectors, so that a bucket holds a bounded number of unrelated ones on average, and the
number of tables follows from the probability with which a pair at the threshold may be missed. Buckets of any size
are compared in square blocks; a pair that meets in several tables counts in the first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, table, written
from tessera.llm.words import mix

WIDTH = 2.0


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one p-stable (Gaussian) hash of the width puts two points at the distance together."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, threshold: float, miss: float = 0.01, mates: int = 16) -> tuple[int, int]:
    """(hashes a table, tables): unrelated vectors (a right angle) share a bucket with about `mates` others."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    hashes = max(2, math.ceil(math.log(max(n / mates, 2)) / -math.log(far)))
    return hashes, math.ceil(math.log(miss) / math.log(1 - near**hashes))


def _unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def hashed(vectors: DataFrame, threshold: float, n: int) -> DataFrame:
    """vectors (vec_id, n, vector) with buckets, one a table."""
    hashes, tables = parameters(n, threshold)

    def run(batches):
        planes: dict[int, tuple] = {}
        for batch in batches:
            vector = batch.column("vector")
            sizes = np.diff(np.asarray(vector.offsets))
            out: list = [None] * len(batch)
            values = vector.values.to_numpy(zero_copy_only=False)
            begin = np.asarray(vector.offsets)[:-1]
            for size in np.unique(sizes).tolist():
                if size not in planes:
                    rng = np.random.default_rng(size)
                    planes[size] = rng.standard_normal((size, hashes * tables)), rng.uniform(0, WIDTH, hashes * tables)
                a, b = planes[size]
                rows = np.flatnonzero(sizes == size)
                for part in np.array_split(rows, -(-len(rows) // 1024)):
                    unit = _unit(values[begin[part][:, None] + np.arange(size)])
                    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(part), tables, hashes)
                    bucket = np.full(cells.shape[:2], size, np.uint64)
                    for k in range(hashes):
                        bucket = mix(bucket * np.uint64(0xE7037ED1A0B428DB) + cells[:, :, k])
                    for i, row in zip(part.tolist(), bucket.view(np.int64), strict=True):
                        out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "buckets"])

    return vectors.mapInArrow(run, "vec_id long, n long, vector array<double>, buckets array<bigint>" if dict(vectors.dtypes)["vector"] == "array<double>" else "vec_id long, n long, vector array<float>, buckets array<bigint>")


def _compare(ids, weights, unit, buckets, side, number, threshold):
    """Links inside a block (side all 0) or between its sides: (vec_id, linked weight, smallest vec_id joined to it here)."""
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    if side.any():
        near &= side[:, None] != side[None, :]
    if not near.any():
        return None
    counted = near.copy()
    a, b = np.nonzero(near)
    if number and len(a):
        for low in range(0, len(a), 1 << 18):
            x, y = a[low : low + (1 << 18)], b[low : low + (1 << 18)]
            earlier = (buckets[x, :number] == buckets[y, :number]).any(axis=1)
            counted[x[earlier], y[earlier]] = False
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[order] = np.arange(len(ids))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(ids)).min(axis=1))
        if (low == label).all():
            break
        label = low
    some = near.any(axis=1)
    return ids[some], (counted @ weights)[some], ids[order][label[some]]


def linked(found: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """vec_id, links (weight of linked vectors), root for each block of each bucket; buckets of one vector have none."""
    cells = found.select("vec_id", F.posexplode("buckets").alias("number", "bucket"))
    sizes = written(cells.groupBy("number", "bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
    shared = cells.join(sizes, ["number", "bucket"])
    chunks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")
    blocks = shared.withColumn("chunks", chunks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = blocks.select("vec_id", "number", "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"))
    met = blocks.join(found, "vec_id").withColumn("buckets", F.expr("slice(buckets, 1, number)"))  # only those of the tables before
    met = met.repartition("number", "bucket", "i", "j").sortWithinPartitions("number", "bucket", "i", "j")

    def run(batches):
        rest = None
        out: list = []

        def groups(done: pa.Table):
            if not len(done):
                return
            key = np.stack([done.column(c).to_numpy().astype(np.int64) for c in ("number", "bucket", "i", "j")])
            cut = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]]))
            done = done.combine_chunks()
            ids, weights, side = (done.column(c).to_numpy() for c in ("vec_id", "n", "side"))
            vector, buckets = (done.column(c).chunk(0).flatten().to_numpy(zero_copy_only=False) for c in ("vector", "buckets"))
            began = np.concatenate([[0], np.cumsum(key[0])])
            width = np.diff(np.asarray(done.column("vector").chunk(0).offsets))
            at = np.concatenate([[0], np.cumsum(width)])
            for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if high - low < 2:
                    continue
                unit = _unit(vector[at[low] : at[high]].reshape(high - low, -1))  # a bucket's vectors have one length
                number = int(key[0, low])
                links = _compare(ids[low:high], weights[low:high], unit, buckets[began[low] : began[high]].reshape(high - low, number), side[low:high], number, threshold)
                if links:
                    out.append(links)

        def flush():
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["vec_id", "links", "root"])
                out.clear()

        for batch in batches:
            now = pa.Table.from_batches([batch])
            if rest is not None:
                now = pa.concat_tables([rest, now])
            last = {c: now.column(c)[-1].as_py() for c in ("number", "bucket", "i", "j")}
            same = np.logical_and.reduce([now.column(c).to_numpy() == v for c, v in last.items()])
            first = len(now) - (int(np.argmin(same[::-1])) if not same.all() else len(now))
            groups(now.slice(0, first))
            rest = now.slice(first)
            yield from flush()
        if rest is not None:
            groups(rest)
            yield from flush()

    return met.select("number", "bucket", "i", "j", "side", "vec_id", "n", "vector", "buckets").mapInArrow(run, "vec_id long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, per_task: int = 20_000) -> DataFrame:
    """vec_id, n_links (other vectors with cosine >= threshold), component_id (smallest vec_id reachable), kept.

    Equal vectors are one class with a weight, so copies of one vector never meet each other; all of them are linked.
    Vectors that are null, empty or zero, or that hold nulls, NaN or infinities link with nothing, as do those with a
    null vec_id (component_id null, kept false). Vectors of different lengths never link. Rows that are repeated count
    as other vectors. Other columns are ignored; an empty table gives no rows.
    """
    kind = "double" if dict(vectors.dtypes)["embedding"] == "array<double>" else "float"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    sound = F.expr("vec_id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit("other"), "vector"))
    members = rows.select("vec_id", "sound", "k1", "k2")
    classes = rows.where("sound").groupBy("k1", "k2").agg(F.min("vec_id").alias("class"), F.count("*").alias("n"), F.any_value("vector").alias("vector"))
    classes = written(classes, "vector-classes")
    found = written(hashed(classes.select(F.col("class").alias("vec_id"), "n", "vector"), threshold, classes.count()), "vector-buckets")
    links = written(linked(found, threshold), "vector-links")
    total = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    named = classes.select("k1", "k2", "n", F.col("class").alias("vec_id")).join(total, "vec_id", "left").join(joined.withColumnRenamed("vertex", "vec_id"), "vec_id", "left")
    named = named.select("k1", "k2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    salts = F.greatest(F.ceil(F.col("n") / per_task), F.lit(1)).cast("int")
    hot = named.where(F.col("n") > per_task).select("k1", "k2", salts.alias("salts"))
    dealt = members.join(hot, ["k1", "k2"], "left").withColumn("salt", F.when(F.col("sound"), F.pmod(F.xxhash64("vec_id"), F.coalesce("salts", F.lit(1))).cast("int")))
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    out = dealt.join(spread, ["k1", "k2", "salt"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op2_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
"""
