"""Clusterers that see each row once or less: mini-batch k-means and clustering-feature trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.sources.shared import fresh_dir, written


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(points: np.ndarray, centres: np.ndarray, block_bytes: int = 1 << 25) -> np.ndarray:
    """Each point's nearest centre, the first of several: by a matrix product, some 32 MB of distances at a time."""
    step = max(1, block_bytes // (8 * max(1, len(centres))))
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((half - points[i : i + step] @ centres.T).argmin(axis=1) for i in range(0, len(points), step))])


@dataclass(frozen=True)
class Centres:
    """Clusters by the nearest of some centres, which may share labels."""

    centres: np.ndarray
    labels: np.ndarray

    def transform(self, df: DataFrame, label: str = "label") -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast((self.centres, self.labels))

        @pandas_udf("int")
        def of(values):
            import pandas as pd

            centres, labels = held.value
            return pd.Series(labels[nearest(np.stack(values), centres)] if len(values) else [], dtype="int32")

        return df.withColumn(label, of(vector_to_array("features")))


def cluster_sums(df: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of df are nearest to each centre, and the sums of their features; a task sends a row a centre."""
    k, width = centres.shape
    held = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, width))
        for batch in batches:
            points = _matrix(batch.column(0), width)
            of = nearest(points, held.value)
            n += np.bincount(of, minlength=k)
            np.add.at(sums, of, points)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"c": pa.array(some, pa.int32()), "n": pa.array(n[some]), "sums": pa.array(list(sums[some]), pa.list_(pa.float64()))})

    told = df.select(vector_to_array("features").alias("v")).mapInArrow(run, "c int, n long, sums array<double>")
    each = told.select("c", F.posexplode(F.concat(F.array(F.col("n").cast("double")), "sums")).alias("i", "x")).groupBy("c", "i").agg(F.sum("x"))
    out = np.zeros((k, width + 1))
    for c, i, x in each.collect():  # centres times features
        out[c, i] = x
    return out[:, 0], out[:, 1:]


def started(df: DataFrame, k: int, seed: int, **params) -> np.ndarray:
    """k-means centres of df (features, and perhaps the weight n), a table of some thousand rows: no more than it has distinct rows, which then are the centres themselves.

    KMeans may draw fewer than k places to start from, and fails on them or gives fewer; k distinct rows drawn at random start it then.
    """
    weighted = "n" in df.columns
    places = df.select(vector_to_array("features").alias("v"), F.col("n") if weighted else F.lit(1.0).alias("n")).groupBy("v").agg(F.sum("n").alias("n"))
    places = written(places.select(array_to_vector("v").alias("features"), "n"), "distinct-rows")
    if places.count() <= k:
        return np.array([r["features"].toArray() for r in places.orderBy(F.xxhash64(vector_to_array("features"))).collect()])  # at most k rows
    fitted = KMeans(k=k, seed=seed, featuresCol="features", **({"weightCol": "n"} if weighted else {}), **params)
    try:
        centres = np.array(fitted.fit(df).clusterCenters())
    except Py4JJavaError as e:
        if "ArrayIndexOutOfBounds" not in str(e):
            raise
        centres = np.zeros((0, 0))
    return centres if len(centres) == k else np.array(fitted.copy().setInitMode("random").setWeightCol("n").fit(places).clusterCenters())


def minibatch_kmeans(df: DataFrame, k: int, seed: int = 42, batch_rows: int = 2048, steps: int = 10, row_id: str | None = None) -> Centres:
    """k centres from hashed batches of about batch_rows rows: each moves a centre towards its rows' mean by their share of all rows it has had.

    df has features, vectors of one width, and perhaps row_id to hash, else the features are. At most `steps` batches are written, each a folder of its own, so a
    step reads its rows only; a table of fewer rows comes round again in the same batches. Rows with a null vector are
    left out; a centre that no batch reaches stays at its start. There are fewer than k if the first batch has fewer distinct rows.
    """
    spark = df.sparkSession
    df = df.where("features is not null")
    n = df.count()
    parts = max(1, min(steps, n // batch_rows))
    share = min(1.0, parts * batch_rows / max(1, n)) if parts > 1 else 1.0
    spot = F.pmod(F.xxhash64(F.lit(seed), F.col(row_id) if row_id else vector_to_array("features")), F.lit(1 << 30)) / float(1 << 30)
    path = fresh_dir(spark, "batches")
    df.select("features", F.floor(spot * (parts / share)).cast("int").alias("_batch")).where(F.col("_batch") < parts).write.partitionBy("_batch").parquet(path)
    batch = lambda i: spark.read.parquet(f"{path}/_batch={i}")
    present = sorted(int(r[0]) for r in spark.read.parquet(path).select("_batch").distinct().collect())  # batches
    centres = started(batch(present[0]), k, seed, maxIter=1)
    held = np.zeros(len(centres))
    for step in range(steps):
        n_c, sums = cluster_sums(batch(present[step % len(present)]), centres)
        held += n_c
        centres = centres + np.where(n_c[:, None] > 0, (sums - n_c[:, None] * centres) / np.maximum(held, 1)[:, None], 0.0)
    return Centres(centres, np.arange(len(centres)))


class _Node:
    """Entries (count, sum, sum of squares) side by side, each with a child unless this is a leaf."""

    def __init__(self, width: int, branching: int, leaf: bool):
        self.n, self.sums, self.squares, self.size = np.zeros(branching + 1), np.zeros((branching + 1, width)), np.zeros(branching + 1), 0
        self.children: list[_Node] | None = None if leaf else []

    def closest(self, point: np.ndarray) -> int:
        return int((((self.sums[: self.size] / self.n[: self.size, None]) - point) ** 2).sum(axis=1).argmin())

    def add(self, i: int, n: float, sums: np.ndarray, squares: float) -> None:
        self.n[i] += n
        self.sums[i] += sums
        self.squares[i] += squares

    def append(self, n: float, sums: np.ndarray, squares: float, child: _Node | None = None) -> None:
        self.n[self.size], self.sums[self.size], self.squares[self.size] = n, sums, squares
        self.size += 1
        if self.children is not None:
            self.children.append(child)


class FeatureTree:
    """A clustering-feature tree: points within `threshold` (root mean square from their mean) share an entry.

    When more than `most` entries are needed entries join those that suit them best, the threshold grows to what that needs,
    and they go into a new tree, so a tree's memory does not grow with its points. Doubling the threshold would, where many
    features put all points about equally far apart, leave a handful of entries.
    """

    def __init__(self, width: int, threshold: float, most: int = 2000, branching: int = 50):
        self.width, self.threshold, self.most, self.branching = width, threshold, most, branching
        self.root, self.entries, self.growing = _Node(width, branching, True), 0, False

    def insert(self, n: float, sums: np.ndarray, squares: float) -> None:
        node, path, point = self.root, [], sums / n
        while node.children is not None:
            i = node.closest(point)
            path.append((node, i))
            node = node.children[i]
        if node.size:
            i = node.closest(point)
            many, whole, square = node.n[i] + n, node.sums[i] + sums, node.squares[i] + squares
            if square / many - ((whole / many) ** 2).sum() <= self.threshold**2:
                node.add(i, n, sums, squares)
                for up, at in path:
                    up.add(at, n, sums, squares)
                return
        node.append(n, sums, squares)
        self.entries += 1
        for up, at in path:
            up.add(at, n, sums, squares)
        while node.size > self.branching:
            halves = self._split(node)
            if not path:
                self.root = _Node(self.width, self.branching, False)
                for half in halves:
                    self.root.append(half.n[: half.size].sum(), half.sums[: half.size].sum(axis=0), half.squares[: half.size].sum(), half)
                break
            node, at = path.pop()
            for k, half in enumerate(halves):
                values = half.n[: half.size].sum(), half.sums[: half.size].sum(axis=0), half.squares[: half.size].sum()
                if k:
                    node.append(*values, half)
                else:
                    node.n[at], node.sums[at], node.squares[at] = values
                    node.children[at] = half
        if self.entries > self.most and not self.growing:
            self._grow()

    def _grow(self) -> None:
        """At most three quarters of the entries in a new tree: each joins the one that suits it best, the best first, while both together are within the threshold that three quarters would need."""
        held = list(self.leaves())
        while len(held) > max(1, 0.75 * self.most):
            radius, partner = self._partners(held)
            self.threshold = max(self.threshold, float(np.quantile(radius, 0.75)) * (1 + 1e-12), 1e-12)
            into, joined = list(range(len(held))), list(held)
            for i in np.argsort(radius, kind="stable").tolist():
                a, b = i, int(partner[i])
                while into[a] != a:
                    a = into[a]
                while into[b] != b:
                    b = into[b]
                n, sums, squares = (x + y for x, y in zip(joined[a], joined[b], strict=True))
                if a != b and (squares / n - ((sums / n) ** 2).sum() <= self.threshold**2):
                    into[b], joined[a] = a, (n, sums, squares)
            left = [joined[i] for i in range(len(held)) if into[i] == i]
            if len(left) == len(held):
                self.threshold *= 1.01
            held = left
        self.root, self.entries, self.growing = _Node(self.width, self.branching, True), 0, True
        for entry in held:
            self.insert(*entry)
        self.growing = False

    @staticmethod
    def _partners(held: list[tuple[float, np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each entry, the least root mean square from the mean that it can have together with another one, and which that is."""
        n, sums, squares = (np.array(x) for x in zip(*held, strict=True))
        norms, out, at = (sums**2).sum(axis=1), np.empty(len(n)), np.empty(len(n), np.int64)
        for low in range(0, len(n), 256):
            part = slice(low, low + 256)
            many = n[part, None] + n
            square = (squares[part, None] + squares) / many - (norms[part, None] + norms + 2 * sums[part] @ sums.T) / many**2
            square[np.arange(len(square)), np.arange(low, low + len(square))] = np.inf
            at[part] = square.argmin(axis=1)
            out[part] = square[np.arange(len(square)), at[part]]
        return np.sqrt(np.maximum(out, 0.0)), at

    def _split(self, node: _Node) -> tuple[_Node, _Node]:
        """The entries by the nearer of the two that are farthest apart."""
        mean = node.sums[: node.size] / node.n[: node.size, None]
        apart = ((mean[:, None, :] - mean[None, :, :]) ** 2).sum(axis=2)
        a, b = np.unravel_index(int(apart.argmax()), apart.shape)
        halves = tuple(_Node(self.width, self.branching, node.children is None) for _ in range(2))
        for i in range(node.size):
            second = apart[i, b] < apart[i, a] if i not in (a, b) or a == b else i == b
            if a == b:  # all alike: half and half
                second = i >= node.size // 2
            halves[int(second)].append(node.n[i], node.sums[i].copy(), node.squares[i], None if node.children is None else node.children[i])
        return halves

    def leaves(self, node: _Node | None = None) -> Iterator[tuple[float, np.ndarray, float]]:
        node = node or self.root
        for i in range(node.size):
            if node.children is None:
                yield float(node.n[i]), node.sums[i].copy(), float(node.squares[i])
            else:
                yield from self.leaves(node.children[i])


_ENTRY = "n double, sums array<double>, squares double"


def _inserted(rows: DataFrame, threshold: float, most: int) -> DataFrame:
    """The leaf entries of each task's tree over rows (n, sums, squares)."""

    def run(batches):
        tree = None
        for batch in batches:
            n, squares = (batch.column(c).to_numpy() for c in ("n", "squares"))
            if not len(n):
                continue
            width = len(batch.column("sums")[0])
            tree = tree or FeatureTree(width, threshold, most)
            for entry in zip(n.tolist(), _matrix(batch.column("sums"), width), squares.tolist(), strict=True):
                if np.isfinite(entry[2]):
                    tree.insert(*entry)
        if tree is not None and tree.entries:
            n, sums, squares = zip(*tree.leaves(), strict=True)
            yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.float64()), "sums": pa.array(sums, pa.list_(pa.float64())), "squares": pa.array(squares, pa.float64())})

    return rows.select("n", "sums", "squares").mapInArrow(run, _ENTRY)


def feature_entries(df: DataFrame, threshold: float = 0.5, most: int = 2000) -> DataFrame:
    """n, sums, squares of at most `most` entries that together hold every row of df once; rows with a null vector, or a number in it that is not finite, are left out.

    Every task builds a tree over its own rows; while there are more than `most` entries, an eighth of as many tasks
    build trees over those, as entries add up. The last task so has at most some eight trees' entries.
    """
    v = vector_to_array("features")
    rows = df.where("features is not null").select(F.lit(1.0).alias("n"), v.alias("sums"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("squares"))
    entries = written(_inserted(rows, threshold, most), "tree-entries")
    n = entries.count()
    while n > most:
        entries = written(_inserted(entries.repartition(-(-n // (8 * most))), threshold, most), "tree-entries")
        n = entries.count()
    return entries


def birch(df: DataFrame, k: int, threshold: float = 0.5, most: int = 2000, seed: int = 42) -> Centres:
    """Labels by the nearest tree entry; entries are clustered by k-means, each weighing as many rows as it holds. There are fewer than k labels if there are fewer distinct entries."""
    entries = written(feature_entries(df, threshold, most).select("n", array_to_vector(F.transform("sums", lambda x: x / F.col("n"))).alias("features")), "tree-centres")
    centres = started(entries, k, seed)
    places = np.array([r["features"].toArray() for r in entries.collect()])  # at most `most` rows
    return Centres(places, nearest(places, centres).astype(np.int32))


@dataclass(frozen=True)
class MiniBatchKMeans:
    """minibatch_kmeans as an estimator: fit(df) gives a model with transform(df)."""

    k: int
    seed: int = 42
    batch_rows: int = 2048
    steps: int = 10

    def fit(self, df: DataFrame) -> Centres:
        return minibatch_kmeans(df, self.k, self.seed, self.batch_rows, self.steps)


@dataclass(frozen=True)
class Birch:
    """birch as an estimator."""

    k: int
    seed: int = 42
    threshold: float = 0.5
    most: int = 2000

    def fit(self, df: DataFrame) -> Centres:
        return birch(df, self.k, self.threshold, self.most, self.seed)
