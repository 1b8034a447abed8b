"""Consensus of labelings by co-association: spectral clustering of the row-by-row agreement matrix that is never built.

The share of labelings in which two rows agree is S = Z Z' / m with Z the rows' membership of all labels, so the
normalised S has the eigenvectors of a matrix of labels by labels. Rows with the same labels are one signature; one
aggregation over signatures gives that small matrix, the driver its eigenvectors, and each signature its place in the
space that they span.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import written


def signatures(long: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(row_id, cells), the (candidate, label) pairs: each row's labels as places among all pairs, in ascending order."""
    pairs = [tuple(r) for r in long.select("candidate", "label").distinct().orderBy("candidate", "label").collect()]  # labels
    held = long.sparkSession.createDataFrame([(c, x, i) for i, (c, x) in enumerate(pairs)], long.select("candidate", "label").schema.add("cell", "integer"))
    return long.join(F.broadcast(held), ["candidate", "label"]).groupBy("row_id").agg(F.sort_array(F.collect_list("cell")).alias("cells")), pairs


def usual_size(long: DataFrame) -> int:
    """The commonest number of labels of a labeling; the smallest of several."""
    sizes = long.groupBy("candidate").agg(F.count_distinct("label").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return sizes.orderBy(F.desc("n"), "k").first()["k"]  # a row a size


def coassociation_embedding(long: DataFrame, k: int, most_cells: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(row_id, cells) of every row, and (cells, n, features) of every signature: its place by the first k eigenvectors.

    The eigenvectors are those of the random walk over rows whose steps weigh by co-association, steps to the row itself
    included; signs are fixed by the largest share of a cell. A row that a labeling lacks
    agrees there with no row. Labels of all labelings together may be at most most_cells, as their matrix is solved on the
    driver; rows may be any number.
    """
    rows, pairs = signatures(long)
    g, m = len(pairs), len({c for c, _ in pairs})
    if g > most_cells:
        raise ValueError(f"{g} labels in all; at most {most_cells}")
    rows = written(rows, "signatures")
    signed = written(rows.groupBy("cells").agg(F.count("*").alias("n")), "signature-sizes")
    size = np.zeros(g)
    for cell, n in signed.select(F.explode("cells").alias("c"), "n").groupBy("c").agg(F.sum("n")).collect():
        size[cell] = n
    # a row's degree is the mean size of the groups that it lies in
    sizes = F.array(*[F.lit(float(x)) for x in size])
    degree = F.aggregate("cells", F.lit(0.0), lambda a, c: a + F.get(sizes, c)) / m
    signed = signed.withColumn("degree", degree)
    both = signed.select(F.explode("cells").alias("a"), "cells", (F.col("n") / F.col("degree")).alias("w")).select("a", F.explode("cells").alias("b"), "w")
    small = np.zeros((g, g))
    for a, b, w in both.groupBy("a", "b").agg(F.sum("w")).collect():
        small[a, b] = w / m
    value, vector = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-value, kind="stable")[:k]
    vector = vector[:, top] * np.sign(vector[np.abs(vector[:, top]).argmax(axis=0), top])
    cells = vector / np.sqrt(np.maximum(value[top], 1e-12) * m)

    def place(weights: np.ndarray) -> Column:
        held = F.array(*[F.lit(float(x)) for x in weights])
        return F.aggregate("cells", F.lit(0.0), lambda a, c: a + F.get(held, c)) / F.col("degree")

    placed = signed.select("cells", "n", F.array(*[place(x) for x in cells.T]).alias("features"))
    return rows, placed


def coassociation_cut(long: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """row_id and label (from 0 to k - 1) of rows labelled by several candidates: k-means, weighted by rows, over signatures by co-association.

    long has candidate, row_id and label; k is by default the commonest number of labels. Labelings with one label say
    nothing and are left out; without two others it is an error.
    """
    told = long.groupBy("candidate").agg(F.count_distinct("label").alias("k")).where("k > 1")
    used = long.join(F.broadcast(told.select("candidate")), "candidate", "left_semi")  # a row a labeling
    if told.count() < 2:
        raise ValueError("fewer than two labelings with two labels")
    k = k or usual_size(used)
    rows, placed = coassociation_embedding(used, k)
    points = written(placed.withColumn("features", array_to_vector("features")), "signature-places")
    model = KMeans(k=k, seed=seed, initSteps=5, maxIter=100, weightCol="n", featuresCol="features", predictionCol="label").fit(points)
    return rows.join(model.transform(points).select("cells", "label"), "cells").select("row_id", F.col("label").cast("long").alias("label"))
