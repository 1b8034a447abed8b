"""Internal cluster metrics, label alignment and consensus over label tables."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import HASH_BUCKETS, linear_quantiles, running
from tessera.operators.tables import best_per_group
from tessera.sources.shared import written


def centroids(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"c_{f}") for f in features])


def _squared(features: list[str], a: str = "", b: str = "c_"):
    return sum((F.pow(F.col(a + f) - F.col(b + f), 2) for f in features), F.lit(0.0))


def internal_scores(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """davies_bouldin and calinski_harabasz. Rows meet only their own centroid; centroids (k rows) meet each other."""
    c = centroids(df, label, features)
    inner = df.join(c, label).groupBy(label).agg(F.avg(F.sqrt(_squared(features))).alias("scatter"), F.sum(_squared(features)).alias("within"))
    k = c.join(inner, label)
    other = k.select(F.col(label).alias("_l"), F.col("scatter").alias("_s"), *[F.col(f"c_{f}").alias(f"d_{f}") for f in features])
    apart = k.crossJoin(F.broadcast(other)).where(F.col(label) != F.col("_l"))  # clusters only
    db = apart.groupBy(label).agg(F.max(F.try_divide(F.col("scatter") + F.col("_s"), F.sqrt(_squared(features, "c_", "d_")))).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    mean = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features])
    between = k.crossJoin(F.broadcast(mean)).agg(F.sum(F.col("n") * _squared(features, "c_", "m_")).alias("b"), F.sum("within").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ch = between.select((F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1))).alias("calinski_harabasz"))
    return db.crossJoin(ch)


def confidence(df: DataFrame, label: str, features: list[str], row_id: str) -> DataFrame:
    """1 - distance to the own centroid / the largest such distance."""
    distance = df.join(centroids(df, label, features), label).select(row_id, label, F.sqrt(_squared(features)).alias("_d"))
    top = distance.agg(F.max("_d").alias("_top"))  # one row
    return distance.crossJoin(F.broadcast(top)).select(row_id, label, F.coalesce(1 - F.try_divide("_d", "_top"), F.lit(1.0)).alias("confidence"))


def valid_labelings(long: DataFrame) -> DataFrame:
    """Candidates of (candidate, row_id, label) with more than one label and fewer than rows."""
    return long.groupBy("candidate").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).where("k > 1 and k < n")


def majority_vote(long: DataFrame, weight: str | None = None) -> DataFrame:
    """row_id and its label of most votes (or weight); the smallest label wins a tie."""
    votes = long.groupBy("row_id", "label").agg((F.sum(weight) if weight else F.count("*")).alias("_v"))
    return votes.groupBy("row_id").agg(F.max_by("label", F.struct("_v", -F.col("label"))).alias("label"))


def align_by_overlap(cells: DataFrame, label: str, reference: str, n: str = "n") -> DataFrame:
    """label and the reference label that it overlaps most; the smallest wins a tie. Several labels may share one."""
    return best_per_group(cells, [label], [F.col(n).desc(), F.col(reference)]).select(label, reference)


def _assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of least total cost (shortest augmenting paths with potentials)."""
    turned = cost.shape[0] > cost.shape[1]
    a = cost.T if turned else cost
    n, m = a.shape
    row, column, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[at]:
            done[at] = True
            slack = a[match[at] - 1] - row[match[at]] - column[1:]
            free = ~done[1:]
            better = free & (slack < least[1:])
            least[1:][better] = slack[better]
            back[1:][better] = at
            step = np.where(free, least[1:], np.inf)
            to = int(step.argmin()) + 1
            delta = step[to - 1]
            row[match[done]] += delta
            column[done] -= delta
            least[1:][free] -= delta
            at = to
        while at:
            match[at] = match[back[at]]
            at = back[at]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(j, i) for i, j in pairs] if turned else pairs


def align_optimal(cells: DataFrame, group: str, label: str, reference: str, n: str = "n") -> DataFrame:
    """group, label, aligned: the one-to-one mapping of greatest overlap; labels left over get fresh numbers after all references.

    Only contingency counts (labels times labels a group) come to a task.
    """
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index=label, columns=reference, values=n, aggfunc="sum", fill_value=0)
        found = {table.index[i]: table.columns[j] for i, j in _assign(-table.to_numpy(float))}
        fresh = int(max(table.columns)) + 1
        out = []
        for value in table.index:
            if value not in found:
                found[value] = fresh
                fresh += 1
            out.append((pdf[group].iloc[0], int(value), int(found[value])))
        return pd.DataFrame(out, columns=[group, label, "aligned"])

    kind = dict(cells.dtypes)[group]
    return cells.select(group, F.col(label).cast("long"), F.col(reference).cast("long"), n).groupBy(group).applyInPandas(solve, f"{group} {kind}, {label} long, aligned long")


def signature_graph(long: DataFrame, least: float = 0.0) -> DataFrame:
    """Co-association without rows by rows: distinct label tuples with their sizes, and for each two the share of agreeing models, of `least` and more.

    Two tuples of m labels that agree in n places share one of the m - n + 1 rarest (place, label) of either, so each
    tuple is met under those only: under its rarest one, if all must agree. With 0, tuples need to agree somewhere.
    """
    rows = long.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("candidate", "label"))).alias("s")).select("row_id", F.col("s.label").alias("signature"))
    sizes = written(rows.groupBy("signature").agg(F.count("*").alias("n"), F.min("row_id").alias("first")), "signatures")
    each = sizes.select("signature", F.col("first").alias("v"), "n", F.posexplode("signature").alias("_i", "_label"))
    shared = each.groupBy("_i", "_label").agg(F.count("*").alias("_many"))
    rarest = Window.partitionBy("v").orderBy("_many", "_i")  # a signature's labels
    needed = F.greatest(F.lit(1), F.ceil(F.size("signature") * least - 1e-9))
    keys = each.join(shared, ["_i", "_label"]).withColumn("_r", F.row_number().over(rarest)).where(F.col("_r") <= F.size("signature") - needed + 1)
    side = lambda x: keys.select("_i", "_label", F.col("signature").alias(f"s{x}"), F.col("v").alias(x), F.col("n").alias(f"n{x}"))
    met = side("a").join(side("b"), ["_i", "_label"]).where("a < b").select("a", "b", "na", "nb", "sa", "sb").distinct()
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    return met.select("a", "b", "na", "nb", (agree / F.size("sa")).alias("similarity")).where(F.col("similarity") >= least)


def candidate_scores(long: DataFrame, truth: DataFrame) -> DataFrame:
    """candidate, ari, nmi, rand of labelings (candidate, row_id, label) against truth (row_id, y), all from contingency counts."""
    from tessera.operators.metrics import label_scores

    cells = long.join(truth.select("row_id", "y"), "row_id").groupBy("candidate", "label", "y").agg(F.count("*").alias("n"))
    return label_scores(cells, "label", "y", by=["candidate"])


def ranked_candidates(scores: DataFrame, most: int | None = 5, least: int = 2) -> list[tuple[str, float]]:
    """(candidate, ari) of the k best, k = max(min(n // 2, most), least), or of all with most None."""
    rows = [(r["candidate"], r["ari"]) for r in scores.orderBy(F.desc("ari"), "candidate").select("candidate", "ari").collect()]  # candidates
    return rows if most is None else rows[: max(min(len(rows) // 2, most), least)]


def aligned_vote(long: DataFrame, anchor: str, weights: dict[str, float] | None = None) -> DataFrame:
    """row_id and the majority (or weighted) label of labelings aligned one to one to the anchor's labels."""
    ref = long.where(F.col("candidate") == anchor).select("row_id", F.col("label").alias("_ref"))
    cells = long.where(F.col("candidate") != anchor).join(ref, "row_id").groupBy("candidate", "label", "_ref").agg(F.count("*").alias("n"))
    mapped = long.join(align_optimal(cells, "candidate", "label", "_ref"), ["candidate", "label"], "left")
    votes = mapped.select("row_id", "candidate", F.coalesce("aligned", F.col("label").cast("long")).alias("label"))
    if weights is None:
        return majority_vote(votes)
    held = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(round(max(v, 0.0), 6)).cast("decimal(9,6)"))])
    return majority_vote(votes.withColumn("_w", held[F.col("candidate")]), "_w")


def consensus_top_k(long: DataFrame, truth: DataFrame, most: int | None = 5, least: int = 2) -> DataFrame:
    """row_id and label: the aligned vote of the best labelings by ari against truth, the best one as anchor."""
    chosen = ranked_candidates(candidate_scores(long, truth), most, least)
    names = [c for c, _ in chosen]
    return aligned_vote(long.where(F.col("candidate").isin(names)), names[0])


def output_control(long: DataFrame, truth: DataFrame, cut: bool = False) -> DataFrame:
    """source, config, ari, nmi, rand on test of eight configurations: teacher or student labelings, one or their vote.

    With `cut` a ninth and tenth, coassociation: the labels of consensus.coassociation_cut over each source's labelings.

    long: source, candidate, row_id, label. truth: row_id, y, split (val or test). single is the candidate of the best
    validation ari, majority and weighted vote after alignment to it (weights are validation ari), and auto is
    whichever of the three is best on validation.
    """
    from tessera.operators.metrics import label_scores

    out = None
    for source in [r[0] for r in long.select("source").distinct().orderBy("source").collect()]:  # sources
        part = long.where(F.col("source") == source).drop("source")
        best = ranked_candidates(candidate_scores(part, truth.where("split = 'val'")), None)
        names, anchor = dict(best), best[0][0]
        made = {
            "single": part.where(F.col("candidate") == anchor).select("row_id", F.col("label").cast("long").alias("label")),
            "majority": aligned_vote(part, anchor), "weighted": aligned_vote(part, anchor, names),
        }
        if cut:
            from tessera.operators.consensus import coassociation_cut

            made["coassociation"] = coassociation_cut(part)
        rows = None
        for config, labels in made.items():
            row = labels.withColumn("config", F.lit(config))
            rows = row if rows is None else rows.unionByName(row)
        cells = rows.join(truth, "row_id").groupBy("config", "split", "label", "y").agg(F.count("*").alias("n"))
        scores = label_scores(cells, "label", "y", by=["config", "split"])
        order = Window.orderBy(F.desc("ari"), "config")  # three rows
        auto = scores.where("split = 'val' and config <> 'coassociation'").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("config")
        test = scores.where("split = 'test'").drop("split")
        whole = test.unionByName(test.join(auto, "config", "left_semi").withColumn("config", F.lit("auto"))).withColumn("source", F.lit(source))
        out = whole if out is None else out.unionByName(whole)
    return out.select("source", "config", "ari", "nmi", "rand")


def knn_join(df: DataFrame, row_id: str, features: list[str], k: int, queries: DataFrame) -> DataFrame:
    """(query, neighbour, distance) of the k nearest rows of df for each of a stated set of queries, ties by row_id."""
    from tessera.operators.neighbours import nearest

    return nearest(df, queries, row_id, features, k)


def projection_bins(df: DataFrame, row_id: str, bins: int) -> DataFrame:
    """row_id, score and label: quantile bins of the projection of `features` on their first principal direction.

    The direction's largest weight is above zero; a score on an edge is above it. If all rows come into one bin, their
    places in the order of score and row_id, an integer, are cut into bins of equal size.
    """
    model = PCA(k=1, inputCol="features", outputCol="_p").fit(df)
    weights = model.pc.toArray()[:, 0]
    sign = 1.0 if weights[np.argmax(np.abs(weights))] > 0 else -1.0
    p = model.transform(df).select(row_id, (vector_to_array("_p")[0] * sign).alias("score")).persist()
    cuts = {f"_q{i}": i / bins for i in range(1, bins)}
    edges = linear_quantiles(p, "score", cuts).select(F.array(*cuts).alias("_q"))  # one row
    out = p.crossJoin(F.broadcast(edges)).select(row_id, "score", F.size(F.filter("_q", lambda x: F.col("score") >= x)).alias("label"))
    labels, n, least, most, first, last = out.agg(F.count_distinct("label"), F.count("*"), F.min("score"), F.max("score"), F.min(row_id), F.max(row_id)).first()
    if labels > 1 or n < bins:
        return out
    # in one bin, most rows share the least score: they are ranked by row_id, the others by score
    among = F.floor((F.col(row_id) - first) * (HASH_BUCKETS / (last - first + 1)))
    above = HASH_BUCKETS + F.floor((F.col("score") - least) * (HASH_BUCKETS / ((most - least) or 1.0)))
    at = F.col("_at") - 1
    size, more = divmod(n, bins)
    label = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / size)).cast("int")
    ranked = running(p, F.when(F.col("score") > least, above).otherwise(among), [F.col("score"), F.col(row_id)], {"_at": F.lit(1)})
    return ranked.select(row_id, "score", label.alias("label"))
