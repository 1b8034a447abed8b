"""Binary stacking in full: failing bases dropped, a scaled and searched meta model, cross-validated calibration, a threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import sigmoid
from tessera.operators import calibration as C
from tessera.operators import metrics as M
from tessera.operators.models import fit_pool, out_of_fold, wide
from tessera.operators.newton import fit_logistics, score
from tessera.operators.split import k_fold
from tessera.sources.shared import written

STRENGTHS = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)


@dataclass
class Stacked:
    """predictions (row_id, y, p, label) on test; names of the bases used; dropped bases with why; the strength C and threshold chosen; search: log loss and accuracy of each C."""

    predictions: DataFrame
    names: list[str]
    dropped: list[tuple[str, str]]
    strength: float
    threshold: float
    search: DataFrame

    def scores(self) -> DataFrame:
        """One row: all binary metrics of the predictions, rates at the chosen threshold."""
        out = M.roc_auc(self.predictions).crossJoin(M.average_precision(self.predictions)).crossJoin(M.probability_scores(self.predictions)).crossJoin(M.ece(self.predictions))
        return out.crossJoin(M.confusion(self.predictions, threshold=self.threshold))  # single rows


def finite(p: str) -> Column:
    """A base's probability as a meta feature: 0.5 where it has none, 0 where it is infinite."""
    return F.when(F.col(p).isNull() | F.isnan(p), 0.5).when(F.abs(p) == float("inf"), 0.0).otherwise(F.col(p))


def stack_binary(
    pool: dict, fit: DataFrame, test: DataFrame, row_id: str, k: int = 5, repeats: int = 3, strengths: tuple[float, ...] = STRENGTHS, balanced: bool = False,
    optimise: str = "accuracy", calibrate: bool = True, threshold_metric: str = "accuracy", seed: int = 42, workers: int = 4,
) -> Stacked:
    """A stack of the pool's probabilities, fitted on fit (row_id, y, features and what the pool needs), for test.

    A base that raises on a fold or on all rows is left out and named; without any left it is an error. Out-of-fold
    probabilities are standardised, and a logistic meta model takes the C of the best accuracy (or the least log loss)
    over `repeats` times k stratified folds, the smallest of several. Its held-out probabilities set the threshold of the
    best threshold_metric. With calibrate, the probability is the mean of k meta models, each calibrated by a sigmoid on
    the fold that it has not seen, else that of the meta model on all rows. Test labels are carried and never used. All
    meta models of a step are fitted in the same passes over the written out-of-fold table.
    """
    dropped: list[tuple[str, str]] = []
    long = out_of_fold(pool, fit, row_id, k, seed, log=dropped, workers=workers)
    names = [n for n in pool if n not in {x for x, _ in dropped}]
    on_test = fit_pool({n: pool[n] for n in names}, fit, test, [row_id, "y"], log=dropped, workers=workers)
    names = [n for n in names if n not in {x for x, _ in dropped}]
    features = written(wide(long.where(F.col("model").isin(names)), row_id, names).select(row_id, "y", *[finite(n).alias(n) for n in names]), "stack-features")
    spread = features.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names], F.avg(F.col("y").cast("double")).alias("share"), F.count("*").alias("n")).first()
    x = [(F.col(n) - spread[f"m_{n}"]) / (spread[f"s_{n}"] or 1.0) for n in names]
    y = F.col("y")
    weight = F.when(y == 1, 0.5 / max(spread["share"], 1e-12)).otherwise(0.5 / max(1 - spread["share"], 1e-12)) if balanced else F.lit(1.0)

    folded = features
    for r in range(repeats):
        folded = k_fold(folded, k, seed + 7 * r, row_id, "y", f"fold{r}")
    folded = written(folded, "meta-folds")
    parts = [(r, f) for r in range(repeats) for f in range(k)]
    outside = [F.when(F.col(f"fold{r}") != f, weight).otherwise(0.0) for r, f in parts]
    found = fit_logistics(folded, x, y, [*outside, weight], [1 / c for c in strengths])

    # each row under the models that have not seen it: a score a repeat and C
    said = {(r, c): F.coalesce(*[F.when(F.col(f"fold{r}") == f, score(x, found[i, c])) for i, (q, f) in enumerate(parts) if q == r]) for r in range(repeats) for c in range(len(strengths))}
    measures = []
    for c, strength in enumerate(strengths):
        losses = [F.avg(-y * F.log(M.clip(sigmoid(z))) - (1 - y) * F.log(1 - M.clip(sigmoid(z)))) for (_, i), z in said.items() if i == c]
        right = [F.avg(((z >= 0) == (y == 1)).cast("double")) for (_, i), z in said.items() if i == c]
        mean = lambda each: sum(each[1:], each[0]) / repeats
        measures.append(F.struct(F.lit(float(strength)).alias("c"), mean(losses).alias("log_loss"), mean(right).alias("accuracy")))
    search = written(folded.agg(F.array(*measures).alias("x")).select(F.inline("x")), "meta-search")
    order = [F.desc("accuracy"), "c"] if optimise == "accuracy" else ["log_loss", "c"]
    strength = search.orderBy(*order).first()["c"]  # a row a strength
    best = strengths.index(strength)

    held_out = written(folded.select(row_id, "y", "fold0", said[0, best].alias("z")), "meta-held-out")
    table = C.threshold_table(held_out.withColumn("p", sigmoid(F.col("z"))), "y", "p", [round(0.05 + 0.01 * i, 2) for i in range(91)])
    threshold = C.best_threshold(table, threshold_metric).first()["threshold"]
    if calibrate:
        # targets of a sigmoid: not quite 0 and 1, by how many there are in the fold
        counts = {r["fold0"]: (r["a"], r["b"]) for r in held_out.groupBy("fold0").agg(F.count_if(y == 1).alias("a"), F.count_if(y != 1).alias("b")).collect()}  # folds
        target = F.coalesce(*[F.when(F.col("fold0") == f, F.when(y == 1, (a + 1) / (a + 2)).otherwise(1 / (b + 2))) for f, (a, b) in counts.items()])
        curves = fit_logistics(held_out, [F.col("z")], target, [(F.col("fold0") == f).cast("double") for f in range(k)], [0.0])
        each = [sigmoid(score([score(x, found[f, best])], curves[f, 0])) for f in range(k)]  # parts of repeat 0 come first
        p = sum(each[1:], each[0]) / k
    else:
        p = sigmoid(score(x, found[-1, best]))
    wide_test = wide(on_test.where(F.col("model").isin(names)), row_id, names).select(row_id, "y", *[finite(n).alias(n) for n in names])
    out = wide_test.select(row_id, "y", p.alias("p")).withColumn("label", (F.col("p") >= threshold).cast("int"))
    return Stacked(written(out, "stacked"), names, dropped, strength, threshold, search)
