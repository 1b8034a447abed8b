"""Evaluation metrics as aggregations. Each takes a prediction table and optional group columns and returns one row a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import running, step_count, value_bucket


def _by_score(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """One row a group and distinct score, with its positives and negatives."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, p).agg(F.sum((F.col(y) == 1).cast("long")).alias("_pos"), F.sum((F.col(y) != 1).cast("long")).alias("_neg"))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """auc by the rank sum with half credit for ties; null with a single class."""
    by = by or []
    scores = running(_by_score(df, y, p, by), value_bucket(p), [F.col(p)], {"_below": F.col("_neg")}, by)
    won = F.sum(F.col("_pos") * (F.col("_below") - F.col("_neg") / 2.0))
    return scores.groupBy(*by).agg(F.try_divide(won, (F.sum("_pos") * F.sum("_neg")).cast("double")).alias("auc"))


def average_precision(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """pr_auc as the step sum over falling scores of recall gain times precision; null without positives."""
    by = by or []
    scores = running(_by_score(df, y, p, by), -value_bucket(p), [F.col(p).desc()], {"_tp": F.col("_pos"), "_all": F.col("_pos") + F.col("_neg")}, by)
    return scores.groupBy(*by).agg(F.try_divide(F.sum(F.col("_pos") * F.col("_tp") / F.col("_all")), F.sum("_pos").cast("double")).alias("pr_auc"))


def _zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def threshold_scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Rates from confusion counts; a zero denominator gives 0."""
    recall, precision, specificity = _zero(tp, tp + fn), _zero(tp, tp + fp), _zero(tn, tn + fp)
    return {
        "accuracy": _zero(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (recall + specificity) / 2, "precision": precision, "recall": recall,
        "f1": _zero(2 * precision * recall, precision + recall), "youden_j": recall + specificity - 1,
    }


def confusion(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Confusion counts at a threshold (p >= threshold is positive) and the rates from them, in one pass."""
    hit = F.col(p) >= threshold
    cells = {"tp": hit & (F.col(y) == 1), "fp": hit & (F.col(y) != 1), "fn": ~hit & (F.col(y) == 1), "tn": ~hit & (F.col(y) != 1)}
    counts = df.groupBy(*(by or [])).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
    return counts.withColumns(threshold_scores(*[F.col(n) for n in cells]))


def clip(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def probability_scores(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """brier and log_loss (probabilities clipped at 1e-6)."""
    q = clip(F.col(p))
    loss = -F.col(y) * F.log(q) - (1 - F.col(y)) * F.log(1 - q)
    return df.groupBy(*(by or [])).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(loss).alias("log_loss"))


def right_closed_bin(p: str, bins: int = 10) -> Column:
    """The number of inner edges i / bins strictly below p: bins are open on the left, as 0.1 falls in bin 0."""
    return step_count(F.col(p), [i / bins for i in range(1, bins)], strict=True)


def left_closed_bin(p: str, bins: int = 10) -> Column:
    """floor(p * bins), with 1 in the last bin."""
    return F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")


def reliability(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, right_closed: bool = True, by: list[str] | None = None) -> DataFrame:
    """count, mean_confidence and accuracy of each bin; empty bins are kept, with nulls."""
    by = by or []
    bin_ = (right_closed_bin if right_closed else left_closed_bin)(p, bins)
    found = df.where(F.col(p).isNotNull()).groupBy(*by, bin_.cast("int").alias("bin")).agg(F.count("*").alias("count"), F.avg(p).alias("mean_confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        every = df.select(*by).distinct().crossJoin(F.broadcast(every))  # ten rows
    return every.join(found, [*by, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def ece(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, right_closed: bool = True, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error: bins' |accuracy - confidence|, weighted by their rows."""
    table = reliability(df, y, p, bins, right_closed, by)
    gap = F.coalesce(F.abs(F.col("accuracy") - F.col("mean_confidence")), F.lit(0.0))
    return table.groupBy(*(by or [])).agg(F.try_divide(F.sum(F.col("count") * gap), F.sum("count").cast("double")).alias("ece"))


def binary_scores(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5, bins: int = 10) -> DataFrame:
    """metric and value of every binary metric: all from the positives and negatives of each distinct score, which is one pass over the rows."""
    counts = _by_score(df, y, p, [])
    total = counts.agg(F.sum("_pos").cast("double").alias("_P"), F.sum("_neg").cast("double").alias("_N"))
    both = running(counts, value_bucket(p), [F.col(p)], {"_pu": F.col("_pos"), "_nu": F.col("_neg")}).crossJoin(F.broadcast(total))  # one row
    pos, neg, q = F.col("_pos"), F.col("_neg"), F.col(p)
    tp, fp = F.col("_P") - F.col("_pu") + pos, F.col("_N") - F.col("_nu") + neg  # at this score and above
    hit = q >= threshold
    cells = {"tp": F.sum(F.when(hit, pos).otherwise(0)), "fp": F.sum(F.when(hit, neg).otherwise(0)), "fn": F.sum(F.when(hit, 0).otherwise(pos)), "tn": F.sum(F.when(hit, 0).otherwise(neg))}
    n = F.first("_P") + F.first("_N")
    row = both.agg(
        F.try_divide(F.sum(pos * (F.col("_nu") - neg / 2.0)), F.first("_P") * F.first("_N")).alias("auc"), F.try_divide(F.sum(pos * tp / (tp + fp)), F.first("_P")).alias("pr_auc"),
        F.try_divide(F.sum(pos * F.pow(q - 1, 2) + neg * F.pow(q, 2)), n).alias("brier"), F.try_divide(F.sum(-pos * F.log(clip(q)) - neg * F.log(1 - clip(q))), n).alias("log_loss"), *[c.alias(k) for k, c in cells.items()],
    )
    binned = counts.groupBy(right_closed_bin(p, bins).alias("bin")).agg(F.abs(F.sum(pos) - F.sum((pos + neg) * q)).alias("gap"), F.sum(pos + neg).alias("n"))
    row = row.withColumns(threshold_scores(*[F.col(k) for k in cells])).drop(*cells)
    row = row.crossJoin(F.broadcast(binned.agg(F.try_divide(F.sum("gap"), F.sum("n").cast("double")).alias("ece"))))  # one row
    return row.unpivot([], row.columns, "metric", "value")


def multiclass_scores(df: DataFrame, y: str = "y", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """accuracy and weighted and macro precision, recall and f1, from the contingency counts."""
    by = by or []
    cells = df.groupBy(*by, y, label).agg(F.count("*").alias("n"))
    true = cells.groupBy(*by, F.col(y).alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(y) == F.col(label), F.col("n")).otherwise(0)).alias("tp"))
    said = cells.groupBy(*by, F.col(label).alias("c")).agg(F.sum("n").alias("said"))
    each = true.join(said, [*by, "c"], "full").na.fill(0, ["support", "tp", "said"])
    each = each.withColumn("precision", _zero(F.col("tp"), F.col("said"))).withColumn("recall", _zero(F.col("tp"), F.col("support")))
    each = each.withColumn("f1", _zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    n = F.sum("support")
    out = [_zero(F.sum("tp"), n).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        out += [_zero(F.sum(F.col(m) * F.col("support")), n).alias(f"weighted_{m}"), F.avg(m).alias(f"macro_{m}")]
    return each.groupBy(*by).agg(*out)


def one_vs_rest(df: DataFrame, y: str, probabilities: dict[str, str]) -> DataFrame:
    """macro_ovr_auc and weighted_ovr_auc over classes (class value to probability column), each class's auc in one pass."""
    each = df.select(F.col(y).cast("string").alias("_y"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(p).alias("p")) for c, p in probabilities.items()])).alias("x"))
    long = each.select(F.col("x.c").alias("c"), F.col("x.p").alias("p"), (F.col("_y") == F.col("x.c")).cast("int").alias("y"))
    support = long.groupBy("c").agg(F.sum("y").alias("support"))
    joined = roc_auc(long, by=["c"]).join(support, "c")
    return joined.agg(F.avg("auc").alias("macro_ovr_auc"), F.coalesce(F.try_divide(F.sum(F.col("auc") * F.col("support")), F.sum("support").cast("double")), F.lit(0.0)).alias("weighted_ovr_auc"))


def one_vs_one(df: DataFrame, y: str, probabilities: dict[str, str]) -> DataFrame:
    """ovo_auc: for each pair of classes, the mean of both classes' auc among the rows of the two; then the mean over pairs."""
    names = sorted(probabilities)
    pairs = [(a, b) for a in names for b in names if a != b]
    each = df.select(F.col(y).cast("string").alias("_y"), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(probabilities[a]).alias("p")) for a, b in pairs])).alias("x"))
    long = each.select("_y", "x.*").where("_y = a or _y = b").withColumn("y", (F.col("_y") == F.col("a")).cast("int"))
    return roc_auc(long, by=["a", "b"]).agg(F.avg("auc").alias("ovo_auc"))


def multiclass_brier(df: DataFrame, y: str, probabilities: dict[str, str]) -> DataFrame:
    """Mean squared distance of the probability row to the one-hot row."""
    terms = [F.pow(F.col(p) - (F.col(y).cast("string") == c).cast("int"), 2) for c, p in probabilities.items()]
    return df.agg(F.avg(sum(terms, F.lit(0.0))).alias("brier"))


def regression_scores(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """mae, rmse, r2, rmsle (null if a true or predicted value is negative) and rmsle_clipped (only a true value counts)."""
    e = F.col(p) - F.col(y)
    logs = F.avg(F.pow(F.log1p(F.greatest(F.col(p), F.lit(0.0))) - F.log1p(F.greatest(F.col(y), F.lit(0.0))), 2))
    return df.groupBy(*(by or [])).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.count(y) * F.var_pop(y))).alias("r2"),
        F.when(F.min(F.least(F.col(y), F.col(p))) >= 0, F.sqrt(logs)).alias("rmsle"), F.when(F.min(y) >= 0, F.sqrt(logs)).alias("rmsle_clipped"),
    )


def interval_scores(df: DataFrame, y: str, low: str, high: str, alpha: float, by: list[str] | None = None) -> DataFrame:
    """coverage, mean width, width over the range of y, and |coverage - (1 - alpha)|."""
    inside = ((F.col(y) >= F.col(low)) & (F.col(y) <= F.col(high))).cast("double")
    width = F.col(high) - F.col(low)
    out = df.groupBy(*(by or [])).agg(F.avg(inside).alias("picp"), F.avg(width).alias("mpiw"), F.try_divide(F.avg(width), F.max(y) - F.min(y)).alias("pinaw"))
    return out.withColumn("coverage_error", F.abs(F.col("picp") - (1 - alpha)))


def spearman(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Correlation of average ranks. Ranks come from counts of distinct values, not from a sort of all rows."""
    by = by or []

    def ranks(name: str, to: str) -> DataFrame:
        values = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, name).agg(F.count("*").alias("_n"))
        lows = running(values, value_bucket(name), [F.col(name)], {"_upto": F.col("_n")}, by)
        return lows.select(*by, F.col(name).alias(f"_{to}"), (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(to))

    ra, rb = ranks(a, "ra"), ranks(b, "rb")
    on = lambda name, to: [F.col(name) == F.col(f"_{to}"), *[F.col(f"l.{c}") == F.col(f"r.{c}") for c in by]]
    first = df.alias("l").join(ra.alias("r"), on(a, "ra")).select("l.*", "ra")
    both = first.alias("l").join(rb.alias("r"), on(b, "rb")).select("l.*", "rb")
    return both.groupBy(*by).agg(F.corr("ra", "rb").alias("spearman"))


def fidelity(df: DataFrame, teacher: str, student: str, by: list[str] | None = None) -> DataFrame:
    """Pearson (null if either deviation is under 1e-12), mean absolute and root mean squared difference."""
    e = F.col(student) - F.col(teacher)
    flat = (F.stddev_pop(teacher) < 1e-12) | (F.stddev_pop(student) < 1e-12)
    return df.groupBy(*(by or [])).agg(F.when(~flat, F.corr(teacher, student)).alias("pearson"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two Bernoulli distributions."""
    p, q = clip(p), clip(q)
    m = (p + q) / 2
    kl = lambda a: a * F.log(a / m) + (1 - a) * F.log((1 - a) / (1 - m))
    return (kl(p) + kl(q)) / 2


def top_overlap(df: DataFrame, a: str, b: str, row_id: str, share: float = 0.1, up: bool = False) -> DataFrame:
    """Share of the top rows (round(n * share), or its ceiling with `up`) that two scores have in common; ties by row_id.

    Top rows are found by rank inside score buckets, so neither score is sorted as a whole.
    """
    n = df.count()
    k = max(1, -(-int(round(n * share * 1e9)) // 10**9) if up else int(n * share + 0.5))
    tops = []
    for name in (a, b):
        ranked = running(df.select(row_id, name), -value_bucket(name), [F.col(name).desc(), F.col(row_id)], {"_rank": F.lit(1)})
        tops.append(ranked.where(F.col("_rank") <= k).select(row_id))
    return tops[0].join(tops[1], row_id, "left_semi").agg((F.count("*") / F.lit(float(k))).alias("top_overlap"))


def label_scores(cells: DataFrame, a: str, b: str, n: str = "n", by: list[str] | None = None) -> DataFrame:
    """ari, nmi (arithmetic mean) and rand from contingency counts (a, b, n); two trivial partitions agree fully."""
    by = by or []
    pairs = lambda x: x * (x - 1) / 2.0
    rows = cells.groupBy(*by, a).agg(F.sum(n).alias("m"))
    cols = cells.groupBy(*by, b).agg(F.sum(n).alias("m"))
    entropy = lambda c, t: -F.sum(F.col(c) / F.col(t) * F.log(F.col(c) / F.col(t)))
    total = cells.groupBy(*by).agg(F.sum(n).cast("double").alias("t"), F.sum(pairs(F.col(n))).alias("s"))

    def side(x: DataFrame, name: str) -> DataFrame:
        joined = x.join(total.select(*by, "t"), by) if by else x.crossJoin(total.select("t"))
        return joined.groupBy(*by).agg(F.sum(pairs(F.col("m"))).alias(f"s{name}"), entropy("m", "t").alias(f"h{name}"))

    joint = cells.withColumn("m", F.col(n))
    frames = [side(rows, "a"), side(cols, "b"), side(joint, "ab").select(*by, "hab")]
    out = total
    for f in frames:
        out = out.join(f, by) if by else out.crossJoin(f)
    all_pairs = pairs(F.col("t"))
    expected = F.col("sa") * F.col("sb") / all_pairs
    most = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(F.abs(most - expected) < 1e-12, 1.0).otherwise((F.col("s") - expected) / (most - expected))
    information = F.col("ha") + F.col("hb") - F.col("hab")
    nmi = F.when((F.col("ha") + F.col("hb")) < 1e-12, 1.0).otherwise(F.greatest(information, F.lit(0.0)) / ((F.col("ha") + F.col("hb")) / 2))
    rand = (all_pairs + 2 * F.col("s") - F.col("sa") - F.col("sb")) / all_pairs
    return out.select(*by, ari.alias("ari"), nmi.alias("nmi"), rand.alias("rand"))


def contingency(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Counts of each pair of labels: the base of all external cluster metrics, k * k rows whatever the input."""
    return df.groupBy(*(by or []), a, b).agg(F.count("*").alias("n"))


def mean_of_rank(column: str, by: list[str]) -> Column:
    """Average rank inside a small group."""
    w = Window.partitionBy(*by).orderBy(column)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2.0
