"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample by their ratio."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table, text_slices, written
from tessera.llm.words import Scanner, mix

BUCKETS = 1 << 16


def _features(prints: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and every pair of neighbouring words; words are runs of letters or of marks."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = mix(prints[:-1] * np.uint64(3) + prints[1:])[row[1:] == row[:-1]] if len(prints) else prints
    bucket = (np.concatenate([prints, pairs]) >> np.uint64(48)).astype(np.int64)
    return bucket, np.concatenate([row, row[:-1][row[1:] == row[:-1]]]) if len(row) else row


def labelled(labels: DataFrame, most: int = 40_000) -> dict[int, bool]:
    """Quality by doc_id for at most `most` labelled documents, those of the least hash; contradicting labels drop out."""
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    return {r[0]: r[1] == 1 for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "low").limit(most).collect()}


def log_ratios(docs: DataFrame, target: list[int], smoothing: float = 1.0) -> np.ndarray:
    """log p(bucket | target) / p(bucket | raw) for each bucket: raw counts all documents, target the given ones (a bounded list)."""
    wanted = docs.sparkSession.sparkContext.broadcast(np.array(sorted(target), np.int64))

    def run(batches):
        scanner = Scanner("mixed")
        raw, aimed = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            keys = batch.column("doc_id")
            inside = np.isin(keys.fill_null(0).to_numpy(), wanted.value) & keys.is_valid().to_numpy(zero_copy_only=False)
            for low, high, data, offsets in text_slices(batch, "text"):
                _, _, prints, first = scanner.scan(data, offsets)
                bucket, row = _features(prints, first)
                raw += np.bincount(bucket, minlength=BUCKETS)
                aimed += np.bincount(bucket[inside[low:high][row]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "raw": pa.array(raw[some], pa.int64()), "aimed": pa.array(aimed[some], pa.int64())})

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "bucket long, raw long, aimed long")
    raw, aimed = np.full(BUCKETS, smoothing), np.full(BUCKETS, smoothing)
    for b, r, a in found.groupBy("bucket").agg(F.sum("raw"), F.sum("aimed")).collect():  # at most BUCKETS rows
        raw[b] += r
        aimed[b] += a
    return np.log(aimed / aimed.sum()) - np.log(raw / raw.sum())


def log_weight(docs: DataFrame, ratios: np.ndarray) -> Column:
    """The text's log importance weight: the ratios of all its n-grams, summed. A null or empty text weighs 0."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf("double")
    def weigh(texts: pa.Array) -> pa.Array:
        scanner = Scanner("mixed")
        parts = [np.zeros(0)]
        for low, high, data, offsets in text_slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            _, _, prints, first = scanner.scan(data, offsets)
            bucket, row = _features(prints, first)
            parts.append(np.bincount(row, held.value[bucket], high - low))
        return pa.array(np.concatenate(parts), pa.float64())

    return weigh(F.col("text").cast("string"))


def gumbel_key(weight: Column, seed: int) -> Column:
    """weight plus standard Gumbel noise from the document's own hash, so that the k largest keys are a sample without replacement."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    return weight - F.log(-F.log(uniform))


def kth_largest(values: DataFrame, name: str, k: int, most: int = 20_000) -> float | None:
    """The k-th largest value of a column, exactly: quantile estimates narrow a range down to at most `most` rows, which are sorted."""
    inside, n, above = values.select(name).where(F.col(name).isNotNull()), None, 0
    low, high = -float("inf"), float("inf")
    for _ in range(40):
        part = inside.where((F.col(name) > low) & (F.col(name) <= high))
        n = part.count()
        if k < 1 or k - above > n:
            return None
        if n <= most:
            break
        place = 1 - (k - above) / n
        a, b = part.agg(F.percentile_approx(name, [max(0.0, place - 0.002), min(1.0, place + 0.002)], 10_000)).first()[0]
        over_b, over_a = part.agg(F.sum((F.col(name) > b).cast("long")), F.sum((F.col(name) > a).cast("long"))).first()
        if above + over_b >= k:
            low, high, above = b, high, above
        elif above + over_a >= k:
            low, high, above = a, b, above + over_b
        else:
            high, above = a, above + over_a
        if a == b and above + part.where(F.col(name) == a).count() >= k and low < a <= high:
            return a
    rows = part.orderBy(F.col(name).desc()).limit(k - above).agg(F.min(name)).first()
    return rows[0]


def weighed(docs: DataFrame, labels: DataFrame, keep: list[str], loss: float = 0.001, margin: float = 4.0, most: int = 40_000, seed: int = 1) -> tuple[DataFrame, np.ndarray, float | None]:
    """(columns `keep` of docs with _weight and _key as a written table, log ratios, least Gumbel key of the sample).

    Half of the labelled sample makes the target model, the other half sets k: the number of documents whose weight is at
    least that of all but `loss` of the held-out good ones, less `margin` for the noise. Without good labelled documents
    nothing can be told, and all stay (cut None).
    """
    good = [i for i, q in labelled(labels, most).items() if q]
    ratios = log_ratios(docs, good[::2])
    scored = docs.withColumn("_weight", log_weight(docs, ratios)).withColumn("_key", gumbel_key(F.col("_weight"), seed))
    scored = written(scored.select(*keep, F.col("doc_id").cast("long").alias("_doc"), "_weight", "_key"), "weights")
    held = docs.sparkSession.createDataFrame([(i,) for i in good[1::2]], "_doc long")
    known = scored.join(F.broadcast(held), "_doc", "left_semi")  # at most most / 2 ids
    n = known.count()
    least = kth_largest(known, "_weight", n - int(n * loss))
    if least is None:
        return scored, ratios, None
    return scored, ratios, kth_largest(scored, "_key", scored.where(F.col("_weight") >= least - margin).count())


def _kept(cut: float | None) -> Column:
    return F.lit(True) if cut is None else F.col("_key") >= cut


def resample(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """Columns `keep` of docs, log_weight, gumbel_key and kept (the key is among the k largest; ties at the cut all stay).

    Null and empty texts weigh 0; very long ones are summed whole. A null doc_id is never a labelled document and has
    noise like any other value. Equal rows get equal keys; every row of a labelled doc_id counts as labelled. Labels that
    contradict each other or have a null drop out. Other columns, whatever their names, are kept only if asked for. An
    empty table gives no rows.
    """
    scored, _, cut = weighed(docs, labels, list(keep), **how)
    return scored.select(*keep, F.col("_weight").alias("log_weight"), F.col("_key").alias("gumbel_key"), _kept(cut).alias("kept"))


def keep_sample(docs: DataFrame, labels: DataFrame, seed: int = 1, **how) -> DataFrame:
    """docs without the rows that `resample` does not keep; all columns stay. Weighed once more, so that no text is written."""
    names = [c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)]
    named = docs.toDF(*names)
    _, ratios, cut = weighed(named, labels, [], seed=seed, **how)
    return docs if cut is None else named.where(gumbel_key(log_weight(named, ratios), seed) >= cut).toDF(*docs.columns)


def op1_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
