"""Streams over files give the batch result; rounds close, abort and count; duplicates go."""

from pyspark.sql import functions as F

from tessera.streaming import runlog as R

EVENTS = "/root/testdata/sf0.001/events.parquet"


def _split(spark, tmp_path, n=4):
    e = spark.read.parquet(EVENTS)
    for i in range(n):
        lo, hi = i * 1000 // n, (i + 1) * 1000 // n
        e.where(f"event_id >= {lo} and event_id < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return e


def test_windows_match_batch(spark, tmp_path):
    e = _split(spark, tmp_path)
    got = R.drained(R.interval_counts(R.read_log(spark, str(tmp_path / "log")), "1 day", late="40 days"), "days_stream")
    closing = spark.createDataFrame([(10**9, "2030-01-01")], "event_id long, t string").select("event_id", F.to_timestamp("t").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    assert got.count() == 0  # nothing passes a watermark of 40 days until a later event
    closing.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    got = R.drained(R.interval_counts(R.read_log(spark, str(tmp_path / "log")), "1 day", late="40 days"), "days_stream_again")
    want = R.interval_counts(e, "1 day")
    key = lambda rows: sorted((str(r.start), r.event_type, r.n) for r in rows)
    assert key(got.collect()) == key(want.collect())


def test_duplicates_within_watermark(spark, tmp_path):
    e = spark.read.parquet(EVENTS).limit(200)
    for _ in range(2):
        e.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    got = R.drained(R.deduplicated(R.read_log(spark, str(tmp_path / "log")), "60 days"), "once")
    assert got.count() == 200


def test_transition_and_plan(spark):
    row = spark.range(1).select(R.transition(F.lit(1), F.lit(0), F.lit(0)).alias("a"), R.transition(F.lit(1), F.lit(1), F.lit(0)).alias("b"), R.plan_of(F.lit("feature_engineering")).alias("c")).first()
    assert tuple(row) == ("revise_affected_plan", "fallback_to_best_runnable", "feature")


def test_running_best_row_by_row(spark, tmp_path):
    """Every event's best and improvement, over batches and Arrow chunks in any order, with nulls and ties."""
    e = spark.read.parquet(EVENTS).withColumn("value", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value"))).withColumn("user_id", F.col("user_id") % 3)
    for lo, hi in ((0, 500), (500, 1000)):
        e.where(f"event_id >= {lo} and event_id < {hi}").orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = R.drained(R.running_best(R.read_log(spark, str(tmp_path / "log"))), "best_stream").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {r.event_id: (r.run, None if r.best != r.best else r.best, r.improved) for r in got.itertuples()}
    rows = sorted(e.collect(), key=lambda r: (r.event_id >= 500, r.ts, r.event_id))
    first = {r.event_id >= 500 for r in rows}
    assert first == {False, True} and len(found) == len(rows) == 1000
    best: dict = {}
    for r in rows:
        before = best.get(r.user_id)
        better = r.value is not None and (before is None or r.value > before)
        best[r.user_id] = r.value if better else before
        assert found[r.event_id] == (r.user_id, best[r.user_id], better)


def _log(spark, rows):
    df = spark.createDataFrame(rows, "run long, stage string, round long, t string, event string, n long")
    return df.select("run", "stage", "round", F.to_timestamp("t").alias("ts"), "event", "n")


def test_rounds_close_and_abort(spark, tmp_path):
    """Fixture of rounds: one that ends, one whose end comes in a later batch, one that never ends, late and repeated events."""
    day = "2024-01-01 "
    batches = [
        [(1, "model", 1, day + "00:00:00", "start", 1), (1, "model", 1, day + "00:01:00", "retry", 2), (1, "model", 1, day + "00:02:00", "end", 1), (1, "model", 2, day + "00:03:00", "start", 1), (2, "feature", 1, day + "00:03:30", "start", 1), (2, "feature", 1, day + "00:04:00", "fallback", 1)],
        [(1, "model", 2, day + "00:10:00", "retry", 1), (1, "model", 2, day + "00:10:00", "retry", 1), (1, "model", 2, day + "00:12:00", "end", 1)],
        [(9, "task", 1, day + "06:00:00", "start", 1), (9, "task", 1, day + "06:00:01", "end", 1)],  # moves the watermark past the gap
        [(9, "task", 2, day + "09:00:00", "start", 1), (9, "task", 2, day + "09:00:01", "end", 1)],
        [(3, "task", 1, day + "01:00:00", "start", 1)],  # late by the watermark of the batch before the last: dropped
        [(9, "task", 3, day + "12:00:00", "start", 1), (9, "task", 3, day + "12:00:01", "end", 1)],
    ]
    for rows in batches:
        _log(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        __import__("time").sleep(1.1)  # files are taken by age
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = R.read_log(spark, str(tmp_path / "log"), "run long, stage string, round long, ts timestamp, event string, n long")
    got = {(r.run, r.stage, r["round"]): (r.status, r.duration_ms, r.events, r.retries, r.fallbacks) for r in R.drained(R.rounds(stream), "rounds_stream").collect()}
    assert got == {
        (1, "model", 1): ("completed", 120_000, 2, 2, 0), (1, "model", 2): ("completed", 540_000, 2, 2, 0), (2, "feature", 1): ("aborted", 30_000, 1, 0, 1),
        (9, "task", 1): ("completed", 1_000, 0, 0, 0), (9, "task", 2): ("completed", 1_000, 0, 0, 0), (9, "task", 3): ("completed", 1_000, 0, 0, 0),
    }


def test_merge_batches_keeps_the_newest(spark, tmp_path):
    e = _split(spark, tmp_path)
    stream = R.read_log(spark, str(tmp_path / "log")).select("user_id", "event_type")
    R.merge_batches(stream, str(tmp_path / "out"), ["user_id"], str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert R.newest(spark, str(tmp_path / "out"), ["user_id"]).count() == e.select("user_id").distinct().count()
