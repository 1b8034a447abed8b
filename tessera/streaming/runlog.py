"""Run-event logs as streams: ingestion, rounds, failure capture, running best, budgets, windows, duplicates and sinks.

Every function takes a streaming DataFrame or a static one; a batch over the same log gives the expected rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The event names that count as failures.
FAILURES = ("error", "retry", "fallback", "timeout", "aborted", "exception")
LOG_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, per_batch: int = 1, form: str = "parquet") -> DataFrame:
    """A file stream of a log in which `props` is free JSON."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(form).load(path)


def with_counter(log: DataFrame) -> DataFrame:
    return log.withColumn("k", F.from_json("props", "k long")["k"])


def deduplicated(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, later copies within the watermark dropped."""
    if log.isStreaming:
        return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return log.dropDuplicates(["event_id"])


def failure_counts(log: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Failure events by window and name."""
    marked = log.withWatermark("ts", late) if log.isStreaming else log
    counted = marked.where(F.col("event_type").isin(*FAILURES)).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def interval_counts(log: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and their total value by window (sliding if `slide` is given) and type."""
    marked = log.withWatermark("ts", late) if log.isStreaming else log
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return marked.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(log: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Activity sessions of each user."""
    marked = log.withWatermark("ts", late) if log.isStreaming else log
    found = marked.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def transition(retries: Column, fallbacks: Column, failures: Column) -> Column:
    """What the record of a round asks for next."""
    return F.when(fallbacks > 0, "fallback_to_best_runnable").when((retries > 0) | (failures > 0), "revise_affected_plan").otherwise("retain_plan")


def plan_of(stage: Column) -> Column:
    s = F.lower(stage)
    return F.when(s.contains("feature"), "feature").when(s.contains("calib") | s.contains("distill") | s.contains("output"), "output").when(s.contains("model") | s.contains("train"), "model").otherwise("task")


def rounds(log: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Rounds of (run, stage, round): opened by `start`, counted, closed by `end` or, with the watermark, as aborted.

    log: run, stage, round, ts, event, n. One record a round: status, duration_ms, events, retries, fallbacks. State is
    one row a round; a round that never ends is closed when event time passes its last event by the gap.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    late_ms = int(pd.Timedelta(gap).total_seconds() * 1000)

    class Rounds(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("round", "first long, last long, events long, retries long, fallbacks long")

        def _record(self, key, status):
            first, last, events, retries, fallbacks = self.state.get()
            self.state.clear()
            return pd.DataFrame({"run": [key[0]], "stage": [key[1]], "round": [key[2]], "status": [status], "duration_ms": [last - first], "events": [events], "retries": [retries], "fallbacks": [fallbacks]})

        def handleInputRows(self, key, rows, timerValues):
            ended = False
            for pdf in rows:
                at = (pdf["ts"].astype("int64") // 10**6 if str(pdf["ts"].dtype).endswith("ns]") else pdf["ts"].astype("int64") // 10**3)
                first, last, events, retries, fallbacks = self.state.get() if self.state.exists() else (int(at.min()), int(at.max()), 0, 0, 0)
                inner = ~pdf["event"].isin(["start", "end"])
                count = lambda name: int(pdf.loc[pdf["event"] == name, "n"].sum())
                self.state.update((min(first, int(at.min())), max(last, int(at.max())), events + int(pdf.loc[inner, "n"].sum()), retries + count("retry"), fallbacks + count("fallback")))
                ended |= bool((pdf["event"] == "end").any())
            if ended:
                yield self._record(key, "completed")
            elif self.state.exists():
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(self.state.get()[1] + late_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.state.exists():
                yield self._record(key, "aborted")

        def close(self):
            pass

    schema = "run long, stage string, round long, status string, duration_ms long, events long, retries long, fallbacks long"
    return log.withWatermark("ts", late).groupBy("run", "stage", "round").transformWithStateInPandas(Rounds(), schema, "Append", "EventTime")


def running_best(log: DataFrame) -> DataFrame:
    """run, best and improved for every event, in event-time order of each micro batch; state is one row a run.

    A run's events of one micro batch are gathered (the trigger bounds them) and sorted, ties by event_id. A null value
    improves nothing; before any value, best is null.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, parts, state: GroupState):
        start = state.get[0] if state.exists else float("-inf")
        pdf = pd.concat([p[["ts", "event_id", "value"]] for p in parts]).sort_values(["ts", "event_id"])
        top = pdf["value"].fillna(float("-inf")).cummax().clip(lower=start)
        before = top.shift(fill_value=start)
        yield pd.DataFrame({"run": key[0], "event_id": pdf["event_id"], "best": top.replace(-np.inf, np.nan), "improved": pdf["value"].notna() & (top > before)})
        state.update((float(top.iloc[-1]),))

    return log.groupBy("user_id").applyInPandasWithState(step, "run long, event_id long, best double, improved boolean", "best double", "append", GroupStateTimeout.NoTimeout)


def merge_batches(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: list[str] | None = None):
    """A query that keeps one row a key in a keyed table: the newest by `order`, then by batch."""
    held = _keyed(stream.sparkSession, path, keys, order)
    return stream.writeStream.foreachBatch(lambda batch, number: held.merge(batch.withColumn("batch", F.lit(number)), number)).option("checkpointLocation", checkpoint)


def newest(spark: SparkSession, path: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows that merge_batches keeps: base and the batches since, no older ones."""
    return _keyed(spark, path, keys, order).read()


def _keyed(spark: SparkSession, path: str, keys: list[str], order: list[str] | None):
    from tessera.streaming.keyed import KeyedTable

    return KeyedTable(spark, path, keys, [*(order or []), "batch"])


def drained(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """All rows of a finite stream, by an available-now run into a memory table."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return stream.sparkSession.table(name)
