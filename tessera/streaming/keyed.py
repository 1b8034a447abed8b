"""A keyed table that streams merge into: the newest row of each key, whatever is replayed."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """A folder with one row a key: a base version, the batches merged since, and a pointer to the base.

    Batches are written under their number, so a replayed batch replaces itself. `order` columns say which row of a key is
    newer; rows that agree in them are told apart by their hash, so any replay gives the same one. Compaction writes base
    and batches as a new version and then moves the pointer, a small file that is replaced as a whole; a reader has the old
    version or the new one. A batch up to the pointer's that comes again is already in its base and is skipped.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], compact_after: int = 20):
        self.spark, self.path, self.keys, self.order, self.compact_after = spark, path.rstrip("/"), keys, order, compact_after

    def _store(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, pattern: str) -> list[int]:
        store = self._store()
        if not store.exists(self._at("")):
            return []
        found = (re.fullmatch(pattern, s.getPath().getName()) for s in store.listStatus(self._at("")))
        return sorted(int(m[1]) for m in found if m and store.exists(self._at(f"{m[0]}/_SUCCESS")))

    def pointer(self) -> dict:
        """version of the base (-1: none) and the number of the last batch in it: those of the newest pointer that is whole."""
        store = self._store()
        if store.exists(self._at("")):
            for n in sorted((int(m[1]) for s in store.listStatus(self._at("")) if (m := re.fullmatch(r"pointer-(\d+)\.json", s.getPath().getName()))), reverse=True):
                row = self.spark.read.text(f"{self.path}/pointer-{n}.json").first()
                try:
                    return json.loads(row[0])
                except (TypeError, ValueError):  # cut off while it was written
                    continue
        return {"version": -1, "batch": -1}

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        last = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in self.order], F.xxhash64(*rows.columns))
        if not rest:
            return rows.distinct()
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), last).alias("_r")).select(*self.keys, "_r.*")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Takes a batch in: its newest row of each key, under its number. The sink of foreachBatch."""
        held = self.pointer()
        if number <= held["batch"]:
            return
        self._newest(batch).write.mode("overwrite").parquet(f"{self.path}/batch-{number}")
        if sum(n > held["batch"] for n in self._names(r"batch-(\d+)")) >= self.compact_after:
            self.compact()

    def _parts(self) -> tuple[dict, list[int]]:
        held = self.pointer()
        return held, [n for n in self._names(r"batch-(\d+)") if n > held["batch"]]

    def read(self) -> DataFrame:
        """The newest row of each key: base and the batches since, no older ones; an error before the first batch."""
        held, since = self._parts()
        paths = [*([f"{self.path}/base-{held['version']}"] if held["version"] >= 0 else []), *(f"{self.path}/batch-{n}" for n in since)]
        return self._newest(self.spark.read.parquet(*paths))

    def compact(self) -> int:
        """Writes what read() gives as the next base, moves the pointer there, then deletes batches and bases that it replaces; returns the version."""
        held, since = self._parts()
        if not since:
            return held["version"]
        version, store = held["version"] + 1, self._store()
        self.read().write.mode("overwrite").parquet(f"{self.path}/base-{version}")
        out = store.create(self._at(f"pointer-{version}.tmp"), True)
        out.write(bytearray(json.dumps({"version": version, "batch": max(since)}).encode()))
        out.close()
        store.rename(self._at(f"pointer-{version}.tmp"), self._at(f"pointer-{version}.json"))
        for n in since:
            store.delete(self._at(f"batch-{n}"), True)
        for n in range(version - 1):  # a reader may still be at the version before
            store.delete(self._at(f"base-{n}"), True)
            store.delete(self._at(f"pointer-{n}.json"), True)
        return version


def merge_stream(stream: DataFrame, table: KeyedTable, checkpoint: str):
    """A writer that merges every micro batch of a stream into a keyed table."""
    return stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint)
