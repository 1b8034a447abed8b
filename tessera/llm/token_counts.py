"""Token counts of documents in flat token files without an index, by a vectorised search for the end-of-document id."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh_dir, table, text_slices, written
from tessera.llm.encode import encoder, shipped, vocabulary
from tessera.llm.token_files import store

#: The byte-level vocabulary's own end-of-document id. Texts are encoded as ordinary text, so no text's ids hold it.
END_ID = 50256


def write_flat_files(docs: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Each task's documents, in its order, as one flat file of uint16 ids, end_id after each; returns file, ordinal, doc_id.

    Null and empty texts are empty documents, a null doc_id stays null, and repeated rows are documents each. The order
    inside a file is that of the rows; nothing is shuffled. Other columns are ignored; an empty table gives no files.
    """
    folder, held = folder or fresh_dir(docs.sparkSession, "flat-tokens"), shipped(docs.sparkSession, path)

    def run(batches):
        code = encoder(held, ordinary=True)
        if max(code.tokenizer.get_vocab_size() - 1, end_id) >= 65536:
            raise ValueError("flat files hold ids of two bytes")
        end = np.array([end_id], "<u4").tobytes()
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        system, place = store(uri)
        out, n = None, 0
        for batch in batches:
            for first, last, _, _ in text_slices(batch, "text"):
                if out is None:
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(place)
                ids = b"".join(x + end for x in code.ids(batch.column("text")[first:last].to_pylist()))
                out.write(np.frombuffer(ids, "<u4").astype("<u2").tobytes())
                size = last - first
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(uri), size), pa.array(np.arange(n, n + size), pa.int64()), batch.column("doc_id")[first:last]], ["file", "ordinal", "doc_id"])
                n += size
        if out is not None:
            out.close()

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, ordinal long, doc_id long"), "flat-order")


def count_tokens(files: DataFrame, end_id: int = END_ID, block_ids: int = 1 << 20) -> DataFrame:
    """file, ordinal, start, n_tokens for each document of the flat uint16 files named by column `file`.

    Every block of block_ids ids is searched on its own: it gives the gaps between the end ids it holds and the place
    of its last one. A running maximum of those places and a running sum of their number over a file's blocks (one row
    a block) then tell where the document that a block begins in started, and its ordinal. Ids after the last end id
    of a file are a last document without an end. An empty file has no documents; a repeated file counts once.
    """

    def blocks(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, place = store(uri)
                n = -(-system.get_file_info(place).size // (2 * block_ids))
                for low in range(0, n, 4096):
                    part = np.arange(low, min(n, low + 4096))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(uri), len(part)), pa.array(part, pa.int64()), pa.array(part == n - 1)], ["file", "block", "closing"])

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, place = store(row["file"])
                begin = row["block"] * block_ids
                with system.open_input_file(place) as file:
                    ids = np.frombuffer(file.read_at(2 * block_ids, 2 * begin), "<u2")
                ends = np.flatnonzero(ids == end_id)
                gaps = np.diff(ends, prepend=-1) - 1
                stop = begin + int(ends[-1]) if len(ends) else -1
                open_end = row["closing"] and (not len(ends) or ends[-1] != len(ids) - 1)
                if open_end:
                    gaps = np.append(gaps, len(ids) - 1 - (ends[-1] if len(ends) else -1))
                yield pa.RecordBatch.from_pydict({"file": [row["file"]], "block": [row["block"]], "begin": pa.array([begin], pa.int64()), "stop": pa.array([stop], pa.int64()), "n": pa.array([len(ends)], pa.int64()), "gaps": pa.array([gaps], pa.list_(pa.int64()))})

    named = files.select("file").where("file is not null").distinct()
    listed = named.repartition(named.count() or 1).mapInArrow(blocks, "file string, block long, closing boolean")
    listed = written(listed, "token-blocks")
    found = listed.repartition(max(1, listed.count() // 4)).mapInArrow(scan, "file string, block long, begin long, stop long, n long, gaps array<long>")
    found = written(found, "token-gaps")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.withColumn("stop", F.coalesce(F.max("stop").over(before), F.lit(-1))).withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0)))
    each = stitched.select("file", "block", "begin", "stop", "n", F.posexplode("gaps").alias("i", "gap"))
    inside = F.coalesce(F.sum(F.col("gap") + 1).over(Window.partitionBy("file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = F.col("begin") - F.col("stop") - 1
    return each.withColumn("inside", inside).select(
        "file", (F.col("n") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("stop") + 1).otherwise(F.col("begin") + F.col("inside")).alias("start"),
        F.when(F.col("i") == 0, F.col("gap") + carried).otherwise(F.col("gap")).alias("n_tokens"),
    )


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    order = write_flat_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return order.join(count_tokens(order), ["file", "ordinal"]).select("doc_id", "start", "n_tokens")
