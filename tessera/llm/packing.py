"""Packing documents into sequences of a fixed number of tokens: exact complements by length sums, then best fit.

Only the number of pieces of each length (at most `room` rows) comes to the driver. The plan is a list of patterns
(lengths that share a sequence) with how often each is used; pieces find their places by their rank among those of
their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, text_slices, written
from tessera.llm.encode import encoder, shipped, vocabulary


def cut_pieces(docs: DataFrame, path: str, end_id: int, room: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with the end id, in pieces of at most room ids."""
    held = shipped(docs.sparkSession, path)

    def run(batches):
        code = encoder(held)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * room
        for batch in batches:
            for first, last, _, _ in text_slices(batch, "text"):
                keys = batch.column("doc_id")[first:last].to_pylist()
                rows = []
                for key, ids in zip(keys, code.ids(batch.column("text")[first:last].to_pylist()), strict=True):
                    ids += end
                    rows += [(key, i, i * room, len(part := ids[i * step : (i + 1) * step]) // 4, zlib.crc32(part)) for i in range(-(-len(ids) // step))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_fit(left: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts: all sequences with one content are moved together."""
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(room, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in opened if g >= length), default=None)
            if gap is None:
                pattern, many = (), n
            else:
                pattern, many = opened[gap].pop()
                if not opened[gap]:
                    del opened[gap]
            used = min(n, many)
            if gap is not None and many > used:
                opened.setdefault(gap, []).append((pattern, many - used))
            opened.setdefault(room - sum(pattern) - length, []).append(((*pattern, length), used))
            n -= used
    return [x for group in opened.values() for x in group]


Patterns = list[tuple[tuple[int, ...], int]]


def _complements(whole: np.ndarray, room: int, depth: int, reserve: int) -> Patterns:
    """Exactly full patterns: from the longest length down, the gap that it leaves is looked up among single lengths, then sums of two, then of three.

    Sums of two and three take no length under `reserve`, so that short pieces stay for the gaps that remain. A pattern
    is used as often as the counts allow, so each ends some length's stock.
    """
    left, out = whole.copy(), []

    def take(pattern: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        if n := min(int(left[x]) // k for x, k in need.items()):
            out.append((pattern, n))
            for x, k in need.items():
                left[x] -= n * k

    def two(total: int) -> np.ndarray:
        """Larger halves a of a + b = total with both at hand, largest first."""
        b = np.arange(reserve, total // 2 + 1)
        return total - b[(left[b] > 0) & (left[total - b] > 0)]

    if left[room]:
        take((room,))
    for length in range(room - 1, 0, -1):
        gap = room - length
        if left[length] and left[gap]:
            take((length, gap))
        if depth >= 2 and left[length]:
            for a in two(gap).tolist():
                take((length, a, gap - a))
                if not left[length]:
                    break
        if depth >= 3 and left[length]:
            for a in np.flatnonzero(left[: gap - 1])[::-1].tolist():
                if 3 * a < gap or not left[length]:
                    break
                for b in two(gap - a).tolist():
                    take((length, a, b, gap - a - b))
                    if not left[length] or not left[a]:
                        break
    return out


def _completed(exact: Patterns, kept: int, first: bool, whole: np.ndarray, room: int) -> Patterns:
    """`kept` sequences of the exact patterns, from the first or the last on, and best fit for all other pieces."""
    out, left = [], whole.copy()
    for pattern, n in exact if first else exact[::-1]:
        if n := min(n, kept):
            kept -= n
            out.append((pattern, n))
            for x in pattern:
                left[x] -= n
    return out + _best_fit(left, room)


def plan(counts: dict[int, int], room: int) -> Patterns:
    """Patterns and how often each is used, for `counts` pieces of each length; every piece has exactly one place.

    Sequences come from exact complements by single, pair and triple sums, what is left from best fit. Full sequences
    may use up the short pieces that others need, so a plan above the least number of sequences that the tokens allow is
    repaired: some of its exact sequences, those made last or first, are opened again and their pieces go to best fit
    with the rest. Of all such plans, with sums of three or of two, sparing short pieces or not, that of the fewest
    sequences is taken, and of those the one that keeps the most exact ones.
    """
    whole = np.zeros(room + 1, np.int64)
    for length, n in counts.items():
        whole[length] += n
    least = max(-(-int(whole @ np.arange(room + 1)) // room), int(whole[room // 2 + 1 :].sum()))
    size = lambda patterns: sum(n for _, n in patterns)
    best: tuple[tuple[int, int], Patterns] | None = None
    for depth, reserve in ((3, 1), (3, max(1, room // 16)), (2, 1), (2, max(1, room // 16))):
        exact = _complements(whole, room, depth, reserve)
        n = size(exact)
        for opened in dict.fromkeys(min(n, x) for x in (0, *(-(-n * k // 64) for k in (1, 2, 4, 8, 16, 32, 48)))):
            for first in (True, False) if opened else (True,):
                patterns = _completed(exact, n - opened, first, whole, room)
                rank = size(patterns), opened - n
                if best is None or rank < best[0]:
                    best = rank, patterns
            if best[0][0] <= least:
                break
    return best[1] if best else []


class Places:
    """Where the piece of a length and rank goes. At most some slots a length for each pattern, and patterns are no more than a few a length."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for pattern, n in patterns:
            offset = 0
            for length in pattern:
                rows.append((length, used.get(length, 0), sequence, offset))
                used[length] = used.get(length, 0) + n
                offset += length
            sequence += n
        slots = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.base, self.sequence, self.offset = slots[:, 1], slots[:, 2], slots[:, 3]
        self.lengths, self.first = np.unique(slots[:, 0], return_index=True)
        self.last = np.append(self.first[1:], len(slots))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(part):
                k = int(np.searchsorted(self.lengths, length[part[0]]))
                slot = self.first[k] + np.searchsorted(self.base[self.first[k] : self.last[k]], rank[part], "right") - 1
                sequence[part], offset[part] = self.sequence[slot] + rank[part] - self.base[slot], self.offset[slot]
        return sequence, offset


def pack(pieces: DataFrame, room: int, per_task: int = 100_000) -> DataFrame:
    """pieces with sequence_id and offset. Column length says how long each is, from 1 to room.

    Ties of length are ranked by doc_id, piece and checksum in salted parts of about per_task rows, so that one very
    common length is no single task's work. Equal rows take different places; columns sequence_id and offset are
    replaced. An empty table stays empty.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `room` rows
    held = pieces.sparkSession.sparkContext.broadcast(Places(plan(counts, room)))
    salts = 1 + sum(counts.values()) // per_task
    # equal rows of a written table are told apart by their place in it
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    base = sizes.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_base"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        found = held.value.find(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["sequence_id", "offset"])

    joined = ranked.join(base, ["length", "_salt"]).withColumn("_place", place(F.col("length"), F.col("_rank") + F.col("_base")))
    return joined.select(*(c for c in pieces.columns if c not in ("sequence_id", "offset")), "_place.*")


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, room: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for all documents.

    A null or empty text is its end id alone; only texts longer than a sequence are cut. A null doc_id stays null;
    repeated rows are packed each, ties of length take places by doc_id and piece; other columns are ignored. An empty
    table gives no rows.
    """
    return pack(written(cut_pieces(docs, path, end_id, room), "pieces"), room)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
