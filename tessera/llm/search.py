"""Ranked lexical search: every item's best documents, by the Best Position Algorithm over impact-ordered lists.

One pass over the texts keeps, for each document, the item terms it holds and how often; term statistics are sums over
that table. Then every task makes a list for each term of the documents it reads, by falling impact, and searches it for
all items. A read of a list gives a document, direct accesses give its score and mark its places in the item's other lists,
and a list's best position is the end of its first gapless run of marked places. No document that is still unseen scores
more than the impacts there add up to, so a search stops once that sum is below the item's k-th score so far; at a
tie it goes on. A task keeps k documents an item, and windows choose among those.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, text_slices, written
from tessera.llm.words import Keys, Scanner, same_bytes

#: Fixed value: what a term is made of; A-Z are lower-cased.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
POSTINGS = 1 << 22


class Terms:
    """The distinct terms of some items, and where documents hold them: found by fingerprint, then compared by bytes."""

    def __init__(self, terms: list[bytes]):
        self.id = {t: i for i, t in enumerate(terms)}
        self.words = np.frombuffer(b"".join(terms), np.uint8)
        self.begin = np.cumsum([0, *map(len, terms)])
        joined = np.frombuffer(b" ".join(terms), np.uint8)
        prints = Scanner("alnum").scan(joined, np.array([0, len(joined)]))[2]
        values, self.term = np.unique(prints, return_index=True)
        self.keys = Keys(values)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and which terms."""
        at, which = self.keys.find(prints)
        term = self.term[which]
        same = same_bytes(data, starts[at], ends[at], term, self.words, self.begin)
        for i in np.flatnonzero(~same).tolist():  # another word with a term's fingerprint
            term[i] = self.id.get(data[starts[at[i]] : ends[at[i]]].tobytes().translate(_LOWER), -1)
        return at[term >= 0], term[term >= 0]


def item_terms(texts: list[str | None]) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """Distinct terms of all texts; for each text its terms' places among them, and how often it holds each."""
    found = [TERM.findall((t or "").encode().translate(_LOWER)) for t in texts]
    terms = sorted(set().union(*found))
    place = {t: i for i, t in enumerate(terms)}
    return terms, [np.unique(np.array([place[t] for t in x], np.int64), return_counts=True) for x in found]


def forward_index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), and the given terms that the document holds with how often (terms, tfs); documents without any term are left out."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        scanner, wanted = Scanner("alnum"), Terms(held.value)
        for batch in batches:
            for low, high, data, offsets in text_slices(batch, "text"):
                starts, ends, prints, first = scanner.scan(data, offsets)
                at, term = wanted.find(data, starts, ends, prints)
                key, tf = np.unique((np.searchsorted(first, at, "right") - 1) * len(wanted.id) + term, return_counts=True)
                row, term = key // max(1, len(wanted.id)), key % max(1, len(wanted.id))
                n = np.diff(first)
                cuts = pa.array(np.searchsorted(row, np.arange(high - low + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


@dataclass
class Best:
    """The k best of the documents shown so far: highest score, then lowest id, a null id last."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        able = score >= max(1, self.kth())
        if able.any():
            score, doc, known = (np.concatenate(x) for x in ((self.score, score[able]), (self.doc, doc[able]), (self.known, known[able])))
            order = np.lexsort((doc, ~known, -score))[: self.k]
            self.score, self.doc, self.known = score[order], doc[order], known[order]

    def kth(self) -> int:
        """The score to beat; 0 until there are k."""
        return int(self.score[-1]) if len(self.score) == self.k else 0


class ImpactLists:
    """Lists of the documents of some rows, one a term, by falling impact (its share of a score, before the term's weight).

    Rows are also kept one after the other, so that a document's places in all lists are one range: its direct accesses.
    """

    def __init__(self, doc: np.ndarray, known: np.ndarray, first: np.ndarray, term: np.ndarray, impact: np.ndarray, many: int):
        self.doc, self.known, self.first, self.term, self.impact = doc, known, first, term, impact
        row = np.repeat(np.arange(len(doc)), np.diff(first))
        order = np.lexsort((row, -impact, term))
        self.row, self.falling = row[order], impact[order]
        self.begin = np.searchsorted(term[order], np.arange(many + 1))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.weight, self.shift, self.scored = np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros(len(doc), bool)

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best, step: int = 16) -> int:
        """Adds to `best` the rows that belong there, for terms of positive weight; returns how many rows were scored."""
        low, size = self.begin[terms], np.diff(self.begin)[terms]
        terms, weight, low, size = (x[size > 0] for x in (terms, weight, low, size))
        if not len(terms):
            return 0
        begin = np.cumsum(size + 1) - size - 1  # one place more for each list, never marked
        marked = np.zeros(int((size + 1).sum()), bool)
        self.weight[terms], self.shift[terms] = weight, begin - low
        seen, depth, run = [], 0, np.zeros(len(terms), np.int64)
        while True:
            # unseen rows stand behind every list's best position
            bound = np.where(run < size, self.falling[low + np.maximum(np.minimum(run, size) - 1, 0)], 0)
            most = int((weight * bound).sum())
            if not most or best.kth() > most:
                break
            read = np.clip(size - depth, 0, step)
            at = np.repeat(low + depth - np.cumsum(read) + read, read) + np.arange(read.sum())
            rows = self.row[at]
            rows = np.unique(rows[~self.scored[rows]])
            self.scored[rows] = True
            seen.append(rows)
            many = self.first[rows + 1] - self.first[rows]
            entry = np.repeat(self.first[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())
            term = self.term[entry]
            share = self.weight[term]
            if len(rows):
                best.add(np.add.reduceat(share * self.impact[entry], np.cumsum(many) - many), self.doc[rows], self.known[rows])
            mine = share > 0
            marked[self.place[entry[mine]] + self.shift[term[mine]]] = True
            gaps = np.flatnonzero(~marked)
            run = gaps[np.searchsorted(gaps, begin)] - begin
            depth, step = depth + step, 2 * step
        self.weight[terms] = 0
        for rows in seen:
            self.scored[rows] = False
        return sum(map(len, seen))


def lists_of(batch: pa.RecordBatch, many: int, documents: int, length: int, weight: np.ndarray, most: int = POSTINGS):
    """The impact lists of a batch of the forward index, of runs of rows of about `most` postings; terms without weight are left out."""
    column = batch.column("terms")
    cut = column.offsets.to_numpy().astype(np.int64)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(cut, cut[low] + most, "right")) - 1)
        term = column.values.to_numpy()[cut[low] : cut[high]].astype(np.int64)
        tf = batch.column("tfs").values.to_numpy()[cut[low] : cut[high]].astype(np.int64)
        n = batch.column("n")[low:high]
        norm = np.array([25 + 75 * x * documents // length for x in n.to_pylist()], np.int64)
        of = np.repeat(np.arange(high - low), np.diff(cut[low : high + 1]))
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm[of])
        some = weight[term] > 0
        first = np.searchsorted(of[some], np.arange(high - low + 1))
        ids = batch.column("doc_id")[low:high]
        yield ImpactLists(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), first, term[some], impact[some], many)
        low = high


def _block(docs: DataFrame, texts: list[str | None], k: int) -> DataFrame:
    """item (its place in texts), doc_id, score: k rows an item and task at most."""
    terms, items = item_terms(texts)
    spark = docs.sparkSession
    index = written(forward_index(docs, terms), "forward-index")
    documents, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r[0]: r[1] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect()}  # a row a term of the items
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
    weighted = [(t[weight[t] > 0], (n * weight[t])[weight[t] > 0]) for t, n in items]
    held = spark.sparkContext.broadcast((weight, weighted))

    def run(batches):
        weight, items = held.value
        best = [Best(k) for _ in items]
        for batch in batches:
            for lists in lists_of(batch, len(weight), documents, length, weight):
                for (terms, share), mine in zip(items, best, strict=True):
                    lists.search(terms, share, mine)
        for low in range(0, len(best), 4096):
            part = best[low : low + 4096]
            item = np.repeat(np.arange(low, low + len(part)), [len(b.doc) for b in part])
            doc, known, score = (np.concatenate([getattr(b, n) for b in part]) for n in ("doc", "known", "score"))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=~known), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, most_items: int = 5_000, most_bytes: int = 1 << 24) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents with a score above 0, all if fewer.

    docs has doc_id and text, items item_id and text. Items are held in tasks in parts of about most_items items and
    most_bytes of text; more items mean more passes over the documents. A null or empty text has no terms: such a
    document is found by nothing and not counted, such an item finds nothing. Equal scores rank by ascending doc_id, a
    null doc_id last; repeated rows of documents are documents each, repeated items are answered each; other columns
    are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    items = items.select("item_id", F.col("text").cast("string"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // most_items), -(-size // most_bytes))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    dealt = written(dealt, "items") if parts > 1 else dealt
    out = None
    for part in range(parts):
        rows = dealt.where(F.col("part") == part).select("item_id", "text").collect()
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = _block(docs, [r[1] for r in rows], k)
        # first among some of the tasks' rows, then among the k of each such group
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for by in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(64))], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # names: most_items rows
        out = found if out is None else out.unionByName(found)
    return out


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
