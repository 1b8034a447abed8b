"""Benchmark passages in documents: a prefix-filtered join of item windows with document shingles, verified exactly.

A window must occur whole, so all of its shingles must, and by the prefix principle one is enough to find it: the
rarest in the order of how often the corpus holds them. A document place with that shingle fixes where the window
would begin; windows that would not fit the document there are dropped, the others are compared word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table, text_slices, written
from tessera.llm.words import Keys, Scanner, mix


def _rolling(prints: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the runs of `width` words that begin at each word; the last width - 1 have none."""
    n = max(0, len(prints) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0xE7037ED1A0B428DB) + prints[k : k + n] + np.uint64(k + 1))
    return out


def _words(scanner: Scanner, texts: list[str]) -> list[np.ndarray]:
    data = [x.encode() for x in texts]
    offsets = np.cumsum([0, *map(len, data)])
    _, _, prints, first = scanner.scan(np.frombuffer(b"".join(data), np.uint8), offsets)
    return [prints[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def item_windows(items: list[tuple[str | None, str | None]], window: int) -> list[tuple[str | None, np.ndarray]]:
    """(item_id, word fingerprints) for each run of `window` words of an item, or the whole of a shorter one; none for no words."""
    scanner = Scanner("alnum")
    out = {}
    for (item_id, _), words in zip(items, _words(scanner, [t or "" for _, t in items]), strict=True):
        for i in range(max(1, len(words) - window + 1)) if len(words) else ():
            part = words[i : i + window]
            out.setdefault((item_id, part.tobytes()), part)
    return [(item_id, part) for (item_id, _), part in out.items()]


def shingle_counts(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, dict[int, int]]:
    """How often all documents hold each wanted shingle, by width. At most as many rows as shingles come back."""

    def run(batches):
        scanner = Scanner("alnum")
        keys = {w: Keys(v) for w, v in wanted.items()}
        counts = {w: np.zeros(len(v), np.int64) for w, v in wanted.items()}
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text"):
                _, _, prints, first = scanner.scan(data, offsets)
                stop = np.repeat(first[1:], np.diff(first))
                for w, k in keys.items():
                    at, which = k.find(_rolling(prints, w))
                    counts[w] += np.bincount(which[at + w <= stop[at]], minlength=len(counts[w]))
        for w, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"width": pa.array(np.full(len(some), w), pa.int32()), "shingle": pa.array(some, pa.int64()), "n": pa.array(n[some], pa.int64())})

    out: dict[int, dict[int, int]] = {w: {} for w in wanted}
    for w, i, n in docs.select("text").mapInArrow(run, "width int, shingle long, n long").groupBy("width", "shingle").agg(F.sum("n")).collect():
        out[w][int(wanted[w][i])] = n
    return out


@dataclass
class Index:
    """Windows by the shingle of their prefix: for each width, sorted shingles, and for each the windows and the place inside."""

    keys: dict[int, Keys]
    begin: dict[int, np.ndarray]
    window: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    words: np.ndarray
    length: np.ndarray
    item: list[str | None]


def prefix_index(windows: list[tuple[str | None, np.ndarray]], docs: DataFrame, window: int, shingle: int) -> Index:
    each = [(w := min(shingle, len(part)), _rolling(part, w)) for _, part in windows]
    wanted = {w: np.unique(np.concatenate([h for v, h in each if v == w])) for w in {w for w, _ in each}}
    counts = shingle_counts(docs, wanted) if wanted else {}
    entries: dict[int, list[tuple[int, int, int]]] = {w: [] for w in wanted}
    for i, (w, h) in enumerate(each):
        _, rarest, place = min((counts[w].get(x, 0), x, k) for k, x in enumerate(h.tolist()))
        entries[w].append((rarest, i, place))
    out = Index({}, {}, {}, {}, np.zeros((len(windows), window), np.uint64), np.array([len(p) for _, p in windows], np.int64), [k for k, _ in windows])
    for i, (_, part) in enumerate(windows):
        out.words[i, : len(part)] = part
    for w, rows in entries.items():
        rows.sort()
        shingles = np.array([r[0] for r in rows], np.uint64)
        values, begin = np.unique(shingles, return_index=True)
        out.keys[w], out.begin[w] = Keys(values), np.append(begin, len(rows))
        out.window[w], out.offset[w] = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
    return out


def occurrences(index: Index, prints: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window inside one of the texts whose words begin at `first`."""
    n = np.diff(first)
    low, high = np.repeat(first[:-1], n), np.repeat(first[1:], n)
    starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w, keys in index.keys.items():
        at, which = keys.find(_rolling(prints, w))
        begin, many = index.begin[w][which], np.diff(index.begin[w])[which]
        entry = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        at, win = np.repeat(at, many), index.window[w][entry]
        start = at - index.offset[w][entry]
        fits = (start >= low[at]) & (start + index.length[win] <= high[at])
        start, win = start[fits], win[fits]
        for k in range(index.words.shape[1]):
            longer = index.length[win] > k
            same = ~longer
            same[longer] = prints[start[longer] + k] == index.words[win[longer], k]
            start, win = start[same], win[same]
        starts.append(start)
        windows.append(win)
    return np.concatenate(starts), np.concatenate(windows)


def _hits(docs: DataFrame, index: Index, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs, n_words, hit (begin and end of each run of hit words) and items (ids with occurrences)."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    added = [pa.field("n_words", pa.int64()), pa.field("hit", pa.list_(pa.int64())), pa.field("items", pa.list_(pa.string()))]

    def run(batches):
        scanner = Scanner("alnum")
        index = held.value
        for batch in batches:
            for low, high, data, offsets in text_slices(batch, "text"):
                _, _, prints, first = scanner.scan(data, offsets)
                start, win = occurrences(index, prints, first)
                doc = np.searchsorted(first, start, "right") - 1
                hit: list[list[int]] = [[] for _ in range(high - low)]
                items: list[set[str]] = [set() for _ in range(high - low)]
                for k in np.lexsort((start, doc)).tolist():
                    d, begin, end = int(doc[k]), int(start[k] - first[doc[k]]), int(start[k] - first[doc[k]] + index.length[win[k]])
                    if hit[d] and begin <= hit[d][-1]:
                        hit[d][-1] = max(hit[d][-1], end)
                    else:
                        hit[d] += [begin, end]
                    if index.item[win[k]] is not None:
                        items[d].add(index.item[win[k]])
                part = batch.slice(low, high - low).select(keep)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(first), pa.int64()), pa.array(hit, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], schema=pa.schema([*part.schema, *added]))

    schema = docs.select(*keep).schema.add("n_words", "long").add("hit", T.ArrayType(T.LongType())).add("items", T.ArrayType(T.StringType()))
    return docs.mapInArrow(run, schema)


def find_passages(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 3, most_items: int = 20_000, most_bytes: int = 1 << 26, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of docs, n_words, hit (begins and ends of runs of hit words, in turn), items (item_ids with an occurring window).

    Items (item_id, text) are held in tasks only in parts of about most_items items and most_bytes of text; more items
    mean more passes over the documents, whose hits are then merged. Words are compared by 64-bit fingerprints. Null texts have no words. Items without words are never found; an item
    with a null id hits words but is not listed. Repeated rows each get a result; an empty table of documents gives no
    rows, an empty table of items no hits. Other columns, whatever their names, are kept only if asked for.
    """
    docs, keep = docs.select(*dict.fromkeys([*keep, "text"])), list(keep)
    items = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // most_items), -(-size // most_bytes))
    if parts <= 1:
        return _hits(docs, prefix_index(item_windows([tuple(r) for r in items.collect()], window), docs, window, shingle), keep)
    numbered = written(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "items")
    docs = docs.withColumn("_text", F.sha2("text", 256))
    found = None
    for k in range(parts):
        rows = [tuple(r)[:2] for r in numbered.where(F.col("part") == k).collect()]
        hits = written(_hits(docs, prefix_index(item_windows(rows, window), docs, window, shingle), [*keep, "_text"]), "hits")
        found = hits if found is None else found.unionByName(hits)
    pairs = F.when(F.sum(F.size("hit")) > 0, F.flatten(F.collect_list(F.when(F.size("hit") > 0, F.expr("transform(sequence(1, size(hit) div 2), i -> struct(hit[2 * i - 2] as b, hit[2 * i - 1] as e))")))))
    merged = F.expr("aggregate(array_sort(pairs), cast(array() as array<bigint>), (a, p) -> if(size(a) > 0 and p.b <= element_at(a, -1), concat(slice(a, 1, size(a) - 1), array(greatest(element_at(a, -1), p.e))), concat(a, array(p.b, p.e))))")
    grouped = found.groupBy(*keep, "_text", "n_words").agg(pairs.alias("pairs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / parts).cast("int").alias("copies"))
    return grouped.select(*keep, F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "n_words", F.coalesce(merged, F.expr("cast(array() as array<bigint>)")).alias("hit"), "items").drop("copy")


def n_hit() -> Column:
    return F.expr("aggregate(hit, 0L, (s, x) -> x - s)")  # ends less begins, in turn


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("n_hit", n_hit())
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))
