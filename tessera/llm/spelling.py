"""Spelling variants: words one edit apart, found by an index of variable-length grams.

Words are counted over all texts. A gram is lengthened while it is frequent, so the dictionary is short where grams are
rare and long where they are common. A word, between two marks, is decomposed into the grams that start at each place
and end beyond all before them. Whether a gram is in a decomposition hangs on at most `longest` characters up to its end, so
an edit can affect only grams that hang on its place: the most that one edit can affect bounds how many grams two
near words share, and by the prefix principle a word needs to be looked up by no more than one beyond that bound, its
rarest. Lists of words by gram, place and length are merged, and pairs are verified by their distance.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table, text_slices, written
from tessera.llm.words import Scanner, same_bytes

BEGIN, END = "\x02", "\x03"
SHORTEST, LONGEST = 2, 6
#: Places of the table that says how long the lists are; it only orders a word's grams.
PLACES = 1 << 18
#: Pairs whose shorter word has so many code points are compared by way of numbers.
CARRIED = 64


def _crc_table() -> np.ndarray:
    """What CRC-32 adds for each byte value."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of data, going on from the CRC-32 `begin` of what comes before it."""
    table_, state = _crc_table(), ~begin
    rows, k = np.arange(len(starts)), 0
    while len(rows) and k < 64:
        rows = rows[starts[rows] + k < ends[rows]]
        byte = data[starts[rows] + k]
        state[rows] = table_[(state[rows] ^ byte) & 0xFF] ^ (state[rows] >> 8)
        k += 1
    out = ~state
    for i in rows.tolist():
        out[i] = zlib.crc32(data[starts[i] + 64 : ends[i]].tobytes(), int(out[i]))
    return out


def count_words(docs: DataFrame, drop_one_in: int = 97) -> DataFrame:
    """word and n: letter runs of all texts, A-Z lower-cased, and how often they occur.

    The run of a document whose CRC-32 of "<doc_id>:<run>" drop_one_in divides loses the code point at that number modulo
    its length. With a null doc_id nothing is lost; null and empty texts have no runs; repeated rows count each.
    """
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 0x20

    def run(batches):
        scanner = Scanner("letters")
        for batch in batches:
            for low, high, data, offsets in text_slices(batch, "text", 1 << 22):
                starts, ends, prints, first = scanner.scan(data, offsets)
                data = lower[data]
                ids = batch.column("doc_id")[low:high]
                row = np.repeat(np.arange(high - low), np.diff(first))
                before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids.to_pylist()], np.uint32)
                h = crc32_of(data, starts, ends, before[row])
                cut = (h % np.uint32(drop_one_in) == 0) & ids.is_valid().to_numpy(zero_copy_only=False)[row]
                _, at, of = np.unique(prints, return_index=True, return_inverse=True)
                begin = np.concatenate([[0], np.cumsum((ends - starts)[at])])
                words = data[np.repeat(starts[at] - begin[:-1], np.diff(begin)) + np.arange(begin[-1])]
                alone = cut | ~same_bytes(data, starts, ends, of, words, begin)
                n = np.bincount(of[~alone], minlength=len(at))
                found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(words)).filter(pa.array(n > 0))
                yield pa.RecordBatch.from_arrays([found.cast(pa.string()), pa.array(n[n > 0], pa.int64())], ["word", "n"])
                rest: Counter[str] = Counter()
                for i in np.flatnonzero(alone).tolist():
                    word = data[starts[i] : ends[i]].tobytes().decode()
                    if cut[i]:
                        k = int(h[i]) % len(word)
                        word = word[:k] + word[k + 1 :]
                    rest[word] += 1
                rest.pop("", None)
                yield pa.RecordBatch.from_arrays([pa.array(list(rest), pa.string()), pa.array(list(rest.values()), pa.int64())], ["word", "n"])

    runs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame, most: int = 20_000, least: int = 50) -> frozenset[str]:
    """Grams of 2 to LONGEST - 1 characters, counted once for each place in the words, that occur more often than a threshold, and so do all their beginnings.

    The threshold is `least`, or the number of places / `most` if that is more: at most `most` grams of each length reach
    the driver, whatever the words.
    """
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    threshold = max(least, places / most)
    found: frozenset[str] = frozenset()
    for size in range(SHORTEST, LONGEST):
        held = words.sparkSession.sparkContext.broadcast(found)

        def run(batches, size=size, held=held):
            counts: Counter[str] = Counter()
            longer, known = size > SHORTEST, held.value
            for batch in batches:
                for word in batch.column(0).to_pylist():
                    word = BEGIN + word + END
                    grams = [word[i : i + size] for i in range(len(word) - size + 1)]
                    counts.update(g for g in grams if g[:-1] in known) if longer else counts.update(grams)
                if len(counts) > 200_000:
                    yield pa.RecordBatch.from_pydict({"gram": list(counts), "n": pa.array(counts.values(), pa.int64())})
                    counts.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

        counted = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        more = [r.gram for r in counted.where(F.col("n") > threshold).select("gram").collect()]
        if not more:
            break
        found = found.union(more)
    return found


def decompose(word: str, longest: int, frequent: frozenset[str]) -> list[tuple[int, int]]:
    """(begin, end) of the grams of a word between its marks, by begin: at each place the shortest gram that is not frequent, if it ends beyond those before it."""
    out, last, n = [], 0, len(word)
    for i in range(n - SHORTEST + 1):
        j = i + SHORTEST
        while j < n and j - i < longest and word[i:j] in frequent:
            j += 1
        if j > last:
            out.append((i, j))
            last = j
    return out


def affected(grams: list[tuple[int, int]], size: int, longest: int, insertion: bool) -> int:
    """The most grams of a word of `size` characters, marks counted, that one edit can affect: a character replaced, or one inserted.

    A gram hangs on the `longest` characters up to its end: those that it reads, and those that an earlier gram reaching
    as far would begin in.
    """
    change = [0] * (size + 2)
    for _, end in grams:
        change[max(0, end - longest) + insertion] += 1  # inserting before the first of them leaves all in place
        change[end] -= 1
    most = now = 0
    for x in change:
        now += x
        most = max(most, now)
    return most


def _longest(size: int) -> int:
    """The longest gram for words of `size` > 1 characters and for pairs of these and longer ones: no edit affects a word's first and last gram, so one is left."""
    return max(SHORTEST, min(LONGEST, (size + 2) // 2))


def _key(kind: int, size: int, place: int, gram: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {size} {place} {gram}") - (1 << 63)


def listed(word: str, frequent: frozenset[str]) -> Iterator[tuple[int, list[int], int]]:
    """(role, keys, how many of them are needed) of a word as one of equally long words (0), the shorter (1) or longer (2) of two.

    Equal words share their grams' places; after an inserted character, grams stand where they stood or one further, and the
    longer word is listed under both.
    """
    size, marked = len(word), BEGIN + word + END
    longest = _longest(size)
    grams = decompose(marked, longest, frequent)
    if size > 1:
        yield 0, [_key(0, size, i, marked[i:j]) for i, j in grams], affected(grams, size + 2, longest, False) + 1
    else:  # nothing is left of a single character, and there are not many of those
        yield 0, [_key(0, 1, 0, "")], 1
    yield 1, [_key(1, size, i, marked[i:j]) for i, j in grams], affected(grams, size + 2, longest, True) + 1
    if size > 1:
        if _longest(size - 1) != longest:
            grams = decompose(marked, _longest(size - 1), frequent)
        both = {_key(1, size - 1, place, marked[i:j]) for i, j in grams for place in (i - 1, i)}
        yield 2, list(both), len(both)


def list_lengths(words: DataFrame, frequent: frozenset[str]) -> np.ndarray:
    """How many words are listed, by key modulo PLACES: a table of fixed size."""
    held = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        n = np.zeros(PLACES, np.int64)
        for batch in batches:
            keys = [k for word in batch.column(0).to_pylist() for role, keys, _ in listed(word, held.value) if role != 1 for k in keys]
            n += np.bincount(np.mod(np.array(keys, np.int64), PLACES), minlength=PLACES)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["place", "n"])

    out = np.zeros(PLACES, np.int64)
    for place, n in words.select("word").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n")).collect():
        out[place] = n
    return out


def near_words(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b for every two different words exactly one edit apart, both ways. words has word, distinct, and n.

    Words of any length are compared; a null or empty word is near to none. An empty table gives no rows. Lists hold
    the words themselves, but for those of CARRIED code points and more a number, so that a word is never written as
    often as it has grams.
    """
    words = words.where("word <> ''").select("word", "n", F.xxhash64("word").alias("id"))
    frequent = frequent_grams(words)
    held = words.sparkSession.sparkContext.broadcast((frequent, list_lengths(words, frequent)))
    types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())

    def run(batches):
        frequent, lengths = held.value
        lengths = lengths.tolist()
        for batch in batches:
            rows: list[list] = [[] for _ in types]
            for word, n, id_ in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "id")), strict=True):
                for role, keys, needed in listed(word, frequent):
                    if needed < len(keys):
                        keys = sorted(keys, key=lambda k: (lengths[k % PLACES], k))[:needed]
                    whole = len(word) - (role == 2) < CARRIED
                    for column, value in zip(rows, (None, role, word if whole else None, n, None if whole else id_), strict=True):
                        column += keys if column is rows[0] else [value] * len(keys)
            for low in range(0, len(rows[0]), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(c[low : low + 65536], t) for c, t in zip(rows, types, strict=True)], ["key", "role", "word", "n", "id"])

    lists = written(words.mapInArrow(run, "key long, role int, word string, n long, id long"), "gram-lists")
    left, right = (lists.where(f"role <> {r}").select("key", "role", *(F.col(c).alias(f"{c}_{x}") for c in ("word", "n", "id"))) for r, x in ((2, "a"), (1, "b")))
    # the lists of a key are merged pair by pair inside the join; only near pairs leave it
    both = (left.key == right.key) & ((left.role == 1) | (F.col("word_a") < F.col("word_b"))) & (F.levenshtein("word_a", "word_b", 1) == 1)
    short = left.where("id_a is null").join(right.where("id_b is null"), both)
    long = left.where("id_a is not null").join(right.where("id_b is not null"), (left.key == right.key) & ((left.role == 1) | (F.col("id_a") <= F.col("id_b"))))
    long = long.select("id_a", "id_b").distinct()
    for x in "ab":
        long = long.join(words.where(F.length("word") >= CARRIED).select(*(F.col(c).alias(f"{c}_{x}") for c in ("word", "n", "id"))), f"id_{x}")
    long = long.where(F.levenshtein("word_a", "word_b", 1) == 1)
    sides = [F.struct(F.col(f"word_{x}").alias("w"), F.col(f"n_{x}").alias("n")) for x in "ab"]
    long = long.select(F.least(*sides).alias("a"), F.greatest(*sides).alias("b")).select("a.w", "a.n", "b.w", "b.n")  # one way, even if numbers agree
    names = ["a", "n_a", "b", "n_b"]
    met = short.select("word_a", "n_a", "word_b", "n_b").union(long).toDF(*names)
    pairs = written(met.distinct(), "near-words")  # one way, so that the lists are merged once
    return pairs.union(pairs.select("b", "n_b", "a", "n_a")).toDF(*names)


def follow(forms: DataFrame) -> DataFrame:
    """word and root: where the forms of word, form lead in the end. A form is at least twice as frequent as its word, so the
    way has at most as many steps as the logarithm of a count, and each round doubles the steps taken."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        roots = written(roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("went")), "roots")
        if not roots.where("went").limit(1).count():
            return roots.select("word", "root")


def spelling_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of words(word, n), word distinct.

    n_near counts the words exactly one edit away; form is the most frequent of them (ties: the first by code points) if it
    occurs at least factor times as often, else null; root is the end of the forms from there, the word itself without one.
    """
    near = near_words(words)
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("form"), (-F.col("best.less")).alias("form_n"))
    found = words.join(best, "word", "left").withColumn("follows", F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False)))
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("follows"), F.col("form")).alias("form"), F.when(F.col("follows"), F.col("form_n")).alias("form_n")), "forms")
    return found.join(follow(found.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_groups(docs: DataFrame, shortest: int = 5, least: int = 3, drop_one_in: int = 97) -> DataFrame:
    """spelling_variants of the words of at least `shortest` code points that occur at least `least` times in the texts of docs.

    docs has doc_id and text; other columns are ignored, nulls and repeated rows are as in count_words, and an empty
    table gives no rows.
    """
    counted = count_words(docs, drop_one_in)
    return spelling_variants(written(counted.where((F.length("word") >= shortest) & (F.col("n") >= least)), "words"))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variant_groups(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
