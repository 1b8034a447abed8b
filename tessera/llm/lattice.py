"""Document likelihood under a subword unigram model: all segmentations of each word, by a log-space forward recursion.

Words are lower-cased runs without white space, written as the public vocabulary writes them (a word mark, then the
word); pieces never cross a word mark, so a text's marginal probability is the product of its words' and the end's.
A word's pieces lie on its UTF-8 bytes, and every byte is a piece, so every text has a segmentation. The vocabulary
file's scores give each piece its first weight; expected piece counts over the training texts give the weights used.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table, text_slices, written
from tessera.llm.encode import vocabulary
from tessera.llm.words import Keys, Scanner, mix

MARK = "▁".encode()
_BASE = 0x9E3779B97F4A7C15  # of fingerprints modulo 2^64, of pieces only: none is long enough for a pattern to cancel
LONG = 96
BLOCK = 1 << 14
CHUNK_BYTES = 16 << 20


class Lattice:
    """Pieces of a sentencepiece file. `prior`: natural log weights from the file's scores, which are ranks, by Zipf's law."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            if not model.is_byte(i) and MARK.decode() not in piece[1:] and not any("A" <= c <= "Z" for c in piece):
                ranks.setdefault(piece.encode(), min(-model.get_score(i), float(model.get_piece_size())))
        for byte in range(256):
            ranks.setdefault(bytes([byte]), float(model.get_piece_size()))
        self.pieces = sorted(ranks)
        weight = np.array([1 / (2 + ranks[p]) for p in self.pieces])
        self.prior = np.log(weight / weight.sum())
        self.id = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        self.value = mix(np.arange(256, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D))  # apart for A and a
        size = BLOCK + self.longest
        self.power = np.cumprod(np.array([1, *[_BASE] * size], np.uint64), dtype=np.uint64)
        self.inverse = np.cumprod(np.array([1, *[pow(_BASE, -1, 1 << 64)] * size], np.uint64), dtype=np.uint64)
        prints = np.array([(self.value[np.frombuffer(p, np.uint8)] * self.power[: len(p)]).sum(dtype=np.uint64) for p in self.pieces], np.uint64)
        order = np.argsort(prints)
        self.keys, self.order = Keys(prints[order]), order

    def _edges(self, words: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(begin, end): which of the equally long words have a piece there, and its id."""
        n, m = words.shape
        total = np.zeros((n, m + 1), np.uint64)
        np.cumsum(self.value[words] * self.power[:m], axis=1, out=total[:, 1:])
        out = {}
        for j in range(1, m + 1):
            for i in range(max(0, j - self.longest), j):
                rows, which = self.keys.find((total[:, j] - total[:, i]) * self.inverse[i])
                if len(rows):
                    out[i, j] = rows, self.order[which]
        return out

    def likelihood(self, words: np.ndarray, weight: np.ndarray, times: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        """Natural log probabilities of equally long words; adds times x expected piece counts to `counts`, if given."""
        n, m = words.shape
        edges = self._edges(words)
        ahead = np.full((m + 1, n), -np.inf)
        ahead[0] = 0
        for (i, j), (rows, ids) in edges.items():
            ahead[j, rows] = np.logaddexp(ahead[j, rows], ahead[i, rows] + weight[ids])
        if counts is not None:
            back = np.full((m + 1, n), -np.inf)
            back[m] = 0
            for (i, j), (rows, ids) in sorted(edges.items(), key=lambda x: -x[0][1]):
                step = back[j, rows] + weight[ids]
                back[i, rows] = np.logaddexp(back[i, rows], step)
                counts += np.bincount(ids, np.exp(ahead[i, rows] + step - ahead[m, rows]) * times[rows], len(counts))
        return ahead[m]

    def marginals(self, words: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
        """Natural log probabilities of equally long words under several weightings of the pieces; the lattice is built once."""
        n, m = words.shape
        ahead = np.full((len(weights), m + 1, n), -np.inf)
        ahead[:, 0] = 0
        for (i, j), (rows, ids) in self._edges(words).items():
            for a, weight in zip(ahead, weights, strict=True):
                a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + weight[ids])
        return ahead[:, m]

    def _pieces(self, word: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """begin, end and id of the word's pieces that begin in low ... high - 1, by begin."""
        part = word[low : high + self.longest]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[part] * self.power[: len(part)], dtype=np.uint64)])
        begins, ends, ids = [], [], []
        for size in range(1, min(self.longest, len(part)) + 1):
            n = min(high - low, len(part) - size + 1)
            rows, which = self.keys.find((total[size : size + n] - total[:n]) * self.inverse[:n])
            begins.append(rows + low)
            ends.append(rows + low + size)
            ids.append(self.order[which])
        begin, end, found = (np.concatenate(x) for x in (begins, ends, ids))
        by = np.argsort(begin, kind="stable")
        return begin[by], end[by], found[by]

    def long_likelihoods(self, words: bytes, stops: np.ndarray, weight: np.ndarray, times: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        """The same for very long words, one after the other, that stop at `stops`.

        No piece crosses a word mark, so a word's log probability is what the log sums grow by over its places. They are
        carried from block to block: two numbers a place, and the pieces of one block at a time.
        """
        data, m = np.frombuffer(words, np.uint8), len(words)
        ahead = array("d", [-math.inf]) * (m + 1)
        ahead[0] = 0.0
        for low in range(0, m, BLOCK):
            begin, end, ids = self._pieces(data, low, min(m, low + BLOCK))
            for i, j, w in zip(begin.tolist(), end.tolist(), weight[ids].tolist(), strict=True):
                x, y = ahead[i] + w, ahead[j]
                ahead[j] = x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))
        before = np.frombuffer(ahead)
        if counts is not None:
            back = array("d", [-math.inf]) * (m + 1)
            back[m] = 0.0
            after = np.frombuffer(back)
            for low in reversed(range(0, m, BLOCK)):
                begin, end, ids = self._pieces(data, low, min(m, low + BLOCK))
                for i, j, w in zip(begin[::-1].tolist(), end[::-1].tolist(), weight[ids[::-1]].tolist(), strict=True):
                    x, y = back[j] + w, back[i]
                    back[i] = x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))
                expected = np.exp(before[begin] + weight[ids] + after[end] - ahead[m]) * times[np.searchsorted(stops, begin, "right")]
                counts += np.bincount(ids, expected, len(counts))
        return np.diff(before[stops], prepend=0.0)

    def long_likelihood(self, word: bytes, weight: np.ndarray) -> float:
        return float(self.long_likelihoods(word, np.array([len(word)]), weight)[0])


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


class Words:
    """The distinct words of a chunk of texts: fingerprints in order, bytes, and each text's words as places among them."""

    def __init__(self, batches: list[pa.RecordBatch], marks: str):
        scanner = Scanner("space")
        lower = np.arange(256, dtype=np.uint8)
        lower[0x41:0x5B] += 0x20
        prints, texts, spans, flags, sizes, base = [], [], [], [], [], 0
        for batch in batches:
            for low, high, data, offsets in text_slices(batch, "text"):
                starts, ends, found, first = scanner.scan(data, offsets)
                prints.append(found)
                spans.append((starts + base, ends - starts))
                sizes.append(np.diff(first))
                flags.append(batch.column(marks).to_numpy(zero_copy_only=False)[low:high])
                texts.append(lower[data])
                base += len(data)
        self.data = np.concatenate([*texts, np.zeros(0, np.uint8)])
        texts.clear()
        self.sizes = np.concatenate([*sizes, np.zeros(0, np.int64)])
        self.flags = np.concatenate([*flags, np.zeros(0, bool)]).astype(bool)
        every = np.concatenate([*prints, np.zeros(0, np.uint64)])
        prints.clear()
        self.prints, at, place = np.unique(every, return_index=True, return_inverse=True)
        del every
        self.place = place.astype(np.int32)
        del place
        self.start = np.concatenate([*(s for s, _ in spans), np.zeros(0, np.int64)])[at]
        self.length = np.concatenate([*(n for _, n in spans), np.zeros(0, np.int64)])[at]

    def counts(self) -> np.ndarray:
        """How often each word stands in the flagged texts."""
        return np.bincount(self.place[np.repeat(self.flags, self.sizes)], minlength=len(self.prints))

    def groups(self, of: np.ndarray):
        """(places, byte matrix with the word mark) for words of equal length, of those places; very long words are left to `runs`."""
        of = of[self.length[of] + len(MARK) <= LONG]
        of = of[np.argsort(self.length[of], kind="stable")]
        cuts = np.flatnonzero(np.diff(self.length[of], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            n = int(self.length[of[a]])
            step = max(1, (1 << 19) // n)
            for low in range(a, b, step):
                part = of[low : min(b, low + step)]
                words = self.data[self.start[part][:, None] + np.arange(n)]
                yield part, np.hstack([np.tile(np.frombuffer(MARK, np.uint8), (len(part), 1)), words])

    def runs(self, of: np.ndarray):
        """(places, bytes with the word marks, where each word stops) for the very long words of those places, about a block at a time."""
        of = of[self.length[of] + len(MARK) > LONG]
        block = np.cumsum(self.length[of] + len(MARK)) // BLOCK
        for part in np.split(of, np.flatnonzero(np.diff(block)) + 1) if len(of) else ():
            words = [MARK + self.data[a : a + n].tobytes() for a, n in zip(self.start[part].tolist(), self.length[part].tolist(), strict=True)]
            yield part, b"".join(words), np.cumsum([len(w) for w in words])


def likelihoods(model: Lattice, weights: list[np.ndarray], words: Words) -> np.ndarray:
    """Natural log probabilities of the words, a row a weighting."""
    out, of = np.zeros((len(weights), len(words.prints))), np.arange(len(words.prints))
    for part, matrix in words.groups(of):
        out[:, part] = model.marginals(matrix, weights)
    for part, run, stops in words.runs(of):
        for row, weight in zip(out, weights, strict=True):
            row[part] = model.long_likelihoods(run, stops, weight)
    return out


def _text_batches(rows: pa.Table) -> list[pa.RecordBatch]:
    return rows.to_batches()


def lattice_scores(docs: DataFrame, path: str, held_out, learned: float = 0.5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and vocabulary_score of every text.

    vocabulary_score weights all segmentations by the file's own scores. score weights them by those and, `learned` of
    each weight, by the shares that one expectation pass from them finds in the texts not held out. An end has the share
    of ends among all that pass counts, and pieces share the rest. Texts are dealt into chunks by
    the hash of id and text, so a source, or copies under many ids, spread evenly; a null doc_id is not held out and
    stays null; rows equal in id and text share a chunk and a result. A chunk gives its distinct words with their
    training counts and the expected counts of pieces; each word's counts are summed over chunks, where it has a row a
    chunk at most, and go back to the chunks that hold it. Only the piece weights (as many as the vocabulary has) reach the
    driver. Null and empty texts are an end alone; without training texts every count is 0; other columns are ignored; an
    empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = 1 + size // CHUNK_BYTES
    dealt = base.withColumn("learn", ~F.coalesce(held_out, F.lit(False))).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))

    def gather(rows: pa.Table) -> pa.Table:
        chunk = rows.column("chunk")[0].as_py()
        words = Words(_text_batches(rows.select(["text", "learn"])), "learn")
        n = words.counts()
        model = lattice(path)
        counts = np.zeros(len(model.pieces))
        for part, matrix in words.groups(np.flatnonzero(n)):
            model.likelihood(matrix, model.prior, n[part].astype(float), counts)
        for part, run, stops in words.runs(np.flatnonzero(n)):
            model.long_likelihoods(run, stops, model.prior, n[part].astype(float), counts)
        some = np.flatnonzero(counts)
        ends = int(words.flags.sum())
        key = np.concatenate([words.prints.view(np.int64), some, [0]])
        return pa.table({
            "chunk": pa.array(np.full(len(key), chunk), pa.int32()),
            "kind": pa.array(np.repeat([0, 1, 2], [len(n), len(some), 1]), pa.int32()),
            "key": pa.array(key, pa.int64()),
            "n": pa.array(np.concatenate([n, counts[some], [ends]]).astype(float), pa.float64()),
        })

    seen = written(dealt.groupBy("chunk").applyInArrow(gather, "chunk int, kind int, key long, n double"), "words-and-pieces")
    words = seen.where("kind = 0")
    total = words.groupBy("key").agg(F.sum("n").alias("c")).where("c > 0").agg(F.count("*"), F.sum("c")).first()
    ends = int(seen.where("kind = 2").agg(F.sum("n")).first()[0] or 0)
    distinct, tokens = total[0] + (ends > 0), int(total[1] or 0) + ends
    pieces = {r[0]: r[1] for r in seen.where("kind = 1").groupBy("key").agg(F.sum("n")).collect()}  # at most the vocabulary
    found = lattice(path)
    count = np.array([pieces.get(i, 0.0) for i in range(len(found.pieces))]) + 0.1
    whole = count.sum() + ends + 0.1
    end = (ends + 0.1) / whole
    file = np.exp(found.prior) * (1 - end)
    weights = [np.log(learned * count / whole + (1 - learned) * file), np.log(file)]
    held = docs.sparkSession.sparkContext.broadcast((weights, math.log(end), ends, distinct, tokens))
    back = words.select("chunk", "key").join(words.groupBy("key").agg(F.sum("n").alias("c")).where("c > 0"), "key")

    def score(rows: pa.Table, counts: pa.Table) -> pa.Table:
        weights, end, ends, distinct, tokens = held.value
        words = Words(_text_batches(rows.select(["text", "learn"])), "learn")
        key = counts.column("key").to_numpy().view(np.uint64)
        c = np.zeros(len(words.prints))
        c[np.searchsorted(words.prints, key)] = counts.column("c").to_numpy()
        # word for word, and the end at the end
        doc = np.repeat(np.arange(len(words.sizes)), words.sizes)
        under = tokens + distinct + 1
        each = np.log10((c + 1) / under)
        model = lattice(path)
        marginal, plain = likelihoods(model, weights, words) / math.log(10)
        add = lambda x: np.bincount(doc, x[words.place], len(words.sizes)) if len(doc) else np.zeros(len(words.sizes))
        n = len(words.sizes)
        return pa.table({
            "doc_id": rows.column("doc_id"), "held_out": pa.array(~words.flags, pa.bool_()),
            "n_tokens": pa.array(words.sizes + 1, pa.int64()), "n_known": pa.array(add((c > 0).astype(float)).astype(np.int64) + (ends > 0), pa.int64()),
            "train_tokens": pa.array(np.full(n, tokens), pa.int64()),
            "base_score": pa.array(add(each) + math.log10((ends + 1) / under), pa.float64()), "score": pa.array(add(marginal) + end / math.log(10), pa.float64()),
            "vocabulary_score": pa.array(add(plain) + end / math.log(10), pa.float64()),
        })

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, vocabulary_score double"
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, out)


def op7_lattice_likelihood(spark, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
