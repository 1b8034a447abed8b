"""Spelling variants against distances of all words, and the bounds of the gram index by trial."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import spelling
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(docs, one_in=97):
    n = Counter()
    for i, text in docs:
        for w in RUN.findall((text or "").translate(LOWER)):
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n.pop("", None)
    return n


def brute_rows(n):
    """word: (n, n_near, form, form_n, root), near words by what is left after one deletion or replacement."""
    by = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by[w[:i] + "*" + w[i + 1 :]].add(w)
            if (less := w[:i] + w[i + 1 :]) in n:
                by[less, w] = {less, w}
    near = defaultdict(set)
    for group in by.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n}


def rows_of(found):
    rows = found.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted = brute_rows({w: n for w, n in brute_counts(docs).items() if len(w) >= 5 and n >= 3})
    assert rows_of(QUERIES["op13_spelling_variants"](spark, SF)) == wanted and any(x[2] for x in wanted.values())


def test_odd_rows_count_and_group(spark):
    docs = [(1, "Straße STRASSE straße ÀÉÿ àéÿ ×÷ ab1cd x-y"), (2, None), (3, ""), (None, "Quiet quiet QUIET quiets"), (4, "é" * 30000 + " " + "x" * 20000), (4, "é" * 30000), (4, "é" * 30000)]
    docs += [(5, "same words twice"), (5, "same words twice"), (6, "aāa€aÃa ĀÀÃ")] + [(i, "a bb ccc dddd eeeee fffff eeeee") for i in range(7, 300)]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    assert {r.word: r.n for r in spelling.count_words(frame).collect()} == brute_counts(docs)
    assert {r.word: r.n for r in spelling.count_words(frame, 2).collect()} == brute_counts(docs, 2)
    wanted = {w: n for w, n in brute_counts(docs, 5).items() if len(w) >= 1 and n >= 1}
    assert rows_of(spelling.variant_groups(frame, 1, 1, 5)) == brute_rows(wanted)
    assert spelling.variant_groups(frame.limit(0)).count() == 0 and spelling.variant_groups(frame.where("doc_id = 2")).count() == 0


@pytest.mark.parametrize("least", [1, 3, 100])
def test_dense_words_with_chains_ties_and_frequent_grams(spark, monkeypatch, least):
    rng = random.Random(least)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(600)} | {"haha" * k for k in range(1, 9)} | {"z" * k for k in range(1, 40)}
    words |= {x[:i] + rng.choice("abcé") + x[i + rng.randint(0, 1) :] for x in ("internationalisation", "unbelievableness", "strengths") for i in range(len(x)) for _ in range(5)}
    n = {w: rng.choice([3, 3, 6, 12, 24, 50, 400]) for w in words}
    frame = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    frequent = spelling.frequent_grams
    monkeypatch.setattr(spelling, "frequent_grams", lambda words: frequent(words, 10**9, least))
    assert rows_of(spelling.spelling_variants(frame)) == brute_rows(n)


def test_pairs_are_found_and_written_one_way(spark, monkeypatch):
    """Short words and words of about CARRIED code points and more: the lists are merged once, both directions come from that."""
    rng, made = random.Random(8), spelling.written
    words = {"abcde", "abcdf", "abcd", *(long := ["".join(rng.choices("abc", k=k)) for k in (62, 63, 64, 65, 90) for _ in range(8)])}
    words |= {w[:k] + c + w[k + 1 :] for w in long for k, c in ((0, "d"), (30, ""), (40, "de"))}
    sizes = {}
    monkeypatch.setattr(spelling, "written", lambda df, name: sizes.setdefault(name, made(df, name)))
    found = sorted(tuple(r) for r in spelling.near_words(spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")).collect())
    near = lambda a, b: a != b and (lambda p, q: any(p[i + 1 :] == q[i + (len(p) == len(q)) :] and p[:i] == q[:i] for i in range(len(p))))(*sorted((a, b), key=len, reverse=True))
    assert found == sorted((a, len(a), b, len(b)) for a in words for b in words if abs(len(a) - len(b)) < 2 and near(a, b))
    assert 2 * sizes["near-words"].count() == len(found) > 80


def test_every_edit_leaves_a_shared_gram_under_any_dictionary():
    rng = random.Random(1)
    for _ in range(6000):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 16)))
        i = rng.randrange(len(word))
        other = word[:i] + rng.choice(letters) + word[i + rng.randint(0, 1) :]
        if other == word:
            continue
        frequent = {g for w in (word, other) for m in [spelling.BEGIN + w + spelling.END] for q in range(2, 6) for p in range(len(m)) if rng.random() < 0.6 for g in [m[p : p + q]]}
        frequent = frozenset(g for g in frequent if all(g[:k] in frequent for k in range(2, len(g))))
        lists = [{role: (set(keys), keys, needed) for role, keys, needed in spelling.listed(w, frequent)} for w in (word, other)]
        if len(word) == len(other):
            a, b = lists[0][0], lists[1][0]
            assert len(a[0] & b[0]) >= max(len(a[0]) - a[2] + 1, len(b[0]) - b[2] + 1, 1)
            order = lambda keys: sorted(keys, key=lambda k: (k % 7, k))
            assert set(order(a[0])[: a[2]]) & set(order(b[0])[: b[2]])
        else:
            a, b = lists[0][1], lists[1][2]
            assert len(a[0] & b[0]) >= max(1, len(a[0]) - a[2] + 1)


def test_crc_of_spans():
    data = np.frombuffer("alpha béta ".encode() + b"x" * 500, np.uint8)
    starts, ends = np.array([0, 6, 12, 0]), np.array([5, 11, 512, 0])
    begin = np.array([zlib.crc32(f"{i}:".encode()) for i in range(4)], np.uint32)
    assert spelling.crc32_of(data, starts, ends, begin).tolist() == [zlib.crc32(f"{i}:".encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(starts, ends))]
