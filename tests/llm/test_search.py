"""Ranked search against scores of every document, and how the threshold stops."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import search
from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k):
    words = [(i, Counter(WORD.findall((t or "").translate(LOWER)))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n, total, df = len(words), sum(sum(c.values()) for _, c in words), Counter(t for _, c in words for t in c)
    out = []
    for item, text in items:
        want, scores = Counter(WORD.findall((text or "").translate(LOWER))), []
        for i, c in words:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in want.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def rows_of(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "x" * 300, "1", "東京"]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(65)], k=rng.randint(1, 60)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, " .,\n"), (503, "w1 " * 40000), (None, "w59 w58 w57"), (None, "w1 w2"), (504, "W59 w58, w57!"), (505, "w59 w58 w57"), (505, "w59 w58 w57"), (-3, "w59 w58 w57"), (600, "only once")]
    return docs, spark.createDataFrame([(i, t, 0, "clash") for i, t in docs], "doc_id long, text string, item_id int, rank string").repartition(5)


ITEMS = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (2, "w59 W59 w58"), (3, None), (4, ""), (5, "nowhere at all"), (6, "x" * 300 + " É"), (None, "w7 w7 w7"), (2, "w59 W59 w58"), (7, "w0"), (8, " ".join(f"w{i}" for i in range(60)) * 3)]


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_ranks_equal_the_scores_of_all_documents(spark, odd, k):
    docs, frame = odd
    items = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id int, text string, score string")
    assert rows_of(search.ranked_search(frame, items, k)) == brute(docs, ITEMS, k)
    if k == 10:
        assert rows_of(search.ranked_search(frame, items, k, most_items=3)) == brute(docs, ITEMS, k)
        assert search.ranked_search(frame.limit(0), items).count() == search.ranked_search(frame, items.limit(0)).count() == 0


def test_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    wanted = duck.execute(f"select item_id, rank, doc_id, score from ({ORACLE_SQL['op12_ranked_search']})").fetchall()
    assert rows_of(QUERIES["op12_ranked_search"](spark, SF)) == sorted(map(tuple, wanted), key=repr) != []


def chunk(impacts):
    """Lists from {row: {term: impact}}."""
    term = np.array([t for row in impacts for t in row], np.int64)
    first = np.cumsum([0, *map(len, impacts)])
    return search.ImpactLists(np.arange(len(impacts)), np.ones(len(impacts), bool), first, term, np.array([x for row in impacts for x in row.values()], np.int64), 4)


def test_searches_of_random_lists_stop_early_and_lose_nothing():
    rng = random.Random(4)
    read = 0
    for _ in range(200):
        impacts = [{t: rng.choice([1, 2, 3, 50, 1000]) for t in range(4) if rng.random() < 0.6} for _ in range(300)]
        lists, best = chunk(impacts), search.Best(3)
        weight = np.array([rng.randint(1, 5) for _ in range(4)])
        read += lists.search(np.arange(4), weight, best, step=1)
        scores = sorted((-sum(int(weight[t]) * x for t, x in row.items()), i) for i, row in enumerate(impacts) if row)
        assert list(zip((-best.score).tolist(), best.doc.tolist())) == scores[:3]
        assert not lists.scored.any() and not lists.weight.any()
    assert read < 200 * 300 * 0.6


def test_a_tie_with_the_bound_is_no_stop():
    # all scores equal: the lowest id wins, wherever its place in the list; one more than the bound stops at once
    lists, best = chunk([{0: 5} for _ in range(500)]), search.Best(1)
    assert lists.search(np.array([0]), np.array([1]), best, step=1) == 500 and best.doc.tolist() == [0]
    lists, best = chunk([{0: 6}] + [{0: 5} for _ in range(500)]), search.Best(1)
    assert lists.search(np.array([0]), np.array([1]), best, step=1) <= 3 and best.doc.tolist() == [0]
    # a row read in one list is marked in the other: its best position passes places never read there
    rows = [{0: 100 - i, 1: 50 - i} for i in range(40)] + [{1: 5 - i % 5} for i in range(300)]
    lists, best = chunk(rows), search.Best(2)
    assert lists.search(np.array([0, 1]), np.array([1, 1]), best, step=1) < 12 and best.doc.tolist() == [0, 1]


def test_another_word_with_a_terms_fingerprint_is_told_apart():
    terms = search.Terms([b"alpha", b"beta", b"gamma"])
    data = np.frombuffer(b"ALPHA beta gamma delta", np.uint8)
    starts, ends, prints, _ = search.Scanner("alnum").scan(data, np.array([0, len(data)]))
    assert terms.find(data, starts, ends, prints)[1].tolist() == [0, 1, 2]
    prints[3] = prints[0]  # delta as if it were alpha; beta as if it were gamma
    prints[1] = prints[2]
    at, term = terms.find(data, starts, ends, prints)
    assert at.tolist() == [0, 1, 2] and term.tolist() == [0, 1, 2]
