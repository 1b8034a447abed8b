"""Byte-level BPE against the library that reads rank files itself, and the way back to bytes."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import byte_pairs
from tessera.llm.encode import vocabulary
from tessera.llm.queries import QUERIES

PATH = vocabulary("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"
ODD = ["", None, "one", "東京🎉 naïve x", " \n\t \r\n", "é" * 300, "x" * 20000, "<|endoftext|> it's 'twas\x1c\x85 ß 　.", "a b c", "a b c", "...!!! 123,456;7:8|9"]


@pytest.fixture(scope="module")
def wanted():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(PATH), special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(byte_pairs.tokenizer_text(PATH, public_tokenizers.PATTERN))


@pytest.fixture(scope="module")
def held(spark):
    return byte_pairs.ship_ranks(spark, PATH)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "no id", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, decoded string")


def same(library, wanted, texts):
    return [x for x in texts if library.encode(x, add_special_tokens=False).ids != wanted(x)]


def test_every_character_falls_where_the_other_library_has_it(library, wanted):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert not same(library, wanted, ["".join(f"a{c}a 1{c}1 .{c}.\n{c}{c} {c}" for c in every[i : i + 64]) for i in range(0, len(every), 64)])


def test_overlapping_merges_into_one_token(library, wanted):
    ranks = byte_pairs.read_ranks(PATH)
    # tokens x y = y z: in x y z either could be taken
    meet = [(t[:i], t[i:], t[len(t) - i :]) for t in ranks for i in byte_pairs._splits(t, ranks) if t.startswith(t[i:]) and t[len(t) - i :] in ranks]
    texts = [b"".join([x, y, z] * k + [e]).decode(errors="ignore") for x, y, z in meet for k in (1, 2, 3) for e in (b"", y, x)]
    assert len(texts) > 1000 and not same(library, wanted, texts)
    runs = [u * n for u in ("a", "=", ".", "ab", "ha", "ana", "0", " ", "\n", "ре", "é", "!?", "aab") for n in range(1, 70)]
    assert not same(library, wanted, runs)
    rng = random.Random(5)
    tokens = [t.decode() for t in ranks if 2 < len(t) < 9 and t.isascii()]
    mixed = ["".join(rng.choice(part) for _ in range(rng.randint(2, 30))) for part in (rng.sample(tokens, 3) for _ in range(20000))]
    assert not same(library, wanted, mixed)


def test_rows_equal_the_other_library(spark, wanted):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_byte_pairs"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        ids = wanted(text or "")
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_odd_rows_and_the_way_back(odd, held, wanted):
    rows = byte_pairs.encode_texts(odd, held, offsets=True)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in rows.collect()) == sorted([(i, wanted(t or "")) for i, t in enumerate(ODD)] + [(-1, wanted("no id"))])
    back = byte_pairs.decode_ids(rows, held, text=True).collect()
    assert {(r.doc_id, r.decoded) for r in back} == {(i, t or "") for i, t in enumerate(ODD)} | {(None, "no id")}
    for r in back:  # tokens cover the text; those of one character share its place
        assert all(a < b for a, b in zip(r.starts, r.ends)) and [0, *r.ends] >= r.starts and (not r.ids or r.ends[-1] == len(r.decoded))
        assert all(s in (e, e - 1) for s, e in zip(r.starts[1:], r.ends[:-1]))
    assert bytes(byte_pairs.decode_ids(rows.where("doc_id = 3"), held).first().decoded) == ODD[3].encode()
    assert byte_pairs.encode_texts(odd.limit(0), held).count() == byte_pairs.digests(rows.limit(0), held).count() == byte_pairs.decode_ids(rows.limit(0), held).count() == 0
    assert byte_pairs.decode_ids(odd.selectExpr("doc_id", "cast(null as array<int>) ids"), held, text=True).where("decoded <> ''").count() == 0


def test_streams_hold_back_split_characters(library):
    words = byte_pairs.ByteTable(library.get_vocab())
    text = "a🎉東京é " * 3
    ids = library.encode(text, add_special_tokens=False).ids
    parts = list(words.stream(ids))
    assert "".join(parts) == text and len(parts) == len(ids) and "" in parts and "�" not in "".join(parts)
    cut = list(words.stream([words.tokens.index(b"\xf0"), words.tokens.index(b"a")]))
    assert cut == ["", "�a"] and list(words.stream([words.tokens.index(b"\xf0")])) == ["", "�"]
