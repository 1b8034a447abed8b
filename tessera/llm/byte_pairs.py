"""Byte-level BPE of whole texts from a rank file: ids and offsets by the tokenizers library, and the way back to bytes.

A rank file lists tokens as bytes, each with its rank, and a text is split by a pattern before its bytes are merged. For
the library every byte becomes a printable character, and every way to put a token together from two others a merge.
Decoding turns the characters back into bytes; a character that tokens share appears once its last byte has come.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table, text_slices
from tessera.llm.encode import byte_characters, encoder, vocabulary


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and a number a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _splits(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where the token falls into two others. When two merges into it overlap (x, y and y, z of x y z), the left one comes first."""
    n = len(token)
    at = [i for i in range(1, n) if token[:i] in ranks and token[i:] in ranks]
    # x y is split at len(x), y z at len(y) = n - len(x), and y is an end of the token as well as a beginning
    left = [i for i in at if n - i in at and n - i != i and token.startswith(token[i:])]
    return sorted(at, key=lambda i: (i not in left, i))


def tokenizer_text(path: str, pattern: str) -> str:
    """The library's tokenizer file for a rank file and the pattern that splits texts; ids are ranks."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, shown = read_ranks(path), byte_characters()
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} lacks the bytes {missing[:5]}")
    word = {token: "".join(map(shown.__getitem__, token)) for token in ranks}
    merges = [(word[t[:i]], word[t[i:]]) for t in sorted(ranks, key=ranks.__getitem__) for i in _splits(t, ranks)]
    out = Tokenizer(models.BPE(vocab={word[t]: rank for t, rank in ranks.items()}, merges=merges))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out.to_str()


def ship_ranks(spark: SparkSession, path: str, pattern: str | None = None) -> Broadcast:
    """The tokenizer of a rank file for all executors: some MB, whatever the corpus. The pattern is by default the public one."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return spark.sparkContext.broadcast(tokenizer_text(path, pattern))


class ByteTable:
    """Token bytes by id, from the characters of a tokenizer's vocabulary."""

    def __init__(self, words: dict[str, int]):
        byte = {c: b for b, c in enumerate(byte_characters())}
        self.tokens = [b""] * (max(words.values(), default=-1) + 1)
        for word, i in words.items():
            self.tokens[i] = bytes(map(byte.__getitem__, word))
        self.length = np.array([len(t) for t in self.tokens], np.int64)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def stream(self, ids: Iterable[int], errors: str = "replace") -> Iterator[str]:
        """The text that each token completes: nothing for a token that ends inside a character, what was held back with the one that ends it.

        A token more than the ids may come last: what is left of an unfinished character, by `errors`.
        """
        held = codecs.getincrementaldecoder("utf-8")(errors)
        for i in ids:
            yield held.decode(self.tokens[i])
        if rest := held.decode(b"", final=True):
            yield rest

    def offsets(self, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one code point of every token; tokens that share a character all cover it."""
        ends = np.cumsum(self.length[ids])
        # code points that begin before each byte
        begun = np.concatenate([[0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)])
        starts = ends - self.length[ids]
        return np.maximum(begun[np.minimum(starts + 1, len(text))] - 1, 0), begun[ends]


_tables: dict[str, ByteTable] = {}


def byte_table(held: Broadcast) -> ByteTable:
    """One for each Python worker."""
    if held.value not in _tables:
        _tables[held.value] = ByteTable(encoder(held).tokenizer.get_vocab(with_added_tokens=False))
    return _tables[held.value]


def encode_texts(docs: DataFrame, held: Broadcast, offsets: bool = False) -> DataFrame:
    """doc_id and ids of every text; with `offsets` also starts and ends, each token's code points in the text.

    A null or empty text has no ids; a null doc_id stays null; repeated rows each have a result, in any order; other
    columns are ignored; an empty table gives no rows. A task works on about a megabyte of text at a time, or on one
    longer text.
    """
    names = ["doc_id", "ids", *(["starts", "ends"] if offsets else [])]

    def run(batches):
        code, table_ = encoder(held), byte_table(held)
        for batch in batches:
            for low, high, data, begin in text_slices(batch, "text"):
                found = [np.frombuffer(x, "<u4") for x in code.ids(batch.column("text")[low:high].to_pylist())]
                cuts = np.cumsum([0, *map(len, found)])
                columns = [np.concatenate([*found, np.zeros(0, "<u4")])]
                if offsets:
                    pairs = [table_.offsets(x, data[a:b].tobytes()) for x, a, b in zip(found, begin[:-1], begin[1:], strict=True)]
                    columns += [np.concatenate([*(p[k] for p in pairs), np.zeros(0, np.int64)]) for k in (0, 1)]
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x.astype(np.int32))) for x in columns]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], *lists], names)

    schema = ", ".join(["doc_id long", *(f"{n} array<int>" for n in names[1:])])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, held: Broadcast, text: bool = False) -> DataFrame:
    """The columns of rows and decoded: the bytes of its ids, or with `text` the text, U+FFFD where they are no UTF-8.

    Null or no ids are no bytes; a null id, or one that the vocabulary lacks, is an error; repeated rows each have a
    result; a column `decoded` is replaced; an empty table gives no rows.
    """
    rows = rows.drop("decoded")
    schema = T.StructType([*rows.schema, T.StructField("decoded", T.StringType() if text else T.BinaryType())])

    def run(batches):
        words = byte_table(held)
        for batch in batches:
            made = (words.decode(ids) if ids else b"" for ids in batch.column("ids").to_pylist())
            made = [x.decode(errors="replace") if text else x for x in made]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string() if text else pa.binary())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)


def digests(rows: DataFrame, held: Broadcast) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids, in decimals joined by commas, and of the bytes that they decode to.

    The same as encode_texts, decode_ids and sha2 over both columns, without decoded texts on their way to the JVM.
    """

    def run(batches):
        words = byte_table(held)
        number = [str(i) for i in range(len(words.tokens))]
        for batch in batches:
            n, listed, bytes_ = [], [], []
            for scalar in batch.column("ids"):
                ids = scalar.values.to_numpy().tolist() if scalar.is_valid else []
                n.append(len(ids))
                listed.append(hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest())
                bytes_.append(hashlib.sha256(words.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(bytes_, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_byte_pairs(spark, sf_dir: str) -> DataFrame:
    held = ship_ranks(spark, vocabulary("byte_bpe_multi_50k.tiktoken"))
    return digests(encode_texts(table(spark, sf_dir, "documents"), held), held)
