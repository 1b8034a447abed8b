"""Whole texts to token ids with a public tokenizer; every distinct chunk between white space is encoded once."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: The characters that Unicode calls white space.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The letters of ASCII and Latin-1, and the marks of ASCII.
LETTERS = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff"
MARKS = "!-/:-@\\[-`{-~"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The text of a tokenizer file that the driver has, for all executors; a vocabulary, so some MB whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in shown else next(rest) for b in range(256)]


class Seen(dict):
    """Values by key; learn gives a missing one."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        self[key] = found = self.learn(key)
        return found


class Encoder:
    """ids(texts): for each text its ids as little-endian uint32 bytes, equal to the library's encode(text, add_special_tokens=False).

    A special token's string in a text is its id, as the library has it, or with `ordinary` text like any other, so that
    no text's ids hold a special one. Null is empty.

    Neither tokenizer's pre-tokens cross the chunks used here: byte-level BPE takes at most the last of a run of
    white space to the word after it, BPE with word ends drops white space, and both end a run of letters or digits
    at a following mark. So a text's ids are those of its chunks in order, and those of chunks seen before come from
    a dictionary of at most 2 * keep entries and one text's, some 250 bytes each. A chunk of Latin letters is one
    pre-token, so the library's model takes it as it is, in the characters that stand for its bytes; any other goes to
    the library whole.
    """

    def __init__(self, vocabulary: str, ordinary: bool = False, keep: int = 300_000):
        """vocabulary: the text of a tokenizer file."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True  # texts are split at special strings before
        special = {} if ordinary else {t.content: np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = special
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        spaced = bool(self.tokenizer.encode(" ", add_special_tokens=False).ids)
        plain = f" ?[{LETTERS}]++(?=[ \\n{MARKS}]|\\Z)"  # most chunks, found without a step back
        word = f"{plain}| ?[^{WHITE}{MARKS}]*[A-Za-z0-9](?=[{MARKS}])| ?[^{WHITE}]+"
        self.chunks = re.compile(f"{word}|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+" if spaced else word.replace(" ?", "")).findall
        self.keep, self.young, self.old = keep, Seen(self._learn), {}
        self.spaced, self.model, self.characters, self.word = spaced, self.tokenizer.model, "".join(byte_characters()), re.compile(f" ?[{LETTERS}]+").fullmatch
        letters = [c for c in map(chr, range(256)) if self.word(c)]
        probe = [x + y for x in ("", " " * spaced) for y in (*letters, "".join(letters), *(f"{c}xX{c}" for c in letters))]
        if any(self._word_ids(x) != self.tokenizer.encode(x, add_special_tokens=False).ids for x in probe):
            self.word = lambda _: None  # the file has other rules for letters

    def _word_ids(self, word: str) -> list[int]:
        if not self.spaced:
            word = word.lower()
        word = word.replace(" ", self.characters[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.characters)
        return [t.id for t in self.model.tokenize(word)]

    def _learn(self, chunk: str) -> bytes:
        if (found := self.old.get(chunk)) is not None:
            return found
        ids = self._word_ids(chunk) if self.word(chunk) else self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        texts = [x or "" for x in texts]
        split = {i: self.apart.split(x) for i, x in enumerate(texts) if any(t in x for t in self.special)}
        if not split:
            return self._plain(texts)
        pieces = [p for i, x in enumerate(texts) for p in split.get(i, [x])[::2]]
        found, out = iter(self._plain(pieces)), []
        for i, x in enumerate(texts):
            out.append(b"".join(next(found) if k % 2 == 0 else self.special[p] for k, p in enumerate(split.get(i, [x]))))
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            out.append(b"".join(map(self.young.__getitem__, self.chunks(text))))
            if len(self.young) > self.keep:
                self.old, self.young = self.young, Seen(self._learn)
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(held: Broadcast, ordinary: bool = False) -> Encoder:
    """One for each Python worker, which Spark keeps between tasks."""
    key = held.value, ordinary
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
