"""Vectorised word scanner over UTF-8 bytes: starts, ends and fingerprints of words, A-Z lower-cased."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Two primes below 2^31 and a base for each; a word's value under both is its fingerprint, so no pattern of letters cancels.
_PRIMES = ((2_147_483_647, 1_367_130_551), (2_147_483_629, 918_273_645))
_STEP = 1 << 20
_FILTER_BITS = 22


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply) over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _classes(kind: str) -> np.ndarray:
    """0 for bytes between words; bytes of one word have one class."""
    out = np.zeros(256, np.uint8)
    if kind == "space":  # [^\x20\x09-\x0D]+
        out[:] = 1
        out[[0x20, *range(0x09, 0x0E)]] = 0
    else:  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
        out[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = 1
    if kind == "letters":  # A-Z, a-z, and U+00C0 to U+00FF, all of which begin with C3; see Scanner.kinds
        out[:] = 0
        out[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = 1
    if kind == "mixed":  # runs of letters and digits, and runs of other visible characters
        out[[i for i in range(0x21, 0x7F) if not out[i]]] = 2
    return out


class _Powers:
    """Powers of a base and of its inverse modulo a prime, as many as were asked for."""

    def __init__(self, prime: int, base: int):
        self.prime, self.bases = prime, (base, pow(base, -1, prime))
        self.up = self.down = np.ones(1, np.uint32)

    def reach(self, n: int) -> None:
        size = len(self.up)
        if size >= n:
            return
        up, down = (np.ones(1 << (n - 1).bit_length(), np.uint32) for _ in range(2))
        for out, base in ((up, self.bases[0]), (down, self.bases[1])):
            done = 1
            while done < len(out):
                out[done : 2 * done] = out[:done].astype(np.uint64) * np.uint64(pow(base, done, self.prime)) % np.uint64(self.prime)
                done *= 2
        self.up, self.down = up, down


class Scanner:
    """Words of kind "space", "alnum", "mixed" or "letters". scan() takes concatenated texts and their offsets.

    A fingerprint holds the values of the word's bytes as a polynomial modulo two primes, mixed with its length: two
    different words of n bytes share one with a probability of about (n / 2^31)^2, whatever their pattern.
    """

    def __init__(self, kind: str):
        self.classes, self.pairs = _classes(kind), kind == "letters"
        byte = np.arange(1, 257, dtype=np.uint64)
        byte[0x41:0x5B] += np.uint64(0x20)
        self.value = byte
        self.powers = [_Powers(*x) for x in _PRIMES]

    def kinds(self, data: np.ndarray) -> np.ndarray:
        """The class of every byte."""
        out = self.classes[data]
        if self.pairs and len(data):
            out[1:] |= data[:-1] == 0xC3
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends, fingerprints of all words, and for each text the index of its first word (one more at the end)."""
        parts, at, kinds = [], 0, self.kinds(data)
        while at < len(data):
            to = min(at + _STEP, len(data))
            while to < len(data) and kinds[to] == kinds[to - 1] != 0:
                to += 1
            parts.append(self._block(data, kinds[at:to], offsets, at, to))
            at = to
        starts, ends, prints = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.uint64)))
        return starts, ends, prints, np.searchsorted(starts, offsets, "left")

    def _block(self, data, kind, offsets, at, to):
        block = data[at:to]
        first = np.ones(len(block), bool)
        first[1:] = kind[1:] != kind[:-1]
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        first[inner] = True
        edges = np.flatnonzero(first)
        ends = np.append(edges[1:], len(block))
        word = kind[edges] != 0
        starts, ends = edges[word], ends[word]
        value = self.value[block]
        whole = np.zeros(len(starts), np.uint64)
        for powers in self.powers:
            whole = (whole << np.uint64(31)) | self._sums(value, starts, ends, powers)
        prints = mix(whole + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        return starts + at, ends + at, prints

    @staticmethod
    def _sums(value: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
        powers.reach(len(value))
        prime = np.uint64(powers.prime)
        total = np.zeros(len(value) + 1, np.uint64)
        np.multiply(value, powers.up[: len(value)], out=total[1:])
        for low in range(0, len(value), _STEP):  # 2^8 x 2^31 x 2^20 stays below 2^63
            part = total[low + 1 : low + _STEP + 1]
            np.cumsum(part, out=part)
            if low:
                part += total[low] % prime
        return (total[ends] % prime + prime - total[starts] % prime) % prime * powers.down[starts] % prime


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether each span of data, A-Z lower-cased, is word `which` of those laid end to end in `words` from `begin`."""
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 0x20
    same = ends - starts == np.diff(begin)[which]
    rows, k = np.flatnonzero(same), 0
    while len(rows) and k < 64:
        rows = rows[starts[rows] + k < ends[rows]]
        differ = lower[data[starts[rows] + k]] != words[begin[which[rows]] + k]
        same[rows[differ]] = False
        rows, k = rows[~differ], k + 1
    for i in rows.tolist():  # few words are as long as that
        same[i] = np.array_equal(lower[data[starts[i] + 64 : ends[i]]], words[begin[which[i]] + 64 : begin[which[i] + 1]])
    return same


def shingles(prints: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of `width` words, and each text's first in them; a shorter text, but not an empty one, is one run."""
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], counts) + np.repeat(first[:-1], counts)
    long = np.repeat(n >= width, counts)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = long | (k < np.repeat(np.minimum(n, width), counts))
        take = np.where(inside, np.minimum(at + k, max(len(prints) - 1, 0)), 0)
        step = mix(out * np.uint64(0xE7037ED1A0B428DB) + prints[take] + np.uint64(k + 1)) if len(prints) else out
        out = np.where(inside, step, out)
    return out, begin


@dataclass
class Keys:
    """A sorted set of fingerprints with a bit filter before the binary search."""

    values: np.ndarray

    def __post_init__(self):
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self.values >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in prints that hold a value, and which."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[prints >> np.uint64(64 - _FILTER_BITS)])
        which = np.minimum(np.searchsorted(self.values, prints[at]), len(self.values) - 1)
        same = self.values[which] == prints[at]
        return at[same], which[same]
