"""Universe partition for a set similarity join: size bands, segments, their signatures, and what each segment costs.

Two sets that link differ in at most D elements, D from their sizes. Elements are hashed into segments. A segment given
one unit is compared whole, so one difference hides it; a segment given two is compared with its one-deletion
neighbourhood as well, so it takes two differences; a segment given none is not looked at. With D + 1 + k units in all,
the segments by which two linked sets meet hold k + 1 units at least. So each set may still leave out k units of its own
one-unit segments: the ones whose signatures most sets share (and, first of all, its empty ones). As all sets rank
signatures alike, the rarest common segment is among what both keep.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import text_slices
from tessera.llm.words import Scanner, mix, shingles

_M = np.uint64(0x9FB21C651E98DF25)
#: Costs are measured for segments of a band apart, and above so many segments for groups of them.
GROUPS = 64
#: Bytes of text whose sets are worked on at once: some fifty numbers a word are held for each.
SLICE_BYTES = 1 << 19
#: Counters of one group's sketch of how many pairs of sets share a signature.
COUNTERS = 16


class Bands:
    """Size bands for 100 * intersection >= percent * union: a set's partners are in its own band or a neighbouring one."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = np.array([1, 2], np.int64)

    def reach(self, size: int, bands: int = 0) -> None:
        edges = self.edges.tolist()
        while edges[-1] <= size or len(edges) < bands:
            edges.append(max(edges[-1] + 1, -(-100 * edges[-1] // self.percent)))
        self.edges = np.array(edges, np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """The band of each set; sets of band b meet in the joins of b and b + 1."""
        self.reach(int(sizes.max(initial=1)))
        band = np.searchsorted(self.edges, sizes, "right") - 1
        self.reach(1, int(band.max(initial=0)) + 4)
        return band

    def differences(self) -> np.ndarray:
        """By band: D <= (100 - p) U / 100 with U = (S + D) / 2 gives D <= S (100 - p) / (100 + p), S at most twice the largest size."""
        return 2 * (self.edges[1:] - 1) * (100 - self.percent) // (100 + self.percent)

    def spare(self) -> np.ndarray:
        """By band: the units k beyond D + 1."""
        return np.maximum(2, (self.differences() + 1) // 5)

    def segments(self) -> np.ndarray:
        return self.differences() + 1 + self.spare()


def owned_sets(data: np.ndarray, offsets: np.ndarray, width: int, scanner: Scanner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle) of the sorted distinct shingles of each text, and the size of each text's set."""
    _, _, prints, first = scanner.scan(data, offsets)
    values, begin = shingles(prints, first, width)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(begin))
    order = np.argsort(values)
    order = order[np.argsort(owner[order], kind="stable")]
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return owner, values, np.bincount(owner, minlength=n)


def sets_of(batches, width: int):
    """(batch, first row, row after the last, owner, shingle, sizes) for runs of rows of each batch."""
    scanner = Scanner("space")
    for batch in batches:
        for low, high, data, offsets in text_slices(batch, "text", SLICE_BYTES):
            yield (batch, low, high, *owned_sets(data, offsets, width, scanner))


class Cut:
    """The segments of many sets in the joins of their own bands (next = 0) or of the bands above (next = 1)."""

    def __init__(self, bands: Bands, owner: np.ndarray, values: np.ndarray, sizes: np.ndarray, next: int):
        self.band = bands.of(sizes) + next
        self.joins = (sizes > 0) & (bands.differences()[self.band] > 0)
        inside = self.joins[owner]
        owner, values = owner[inside], values[inside]
        segment = ((values >> np.uint64(20)) % bands.segments()[self.band[owner]].astype(np.uint64)).astype(np.int64)
        key = owner << np.int64(32) | segment
        order = np.argsort(key, kind="stable")
        key = key[order]
        self.part = mix(values[order] ^ (2 * self.band[owner[order]] + 1).astype(np.uint64) * _M)
        self.begin = np.flatnonzero(np.diff(key, prepend=-1))
        self.many = np.diff(np.append(self.begin, len(key)))
        self.owner, self.segment = key[self.begin] >> np.int64(32), key[self.begin] & np.int64(0xFFFFFFFF)
        self.sum = np.add.reduceat(self.part, self.begin) if len(self.begin) else self.part
        self.salt = self._salt(self.band[self.owner], self.segment, 0)

    @staticmethod
    def _salt(band: np.ndarray, segment: np.ndarray, kind: int) -> np.ndarray:
        return mix((band.astype(np.uint64) << np.uint64(34)) + (segment.astype(np.uint64) << np.uint64(2)) + np.uint64(kind))

    def whole(self) -> np.ndarray:
        """Each segment's own signature."""
        return mix(self.sum + self.salt)

    def deletions(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the segment, signature) of the chosen segments whole and less each one element."""
        at = np.flatnonzero(which)
        salt = self.salt + np.uint64(1)
        parts = np.repeat(which, self.many)
        less = np.repeat(np.arange(len(self.begin)), self.many)[parts]
        return np.concatenate([at, less]), np.concatenate([mix(self.sum[at] + salt[at]), mix(self.sum[less] - self.part[parts] + salt[less])])


def groups_of(segment: np.ndarray) -> np.ndarray:
    return segment % GROUPS


class Costs:
    """For each band and segment group: rows, and a sketch of the pairs of sets that share a signature, of one and of two units.

    A signature adds +1 or -1 to one of COUNTERS counters, by its hash; the squares' sum over all sets estimates the
    sum of squared frequencies. Sketches of parts of the data add up.
    """

    def __init__(self, percent: int):
        self.bands = Bands(percent)
        self.sums: dict[int, np.ndarray] = {}

    def add(self, owner: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
        for next in (0, 1):
            cut = Cut(self.bands, owner, values, sizes, next)
            every = np.ones(len(cut.begin), bool)
            for unit, (place, signature) in ((1, (np.arange(len(cut.begin)), cut.whole())), (2, cut.deletions(every))):
                band, group = cut.band[cut.owner[place]], groups_of(cut.segment[place])
                counter = ((signature >> np.uint64(7)) % np.uint64(COUNTERS)).astype(np.int64)
                sign = np.where(signature >> np.uint64(63) == 1, 1.0, -1.0)
                top = int(band.max(initial=0)) + 1
                cell = ((band * GROUPS + group) * (COUNTERS + 1)) + counter
                found = np.bincount(cell, sign, top * GROUPS * (COUNTERS + 1)).reshape(top, GROUPS, COUNTERS + 1)
                found[:, :, COUNTERS] = np.bincount(band * GROUPS + group, minlength=top * GROUPS).reshape(top, GROUPS)
                for b in np.unique(band).tolist():
                    if b not in self.sums:
                        self.sums[b] = np.zeros((2, GROUPS, COUNTERS + 1))
                    self.sums[b][unit - 1] += found[b]

    def rows(self):
        for band, sums in self.sums.items():
            for unit, group in zip(*np.nonzero(sums[:, :, COUNTERS]), strict=True):
                yield band, int(unit) + 1, int(group), sums[unit, group].astype(np.int64).tolist()


def allocate(bands: Bands, band: int, cost: np.ndarray) -> np.ndarray:
    """Units 0, 1 or 2 by segment group, D + 1 + k in all at least, at about the least cost. cost[unit - 1, group].

    Starting from no units, steps are taken by their price a unit: a group's first unit, its second, or both at once
    where the second is the cheaper. Groups with no measured cost come last.
    """
    bands.reach(1, band + 3)
    n = int(bands.segments()[band])
    many = np.bincount(groups_of(np.arange(n)), minlength=GROUPS)
    one, two = cost
    steps = []
    for g in np.flatnonzero(many).tolist():
        first, second = one[g] / many[g], (two[g] - one[g]) / many[g]
        if second < first:
            steps.append(((first + second) / 2, g, 2))
        else:
            steps += [(first, g, 1), (second, g, 1)]
    units, missing = np.zeros(GROUPS, np.int64), n
    for _, g, step in sorted(steps):
        if missing <= 0:
            break
        units[g] += step
        missing -= step * int(many[g])
    return units


def allocation(measured, percent: int, row: float = 1.0, pair: float = 1.0) -> dict[int, np.ndarray]:
    """Units by band and group from (band, unit, group, counters and rows); a cost is its rows and the pairs that share a signature."""
    costs: dict[int, np.ndarray] = {}
    for band, unit, group, sums in measured:
        rows = sums[COUNTERS]
        squares = float(np.square(np.array(sums[:COUNTERS], float)).sum())
        costs.setdefault(band, np.zeros((2, GROUPS)))[unit - 1, group] = row * rows + pair * max(0.0, squares - rows) / 2
    bands = Bands(percent)
    return {band: allocate(bands, band, cost) for band, cost in costs.items()}


def signatures(bands: Bands, units: dict[int, np.ndarray], owner: np.ndarray, values: np.ndarray, sizes: np.ndarray, next: int):
    """(owner, signature, left out by choice?) and, by owner, how many more units the set may leave out in this join.

    A set with more empty one-unit segments than spare units gives signatures of those beyond; an empty two-unit
    segment always has one.
    """
    cut = Cut(bands, owner, values, sizes, next)
    n = bands.segments()
    spare = bands.spare()[cut.band].copy()
    table = np.ones((int(cut.band.max(initial=0)) + 1, GROUPS), np.int64)
    for band, u in units.items():
        if band < len(table):
            table[band] = u
    unit = table[cut.band[cut.owner], groups_of(cut.segment)]
    whole, two = unit == 1, unit == 2
    place, less = cut.deletions(two)
    out = [(cut.owner[whole], cut.whole()[whole], np.ones(int(whole.sum()), bool)), (cut.owner[place], less, np.zeros(len(place), bool))]
    held = np.bincount(cut.owner, minlength=len(sizes))
    lacking = np.flatnonzero(cut.joins & (held < n[cut.band]))
    first = np.searchsorted(cut.owner, lacking)
    for o, a, h in zip(lacking.tolist(), first.tolist(), held[lacking].tolist(), strict=True):
        band = int(cut.band[o])
        empty = np.setdiff1d(np.arange(n[band]), cut.segment[a : a + h])
        of = table[band, groups_of(empty)]
        total = int((np.bincount(groups_of(np.arange(n[band])), minlength=GROUPS) * table[band]).sum())
        left = max(0, total - int(n[band])) + int(spare[o])
        alone = empty[of == 1][left:]
        spare[o] = max(0, int(spare[o]) - int((of == 1).sum()))
        for part, kind in ((alone, 0), (empty[of == 2], 1)):
            if len(part):
                salt = cut._salt(np.full(len(part), band), part, 0) + np.uint64(kind)
                out.append((np.full(len(part), o), mix(salt), np.zeros(len(part), bool)))
    return (*(np.concatenate(x) for x in zip(*out, strict=True)), np.where(cut.joins, spare, 0), cut.joins)


def parity_bits(owner: np.ndarray, values: np.ndarray, sizes: np.ndarray, least: int = 64, most: int = 1 << 16) -> list[bytes]:
    """For each set a bit map of at least twice its size (a power of two) that holds, by hash, the parity of its elements.

    Two maps, the longer folded to the shorter, differ in no more bits than the sets in elements.
    """
    size = np.clip(1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64), least, most)
    begin = np.concatenate([[0], np.cumsum(size)])
    spot = begin[owner] + (mix(values) % size[owner].astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(spot, minlength=begin[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((begin[:-1] >> 3).tolist(), (begin[1:] >> 3).tolist(), strict=True)]


def folded(bits: list[bytes]) -> np.ndarray:
    """Bit maps as rows of 64-bit words, all folded to the length of the shortest."""
    words = min(map(len, bits)) // 8
    return np.array([np.bitwise_xor.reduce(np.frombuffer(b, "<u8").reshape(-1, words), axis=0) for b in bits])
