"""Secrets in texts: fixed patterns, and probabilistic automata inferred from the credentials that those find.

A first pass over the texts takes the fixed patterns' values and, from all candidates (runs of credential characters,
less what a pattern covers), the counts of symbol pairs. A bounded, hashed sample of the distinct values, the labelled
credentials, makes one prefix tree a kind; states whose next-symbol and end frequencies are compatible by the Hoeffding
bound are merged. A second pass scores every candidate by its likelihood under the automata against that of the pairs.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table, text_slices, written

#: The base patterns, their least lengths, and the order of kinds. Only group 1 of assign ignores case.
KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
HINTS = re.compile(rb"password|passwd|secret|token|api_?key|akia|[0-9a-f]{32}")

#: A candidate's symbols are characters by class; inside a class all are equally likely.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
END = len(CLASSES)
SYMBOL = np.full(256, END, np.int8)
for _i, _group in enumerate(CLASSES):
    SYMBOL[list(_group.encode())] = _i
SHARE = np.array([-math.log2(len(group)) for group in CLASSES] + [0.0])
SPANS = "array<struct<kind:int,start:int,end:int>>"


def base_spans(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, end, value) of the fixed patterns, in bytes; assign's span is the whole match, its value group 2."""
    out = [(0, *m.span(), m.group(2)) for m in ASSIGN.finditer(data) if len(m.group(2)) >= LEAST["assign"]]
    out += [(1, *m.span(), m.group()) for m in ACCESS.finditer(data) if len(m.group()) >= LEAST["access"]]
    out += [(2, *m.span(), m.group()) for m in HEX.finditer(data) if len(m.group()) >= LEAST["hex"]]
    return out


class Runs:
    """Pattern spans (text, kind, start, end, value) and candidates of concatenated texts, as places in their bytes.

    A candidate is a run of credential characters inside one text, of the least labelled length or more, after all that
    a pattern span covers has been cut out.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        whole = data.tobytes()
        self.spans = []
        spaced = np.insert(data, offsets[1:-1], 0x20).tobytes().lower()  # no hint crosses two texts
        hinted = np.array([m.start() for m in HINTS.finditer(spaced)], np.int64)
        self.symbols = np.append(SYMBOL[data], np.int8(END))  # an end after the last byte
        for t in np.unique(np.searchsorted(offsets[:-1] + np.arange(len(offsets) - 1), hinted, "right") - 1).tolist():
            low = int(offsets[t])
            for kind, start, end, value in base_spans(whole[low : int(offsets[t + 1])]):
                self.spans.append((t, kind, start + low, end + low, value))
        for _, _, start, end, _ in self.spans:
            self.symbols[start:end] = END
        held = self.symbols[:-1] < END
        first = held.copy()
        first[1:] &= ~held[:-1]
        first[offsets[:-1][offsets[:-1] < len(data)]] |= held[offsets[:-1][offsets[:-1] < len(data)]]
        starts = np.flatnonzero(first)
        stop = np.append(np.flatnonzero(~held), len(data))
        ends = np.minimum(stop[np.searchsorted(stop, starts)], np.append(starts[1:], len(data)))
        long = ends - starts >= LEAST["assign"]
        self.starts, self.ends = starts[long], ends[long]

    def pairs(self) -> np.ndarray:
        """How often each symbol follows each other one in candidates; END stands before and after."""
        inside = np.zeros(len(self.symbols), np.int32)
        np.add.at(inside, self.starts, 1)
        np.add.at(inside, self.ends, -1)
        at = np.flatnonzero(np.cumsum(inside)[:-1])
        n = END + 1
        last = np.zeros(len(self.symbols), bool)
        last[self.ends - 1] = True
        after = np.where(last[at], END, self.symbols[np.minimum(at + 1, len(self.symbols) - 1)])
        out = np.bincount(self.symbols[at].astype(np.int64) * n + after, minlength=n * n)
        out += np.bincount(END * n + self.symbols[self.starts].astype(np.int64), minlength=n * n)
        return out.reshape(n, n)


class Automaton:
    """A probabilistic automaton: for each state, symbol counts (END for the end) and the next state by symbol."""

    def __init__(self, count: list[list[int]], next_: list[dict[int, int]]):
        self.count = count
        seen = np.array(count, float) + 0.1
        self.cost = np.log2(seen / seen.sum(axis=1, keepdims=True)) + SHARE
        self.next = np.tile(np.arange(len(count))[:, None], END + 1)
        for state, to in enumerate(next_):
            for s, t in to.items():
                self.next[state, s] = t

    def bits(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log2 of each value's probability; a symbol that a state never saw keeps the state at its smoothed price."""
        order = np.argsort(starts - ends, kind="stable")  # the longest first, so that those left are always in front
        starts, length = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        left = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right")
        for i, n in enumerate(left.tolist()):
            s = symbols[starts[:n] + i]
            total[:n] += self.cost[state[:n], s]
            state[:n] = self.next[state[:n], s]
        out = np.empty(len(starts))
        out[order] = total + self.cost[state, END]
        return out


def infer(values: list[bytes], alpha: float = 0.05) -> Automaton:
    """Merges compatible states of the values' prefix tree: red states are kept, their children are merged or turn red.

    Two states are compatible if neither the frequencies of their next symbols nor those of how much is still to come
    differ by more than the Hoeffding bound at alpha, and so for all states that both lead to. What is still to come keeps
    formats of a fixed length apart by place. A state is tried with red states of its own depth first, so that one with
    few examples, which many would fit, joins those of its place.
    """
    count, child, depth = [[0] * (END + 1)], [{}], [0]
    longest = max(map(len, values), default=0)
    left = [np.zeros(longest + 1)]  # by how many symbols are still to come
    for value in values:
        state = 0
        for i, c in enumerate(value):
            s = int(SYMBOL[c])
            count[state][s] += 1
            left[state][len(value) - i] += 1
            if s not in child[state]:
                child[state][s] = len(count)
                count.append([0] * (END + 1))
                child.append({})
                depth.append(i + 1)
                left.append(np.zeros(longest + 1))
            state = child[state][s]
        count[state][END] += 1
        left[state][0] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = sum(count[a]), sum(count[b])
            limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)) if n and m else 2.0
            if limit < 1:  # no two shares differ by more than 1
                if any(abs(x / n - y / m) > limit for x, y in zip(count[a], count[b], strict=True)):
                    return False
                if np.abs(np.cumsum(left[a] / n - left[b] / m)).max() > limit:
                    return False
            pairs += [(child[a][s], child[b][s]) for s in child[b] if s in child[a]]
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below b to state a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            count[a] = [x + y for x, y in zip(count[a], count[b], strict=True)]
            left[a] = left[a] + left[b]
            for s, to in child[b].items():
                if s in child[a]:
                    pairs.append((child[a][s], to))
                else:
                    child[a][s] = to

    red, settled = [0], {0}
    while blue := sorted({(to, state, s) for state in red for s, to in child[state].items() if to not in settled}):
        to, state, s = max(blue, key=lambda x: (sum(count[x[0]]), -x[0]))
        for r in sorted(red, key=lambda r: abs(depth[r] - depth[to])):
            if alike(r, to):
                child[state][s] = r
                fold(r, to)
                break
        else:
            red.append(to)
            settled.add(to)
    name = {r: i for i, r in enumerate(red)}
    return Automaton([count[r] for r in red], [{s: name[to] for s, to in child[r].items()} for r in red])


def _laid_out(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all values with an end after the last, and where each begins and ends."""
    ends = np.cumsum([len(v) for v in values])
    return np.append(SYMBOL[np.frombuffer(b"".join(values), np.uint8)], np.int8(END)), ends - np.diff(ends, prepend=0), ends


class Grammar:
    """Automata by kind, each with a cut, the gain a symbol that a candidate needs, and the background.

    A gain is the log2 of how much likelier a candidate is under an automaton than under the background. Every fourth
    example, from `held_out` of them on, is kept from the automaton; the cut is `slack` times the gain that all but `missed`
    of those reach, as a credential of another length pays for its end, and `margin` at least. A candidate is taken if its gain a symbol reaches the cut of some kind and its whole gain
    outweighs how much more frequent candidates are than credentials (`credentials` of them), so that the odds are for it.
    """

    def __init__(self, examples: dict[int, list[bytes]], pairs: np.ndarray, credentials: float, margin: float = 0.15, missed: float = 0.05, slack: float = 0.5, held_out: int = 20):
        self.background = np.log2((pairs + 0.5) / (pairs + 0.5).sum(axis=1, keepdims=True)) + SHARE
        self.odds = max(0.0, math.log2((pairs[END].sum() + 1) / (credentials + 1)))
        self.automata = {}
        for kind, values in examples.items():
            apart = len(values) >= held_out
            automaton = infer([v for i, v in enumerate(values) if i % 4] if apart else values)
            symbols, starts, ends = _laid_out(values[::4] if apart else values)
            rates = np.sort(self._gains(automaton, symbols, starts, ends) / (ends - starts + 1))
            self.automata[kind] = (automaton, max(margin, slack * float(rates[int(missed * len(rates))])))

    def _gains(self, automaton: Automaton, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        steps = np.append(self.background[symbols[:-1], symbols[1:]], 0.0)
        total = np.concatenate([[0.0], np.cumsum(steps)])
        plain = total[ends - 1] - total[starts] + self.background[END, symbols[starts]] + self.background[symbols[ends - 1], END]
        return automaton.bits(symbols, starts, ends) - plain

    def scores(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Greatest gain among kinds whose cut it reaches; -inf if there is none."""
        out = np.full(len(starts), -np.inf)
        for automaton, cut in self.automata.values() if len(starts) else ():
            gain = self._gains(automaton, symbols, starts, ends)
            out = np.where(gain >= cut * (ends - starts + 1), np.maximum(out, gain), out)
        return out

    def secret(self, runs: Runs) -> np.ndarray:
        """Which candidates are taken."""
        return self.scores(runs.symbols, runs.starts, runs.ends) >= self.odds


def learn(docs: DataFrame, most: int = 400, longest: int = 64) -> Grammar | None:
    """The grammar from at most `most` distinct credentials a kind, of `longest` characters at most, those of the least hash.

    Background pairs come from all candidates of all texts. None if no credential is found. A null text is empty;
    repeated rows teach the background each, but a credential is one example however often it stands.
    """

    def run(batches):
        pairs = np.zeros((END + 1, END + 1), np.int64)
        schema = pa.schema([("kind", pa.int32()), ("value", pa.string()), ("n", pa.int64())])
        counts: dict[tuple[int, str | None], int] = {}

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.int32()), pa.array([v for _, v in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return batch

        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text"):
                runs = Runs(data, offsets)
                pairs += runs.pairs()
                for _, kind, _, _, value in runs.spans:  # longer ones are counted without their value
                    key = kind, value.decode() if len(value) <= longest else None
                    counts[key] = counts.get(key, 0) + 1
                if len(counts) > 10_000:
                    yield flush()
        yield flush()
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - some, pa.int32()), pa.nulls(len(some), pa.string()), pa.array(pairs.ravel()[some], pa.int64())], schema=schema)

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind int, value string, n long")
    found = written(found.groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    pairs = np.zeros((END + 1) ** 2)
    for kind, n in found.where("kind < 0").select("kind", "n").collect():  # at most 144 rows
        pairs[-1 - kind] = n
    examples = {}
    for kind in range(3):
        values = [r[0].encode() for r in found.where((F.col("kind") == kind) & F.col("value").isNotNull()).orderBy(F.xxhash64("value"), "value").select("value").limit(most).collect()]
        if values:
            examples[kind] = values
    credentials = found.where("kind >= 0").agg(F.sum("n")).first()[0] or 0
    return Grammar(examples, pairs.reshape(END + 1, END + 1), credentials) if examples else None


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, base and spans (arrays of kind, start, end by start, then kind) of all secrets of every document.

    base holds the fixed patterns' spans, spans those and the candidates that the grammar takes; places are code points.
    Null and empty texts have none; a null doc_id stays null; equal rows and texts get equal results; other columns,
    whatever their names, are kept only if asked for; an empty table gives no rows.
    """
    names = list(keep)
    source = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(learn(docs))
    struct = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in text_slices(batch, "text"):
                runs = Runs(data, offsets)
                base: list[list[dict]] = [[] for _ in range(high - low)]
                spans: list[list[dict]] = [[] for _ in range(high - low)]
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                rows = [(t, start, kind, end) for t, kind, start, end, _ in runs.spans]
                if held.value is not None:
                    took = np.flatnonzero(held.value.secret(runs))
                    texts = np.searchsorted(offsets, runs.starts[took], "right") - 1
                    rows += [(t, a, 3, b) for t, a, b in zip(texts.tolist(), runs.starts[took].tolist(), runs.ends[took].tolist(), strict=True)]
                for t, start, kind, end in sorted(rows):
                    x = {"kind": kind, "start": int(point[start] - point[offsets[t]]), "end": int(point[end] - point[offsets[t]])}
                    spans[t].append(x)
                    if kind < 3:
                        base[t].append(x)
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(base, struct), pa.array(spans, struct)], [*part.schema.names[:-1], "base", "spans"])

    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(run, f"{text}, base {SPANS}, spans {SPANS}").toDF(*names, "base", "spans")


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined, of an array ordered by start, then kind."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.array_join(F.expr(f"transform({spans}, x -> concat_ws(':', {names}[x.kind], x.start, x.end))"), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every secret span of text replaced by a mark; overlapping spans share one.

    Texts without secrets, null texts and other columns stay as they are, as do rows with a null doc_id and repeated
    ones; equal texts get equal results; an empty table stays empty.
    """
    grammar = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        for low, _, data, offsets in text_slices(batch, "text"):
            runs = Runs(data, offsets)
            spans = [(start, end) for _, _, start, end, _ in runs.spans]
            if grammar.value is not None:
                took = grammar.value.secret(runs)
                spans += zip(runs.starts[took].tolist(), runs.ends[took].tolist(), strict=True)
            changed: dict[int, list[tuple[int, int]]] = {}
            for start, end in sorted(spans):
                changed.setdefault(int(np.searchsorted(offsets, start, "right")) - 1, []).append((start, end))
            for t, found in changed.items():
                parts, at = [], int(offsets[t])
                for begin, end in found:
                    if begin >= at:
                        parts += [data[at:begin].tobytes(), mark.encode()]
                    at = max(at, end)
                out[low + t] = b"".join([*parts, data[at : offsets[t + 1]].tobytes()]).decode()
        return pa.array(out, pa.string())

    return docs.withColumn("text", cut(F.col("text").cast("string")))


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as long)").alias(f"n_{KINDS[i]}") for i in range(3)]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
