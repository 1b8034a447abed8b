"""Set similarity join of documents on word shingles (Jaccard), by segments of a partitioned universe.

Signatures (`segments`) say which sets may link. Of the sets that share one, each is first compared with one of them;
what those links join needs no more comparing. Sets that share a signature and are still apart meet in blocks, where
bit maps rule most pairs out; the rest are compared whole. Texts go only to comparisons, one for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, possible_members, table, written
from tessera.llm.segments import COUNTERS, Bands, Costs, allocation, folded, parity_bits, sets_of, signatures
from tessera.llm.words import mix

_OTHER = np.uint64(0xD1B54A32D192ED03)


def describe(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, h, n_shingles and a 128-bit fingerprint of the set (k1, k2) of every row; and, with `sums`, the costs of segments.

    docs has doc_id, h and text. Rows with sums are (band, unit, group, sums) in k1, k2, n_shingles and sums: every
    task's sketch over its sets, equal ones once.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        costs, seen = Costs(percent), set()
        for batch, low, high, owner, values, sizes in sets_of(batches, width):
            keys = []
            for salt in (np.uint64(0), _OTHER):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ salt), dtype=np.uint64)])
                end = np.cumsum(sizes)
                keys.append(total[end] - total[end - sizes])
            part = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(sizes, pa.int64()), *(pa.array(k.view(np.int64)) for k in keys), pa.nulls(high - low, schema.field("sums").type)], schema=schema)
            fresh = np.array([k not in seen for k in keys[0].tolist()])
            seen.update(keys[0].tolist())
            inside = fresh[owner]
            costs.add(owner[inside], values[inside], np.where(fresh, sizes, 0))
        rows = list(costs.rows())
        if rows:
            band, unit, group, sums = zip(*rows, strict=True)
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(group, pa.int64()), pa.array(band, pa.int64()), pa.array(unit, pa.int64()), pa.array(sums, schema.field("sums").type)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, h long, n_shingles long, k1 long, k2 long, sums array<bigint>")


def measured(described: DataFrame) -> list[tuple[int, int, int, list[int]]]:
    """(band, unit, group, sums) over all tasks: at most 128 rows a band, and bands grow with the logarithm of the largest set."""
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(COUNTERS + 1)]
    return [(r[0], r[1], r[2], list(r[3:])) for r in described.where("sums is not null").groupBy("k1", "k2", "n_shingles").agg(*sums).collect()]


def signature_rows(reps: DataFrame, width: int, percent: int, units: dict[int, np.ndarray], shared: DataFrame | None = None) -> DataFrame:
    """signature of every set's segments; with `shared`, signature, vertex, next, spare and optional of those that are probably in it."""
    lean = shared is None
    held = reps.sparkSession.sparkContext.broadcast(units)
    inside = None if lean else possible_members(shared.select(F.col("signature").alias("id")), spots=134_217_689)

    def run(batches):
        bands = Bands(percent)
        for batch, low, high, owner, values, sizes in sets_of(batches, width):
            vertex = None if lean else batch.column("vertex").to_numpy()[low:high]
            for next in (0, 1):
                of, found, optional, spare, _ = signatures(bands, held.value, owner, values, sizes, next)
                if lean:
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["signature"])
                    continue
                some = inside(found.view(np.int64))
                of, found, optional = of[some], found[some], optional[some]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(vertex[of]), pa.array(np.full(len(of), next), pa.int32()), pa.array(spare[of], pa.int32()), pa.array(optional)], ["signature", "vertex", "next", "spare", "optional"])

    return reps.mapInArrow(run, "signature long" if lean else "signature long, vertex long, next int, spare int, optional boolean")


def kept_signatures(reps: DataFrame, width: int, percent: int, units: dict[int, np.ndarray]) -> DataFrame:
    """signature, vertex, degree (how often others hold the set's signatures): the shared signatures of each set but the most shared ones that it may leave out."""
    shared = written(signature_rows(reps, width, percent, units).groupBy("signature").agg(F.count("*").alias("n")).where("n > 1"), "shared-signatures")
    near = signature_rows(reps, width, percent, units, shared).join(shared, "signature")
    order = Window.partitionBy("vertex", "next").orderBy(F.desc("optional"), F.desc("n"), "signature")
    near = near.withColumn("rank", F.row_number().over(order)).withColumn("degree", F.sum("n").over(Window.partitionBy("vertex", "next"))).where("not optional or rank > spare")
    return written(near.select("signature", "vertex", "degree"), "kept-signatures")


def set_bits(reps: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """vertex, size and bits (parities of hashed elements) of the sets in ids(id), and of a few others."""
    inside = possible_members(ids)

    def run(batches):
        for batch, low, high, owner, values, sizes in sets_of(_filtered(batches, inside), width):
            yield pa.RecordBatch.from_arrays([batch.column("vertex")[low:high], pa.array(sizes, pa.int64()), pa.array(parity_bits(owner, values, sizes), pa.binary())], ["vertex", "size", "bits"])

    return reps.mapInArrow(run, "vertex long, size long, bits binary")


def _filtered(batches, inside):
    for batch in batches:
        yield batch.filter(pa.array(inside(batch.column("vertex").to_numpy(zero_copy_only=False))))


def only(reps: DataFrame, ids: DataFrame) -> DataFrame:
    """Sets whose vertex is in ids(id), and a few others that a later join drops: most of the others need no shuffle."""
    inside = possible_members(ids)
    return reps.select("vertex", "text").mapInArrow(lambda batches: _filtered(batches, inside), "vertex long, text string")


def _differences(size: np.ndarray, other: np.ndarray | int, percent: int) -> np.ndarray:
    return (size + other) * (100 - percent) // (100 + percent)


def plausible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) but those whose sizes or bit maps differ too much for a link."""
    sides = {x: bits.select(F.col("vertex").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab"}
    met = pairs.join(sides["a"], "a").join(sides["b"], "b").where(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")

    def run(batches):
        for batch in batches:
            most = _differences(batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy(), percent)
            far = [int(np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum()) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(far, np.int64) <= most))

    return met.select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, reps: DataFrame, width: int, percent: int, most: int = 256) -> DataFrame:
    """The pairs (a, b) that link. Each `most` partners of an a are a group of their own, to which a's text goes once."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    texts = written(only(reps, ids), "compared-texts")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("groups"))
    members = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"), F.col("b").alias("vertex"), F.lit(True).alias("member"))
    heads = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.col("a").alias("vertex"), F.lit(False).alias("member"))
    rows = members.union(heads).join(texts, "vertex").repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def run(batches):
        key, head = None, np.zeros(0, np.uint64)
        for batch, low, high, owner, values, sizes in sets_of(batches, width):
            end = np.cumsum(sizes)
            rows = batch.slice(low, high - low).select(["a", "part", "vertex", "member"]).to_pydict()
            found = []
            for i, (a, part, vertex, member) in enumerate(zip(*rows.values(), strict=True)):
                mine = values[end[i] - sizes[i] : end[i]]
                if not member:
                    key, head = (a, part), mine
                    continue
                assert key == (a, part)
                at = np.minimum(np.searchsorted(head, mine), len(head) - 1)
                same = int((head[at] == mine).sum()) if len(head) else 0
                if 100 * same >= percent * (len(mine) + len(head) - same):
                    found.append((a, vertex))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return written(rows.select("a", "part", "vertex", "member", "text").mapInArrow(run, "a long, b long"), "links")


def apart(rows: DataFrame) -> DataFrame:
    """rows (signature, vertex, label) of the signatures whose sets have several labels, with the number of sets."""
    mixed = rows.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high")
    return rows.join(mixed.select("signature", "n"), "signature")


def block_pairs(rows: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """a, b, label_a, label_b: sets that share a signature, have two labels, and whose bit maps allow a link.

    rows: signature, n (its sets), vertex, label, size, bits. A signature's sets are dealt into chunks of about `block`,
    and every two chunks meet in a task, whatever the number of sets.
    """
    chunks = F.ceil(F.col("n") / block).cast("int")
    dealt = rows.withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64("vertex"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("signature", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("side"), "vertex", "label", "size", "bits")
    dealt = dealt.repartition("signature", "i", "j").sortWithinPartitions("signature", "i", "j")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("label_a", pa.int64()), ("label_b", pa.int64())])

    def compare(held):
        side, vertex, label, size, bits = zip(*held, strict=True)
        side, vertex, label, size, words = np.array(side), np.array(vertex), np.array(label), np.array(size), folded(list(bits))
        crossing = bool(side.any())
        for x in range(len(held) - 1):
            if crossing and side[x]:
                continue
            y = np.flatnonzero(side) if crossing else np.arange(x + 1, len(held))
            y = y[(label[y] != label[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
            if len(y):
                far = np.bitwise_count(words[y] ^ words[x]).sum(axis=1)
                for z in y[far <= _differences(size[y], size[x], percent)].tolist():
                    p, q = (x, z) if vertex[x] < vertex[z] else (z, x)
                    yield vertex[p], vertex[q], label[p], label[q]

    def run(batches):
        held, last = [], None
        for batch in batches:
            columns = batch.to_pydict()
            for signature, i, j, *row in zip(*columns.values(), strict=True):
                if (signature, i, j) != last:
                    if len(held) > 1 and (found := list(compare(held))):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)
                    held, last = [], (signature, i, j)
                held.append(row)
        if len(held) > 1 and (found := list(compare(held))):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

    return dealt.mapInArrow(run, "a long, b long, label_a long, label_b long")


def labelled(rows: DataFrame, links: DataFrame, vertices: list[str]) -> DataFrame:
    """rows with a label for each named vertex column: the component of `links` that it is in, or itself."""
    parts = written(components(links), "labels")
    for name in vertices:
        label = "label" if name == "vertex" else f"label_{name}"
        rows = rows.drop(label).join(parts.select(F.col("vertex").alias(name), F.col("component").alias(label)), name, "left").withColumn(label, F.coalesce(label, name))
    return rows


def find_links(reps: DataFrame, width: int, percent: int, units: dict[int, np.ndarray]) -> DataFrame:
    """Links (a, b) between sets, as many as join their components. reps: vertex, text; no two sets are equal.

    A head of every signature meets the others first: the set whose signatures are shared most, as an original is among
    its copies. What is still apart then meets in blocks.
    """
    kept = kept_signatures(reps, width, percent, units)
    bits = written(set_bits(reps, kept.select(F.col("vertex").alias("id")), width), "bits")
    heads = kept.groupBy("signature").agg(F.max_by("vertex", "degree").alias("head"), F.min("vertex").alias("low"), F.max("vertex").alias("high")).where("low < high")
    met = kept.join(heads.select("signature", "head"), "signature").select(F.least("head", "vertex").alias("a"), F.greatest("head", "vertex").alias("b")).where("a < b").distinct()
    met = written(met, "met")
    links = verified(plausible(met, bits, percent), reps, width, percent)

    rest = apart(labelled(kept, links, ["vertex"]).select("signature", "vertex", "label"))
    pairs = block_pairs(rest.join(bits, "vertex"), percent).distinct()
    pairs = written(pairs.join(met, ["a", "b"], "left_anti"), "apart-pairs")
    if not pairs.limit(1).count():
        return links
    # one pair for each two components first: most others are then joined
    nearest = pairs.groupBy("label_a", "label_b").agg(F.min(F.struct("a", "b")).alias("first")).select("first.*")
    links = links.union(verified(nearest, reps, width, percent))
    left = labelled(pairs, links, ["a", "b"]).where("label_a <> label_b").select("a", "b")
    return links.union(verified(left.join(nearest, ["a", "b"], "left_anti"), reps, width, percent))


def similarity_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), h and kept for every row.

    h is the text's xxhash64; kept says whether (doc_id, h) is the first of its component, or the row is in none.
    Equal sets are one class, of which one text is joined; rows with one doc_id and different texts are different
    documents, and equal rows are one class. Null and empty texts have no shingles and link with nothing: their
    component is their own doc_id. A row with a null doc_id links with nothing and has a null component. A very long
    text is one row like any other. Other columns are ignored. An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    described = written(describe(docs, width, percent), "sets")
    sets = described.where("sums is null").drop("sums")
    some = sets.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("n"))
    classes = written(classes.select("k1", "k2", "n_shingles", "n", "first.*", F.monotonically_increasing_id().alias("vertex")), "classes")
    units = allocation(measured(described), percent)
    reps = docs.join(classes.select("doc_id", "h", "vertex"), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("vertex", "text")
    links = find_links(written(reps, "class-texts"), width, percent, units)

    joined = components(links).withColumnRenamed("component", "root")
    named = classes.join(joined, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    lowest = named.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("component"))
    return _with_classes(sets, named.join(lowest, "root").select("k1", "k2", "n_shingles", "n", "component"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the first row of each component: least doc_id, then text hash; one of equal rows.

    Rows without words or doc_id are in no component and stay, repeated ones too. All columns stay, whatever their
    names; an empty table stays empty.
    """
    names = [c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)]
    held = docs.toDF(*names).withColumns({"_id": F.col("doc_id").cast("long"), "_h": F.xxhash64(F.col("text").cast("string")), "_n": F.monotonically_increasing_id()})  # numbered before any shuffle
    keys = similarity_classes(held, width, percent).where("kept").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), (F.col("n_shingles") > 0).alias("_words")).distinct()
    first = held.join(keys, ["_id", "_h"])
    first = first.withColumn("_row", F.when(F.col("_words"), F.lit(0)).otherwise(F.col("_n"))).dropDuplicates(["_id", "_h", "_row"])
    return first.select(*names).union(held.where("_id is null").select(*names)).toDF(*docs.columns)


def _with_classes(sets: DataFrame, named: DataFrame, per_task: int = 20_000) -> DataFrame:
    """Each document with its class's component; a class of very many documents is dealt over salts."""
    salts = F.ceil(F.col("n") / per_task).cast("int")
    hot = named.where(F.col("n") > per_task).select("k1", "k2", "n_shingles", salts.alias("salts"))
    dealt = sets.join(hot, ["k1", "k2", "n_shingles"], "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop("n")
    out = dealt.join(spread, ["k1", "k2", "n_shingles", "salt"], "left")
    grouped = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    first = (F.col("doc_id") == F.col("component.doc_id")) & (F.col("h") == F.col("component.h"))
    return out.select("doc_id", "n_shingles", F.when(grouped, F.col("component.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "h", F.when(grouped, first).otherwise(True).alias("kept"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")
