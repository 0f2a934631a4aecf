"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles gives ``REGISTERS`` registers: the truncated logarithm, to a base close to 1, of the least
of exponentially distributed hashes. Registers of a union are the larger ones, and equal registers are as likely as the sets
are similar. Documents with equal sets become one class. Bands of registers put classes into buckets; every member of a bucket
is paired with its pivot, the least id in it and so mostly the same one in all bands, so that pairs stay in proportion to
members. A pair goes on when the likelihood of its registers, given both set sizes, allows the similarity; the full sets then
decide. Where the members of a pivot's buckets still belong to several components, they are compared in blocks of bounded
size, full sets against full sets, and each block reports a link for each two components that it unites. So no link is given
up for a bucket's size, and no pairs of a bucket are ever listed.

Full sets are made again from texts where they are compared: texts are smaller than sets and shrink when shuffled. Before rows
meet a list of keys in a join, a bitmap of ``BITS`` bits drops most of those that are not in the list.

Contract
--------
``near_duplicates(docs)`` gives one row per input row. A null or empty text has the empty set and is linked with nothing. A
null id is linked with nothing either and gets a null component. Rows that repeat an id are one node, linked with whatever
any of its texts is. Ids may be integers, decimals or strings (of which the smallest is the first by their bytes). Only id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import Numbers, bounded_batches, checkpointed, ends_of, lengths, mix64, texts_as_bytes
from ._components import components

SHINGLE = 5
#: Linked from 100 * intersection >= PERCENT * union.
PERCENT = 75
REGISTERS, ROWS = 160, 4
#: Base, rate and largest value of the registers.
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
#: Pairs whose most likely similarity is below this are given up: five standard deviations below the threshold.
LEAST_ESTIMATE = PERCENT / 100 - 5 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: Bytes of shingles in a block of members.
BLOCK_BYTES = 2 << 20
#: Bits of the map that tells which keys may be in a list, and of one of its pages.
BITS, PAGE_BITS = 1 << 26, 1 << 15

_RANDOM = np.random.default_rng(20_11)
_FACTORS = _RANDOM.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_PLACES = _RANDOM.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [t.lower().split() for t in texts]  # both change or split by ASCII only
    numbers = Numbers()
    sizes = lengths(words)
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))[ids]
    n = max(0, len(hashes) - SHINGLE + 1)
    whole = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        whole += hashes[j : n + j] * _PLACES[j]
    whole = mix64(whole)
    out, at = [], 0
    for size in sizes.tolist():
        if size >= SHINGLE:
            out.append(np.unique(whole[at : at + size - SHINGLE + 1]))
        elif size:
            out.append(mix64(np.array([(hashes[at : at + size] * _PLACES[:size]).sum() ^ _PLACES[5 + size % 3]], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, REGISTERS) of 16-bit registers; zeros for an empty set."""
    sizes = lengths(sets)
    least = np.full((len(sets), REGISTERS), np.uint64(2**64 - 1))
    filled = np.flatnonzero(sizes)
    i = 0
    while i < len(filled):  # groups of sets whose hashes fit into the processor's cache
        j, total = i, 0
        while j < len(filled) and (j == i or total + sizes[filled[j]] <= 16_384):
            total += sizes[filled[j]]
            j += 1
        some = filled[i:j]
        flat = np.concatenate([sets[k] for k in some])
        starts = ends_of(sizes[some])[:-1]
        for r in range(REGISTERS):
            least[some, r] = np.minimum.reduceat(flat * _FACTORS[r] + _OFFSETS[r], starts)
        i = j
    share = (least.astype(np.float64) + 1) / 2.0**64
    exponential = -np.log1p(-np.minimum(share, 1 - 2.0**-53)) / RATE
    found = np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)
    found[sizes == 0] = 0
    return found


def bands(found: np.ndarray) -> np.ndarray:
    """One key for each band of each document."""
    rows = found.reshape(len(found), -1, ROWS).astype(np.uint64)
    packed = rows[:, :, 0] | rows[:, :, 1] << np.uint64(16) | rows[:, :, 2] << np.uint64(32) | rows[:, :, 3] << np.uint64(48)
    return mix64(packed + mix64(np.arange(packed.shape[1]) + 1)[None, :]).view(np.int64)


def _differs(x: np.ndarray) -> np.ndarray:
    """Chance that one register is above the other, when a share x of the elements decides so."""
    return -np.log(np.maximum(1 - np.maximum(x, 0) * (BASE - 1) / BASE, 1e-12)) / np.log(BASE)


def may_be_similar(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the likelihood of the similarity, given registers and set sizes, is largest at LEAST_ESTIMATE or above."""
    above, below = (a > b).sum(-1), (a < b).sum(-1)
    equal = a.shape[-1] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)

    def loglikelihood(j: np.ndarray) -> np.ndarray:
        up, down = _differs(u - v * j), _differs(v - u * j)
        return above * np.log(np.maximum(up, 1e-9)) + below * np.log(np.maximum(down, 1e-9)) + equal * np.log(np.maximum(1 - up - down, 1e-9))

    at = LEAST_ESTIMATE
    rising = loglikelihood(np.minimum(most, at + 1e-4)) >= loglikelihood(np.full_like(most, at))
    return (100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)) & (rising | (most < at + 1e-4))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a fingerprint of the set and its registers."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(texts_as_bytes(batch))
            found = registers(sets)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths(sets)), pa.array(prints, pa.binary()), pa.array([r.tobytes() for r in found], pa.binary())], names=["doc_id", "n_shingles", "print", "registers"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, print binary, registers binary")


def _unpack(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(texts_as_bytes(batch, name)), np.uint16).reshape(batch.num_rows, REGISTERS)


def among(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """The rows whose key is in the list (of one column), and a few others: as large a share as bits are set."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    places = listed.select(place(listed.columns[0]).alias("at"))
    pages = places.groupBy(F.floor(F.col("at") / PAGE_BITS).alias("_page")).agg(F.bitmap_construct_agg(F.col("at") % PAGE_BITS).alias("_bits"))
    met = rows.withColumn("_at", place(key)).join(F.broadcast(pages), F.floor(F.col("_at") / PAGE_BITS) == F.col("_page"))  # BITS / 8 bytes at most
    return met.filter(F.expr(f"getbit(cast(conv(hex(substring(_bits, cast(_at % {PAGE_BITS} / 8 as int) + 1, 1)), 16, 10) as int), cast(_at % 8 as int)) = 1")).select(*rows.columns)


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers allow the similarity."""
    side = lambda s: among(sketches, "doc_id", pairs.select(s)).select(F.col("doc_id").alias(s), F.col("registers").alias(f"r_{s}"), F.col("n_shingles").alias(f"n_{s}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(batch.schema.get_field_index(n)).to_numpy().astype(float) for n in ("n_a", "n_b"))
            ok = may_be_similar(_unpack(batch, "r_a"), _unpack(batch, "r_b"), n_a, n_b)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""
    kind = pairs.schema["a"].dataType.simpleString()
    side = lambda s: among(docs.select("doc_id", "text"), "doc_id", pairs.select(s)).select(F.col("doc_id").alias(s), F.col("text").alias(f"t_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = Numbers()
            left, right = ([numbers[t] for t in texts_as_bytes(batch, name)] for name in ("t_a", "t_b"))
            sets = shingle_sets(list(numbers))
            ok = []
            for x, y in ((sets[i], sets[j]) for i, j in zip(left, right)):
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                ok.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(run, f"a {kind}, b {kind}")


def bucketed(classes: DataFrame) -> DataFrame:
    """(bucket, doc_id, pivot, n) of buckets with n >= 2 classes."""
    kind = classes.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = bands(_unpack(batch, "registers"))
            owner = np.repeat(np.arange(len(keys)), keys.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(keys.ravel())], names=["doc_id", "bucket"])

    exploded = classes.select("doc_id", "registers").mapInArrow(run, f"doc_id {kind}, bucket long")
    pivots = checkpointed(exploded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("pivot")).filter("n >= 2"))
    return among(exploded, "bucket", pivots.select("bucket")).join(pivots, "bucket")


def block_links(ids: np.ndarray, components: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A link for each two components that pairs of left and right members unite; places in ids. No set is empty."""
    if not len(sets):
        return []
    sizes = lengths(sets)
    starts = ends_of(sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(shingle.max()) + 1, np.int64)
    _, top = np.unique(components, return_inverse=True)
    found = []
    for i in left.tolist():
        own = shingle[starts[i] : starts[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[shingle], starts[:-1])
        mark[own] = 0
        linked = right[100 * both[right] >= PERCENT * (sizes[i] + sizes[right] - both[right])]
        for j in linked[top[linked] != top[i]].tolist():
            if top[i] != top[j]:
                found.append((i, j))
                top[top == top[j]] = top[i]
    return found


def across(buckets: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between members of a pivot's buckets that belong to more than one component."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = buckets.filter("n >= 3 and doc_id <> pivot").select("pivot", "doc_id").distinct()
    known = known.join(labels, F.col("doc_id") == F.col("node"), "left").select("pivot", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    known = checkpointed(known.join(classes.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id"))
    blocks = F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES).cast("int").alias("blocks")
    mixed = known.groupBy("pivot").agg(F.min("component").alias("least"), F.max("component").alias("most"), blocks).filter("least <> most")
    member = checkpointed(known.join(mixed.select("pivot", "blocks"), "pivot").select("pivot", "doc_id", "component", "blocks"))
    placed = member.join(among(docs.select("doc_id", "text"), "doc_id", member.select("doc_id")), "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    spread = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("pivot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc_id", "component", "text")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sets = shingle_sets([t.encode() for t in table["text"].to_pylist()])
        filled = np.flatnonzero(lengths(sets))
        own, ids, component = (table[c].to_numpy(zero_copy_only=False)[filled] for c in ("own", "doc_id", "component"))
        pairs = block_links(ids, component, [sets[i] for i in filled], np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py()))
        both = [sorted((ids[i], ids[j])) for i, j in pairs]
        of = table.schema.field("doc_id").type
        return pa.table({"a": pa.array([a for a, _ in both], of), "b": pa.array([b for _, b in both], of)})

    return spread.filter(F.col("text").isNotNull()).groupBy("pivot", "low", "high").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def class_links(docs: DataFrame, classes: DataFrame, known: DataFrame) -> DataFrame:
    """(node, component) of the classes' representatives that are linked to others, by text or by the known links."""
    buckets = checkpointed(bucketed(classes))
    pairs = checkpointed(buckets.filter("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct())
    pairs = checkpointed(likely(pairs, classes.select("doc_id", "registers", "n_shingles")))
    links = checkpointed(verified(pairs, docs).union(known.select("a", "b")))
    more = checkpointed(across(buckets, checkpointed(components(links)), docs, classes))
    return components(links.union(more))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept."""
    sketches = checkpointed(sketch(docs))
    own = sketches.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    same = (F.max(c).alias(c) for c in ("n_shingles", "registers"))  # a class has one set
    classes = checkpointed(own.groupBy("print").agg(F.min("doc_id").alias("doc_id"), *same))
    members = classes.select("print", F.col("doc_id").alias("class_id"))
    class_of = checkpointed(own.select("doc_id", "print").join(members, "print").select("doc_id", "class_id").distinct())
    least = class_of.groupBy("doc_id").agg(F.min("class_id").alias("least"))
    same_id = class_of.join(least, "doc_id").filter("class_id <> least").select(F.col("least").alias("a"), F.col("class_id").alias("b"))
    labels = checkpointed(class_links(docs, classes, same_id))
    found = class_of.join(labels, F.col("class_id") == F.col("node"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "class_id")).alias("component_id"))
    joined = sketches.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
