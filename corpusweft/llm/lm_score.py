"""Language-model scores: prediction by partial matching over bytes, beside a unigram model over words.

The trie of byte contexts (up to ``ORDER`` bytes) holds all n-grams of all training texts, so it grows with the corpus and
no task holds it. Texts are worked on in chunks of ``CHUNK`` bytes: a chunk hands on its distinct n-grams with their counts,
dealt into buckets by the last ``LOW + 1`` bytes of the context. All longer contexts that end so are in the same bucket, and
the n-grams of shorter ones, of which there are 256 ** (LOW + 1) an order at most, are sent to every task. So each bucket
works out the chances of its chunks' n-grams by itself, and they go back to the chunk. A chunk's distinct words are dealt
into buckets of their own and come back with their counts, so a frequent word is one entry a chunk and no key is hot.

The longest contexts count how often a symbol followed. A shorter context counts in how many different longer ones it did,
since only those that a longer context could not code come to it. Each distinct symbol gives ``DISCOUNT`` of a count to the
escape; after it, the next shorter context codes the symbol without those that the longer one has ruled out.

Contract
--------
``scored(docs, learnable)`` gives one row per input row. A null or empty text has its end alone. Rows with null ids and
repeated rows are scored, and learned from, like any other. Only id and text are read. Logarithms are to the base 10.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import Numbers, bounded_batches, checkpointed, ends_of, lengths, mix64, texts_as_bytes
from .language_id import remainder

ORDER = 5
#: What each distinct symbol of a context gives to the escape.
DISCOUNT = 0.3
#: Contexts up to so many bytes are sent to all tasks; longer ones stay in the bucket of their last LOW + 1 bytes.
LOW = 2
#: Bytes of input for which there is a bucket, the least number of buckets, and the most tasks that share them out.
BUCKET_BYTES, LEAST_BUCKETS, MOST_TASKS = 16 << 20, 4, 4000
#: Bytes of text of a chunk, whose n-grams are counted and looked up once.
CHUNK = 16 << 20
#: Kinds of rows: a chunk's texts, its short n-grams, its words and its n-grams.
TEXTS, LOWER, WORDS, GRAMS = range(4)
#: Bytes of text that a task works on at once, and places whose n-grams are sorted together with their places (16 bits).
AT_ONCE, PLACES = 1 << 20, 1 << 16
#: Stands before and after each text; it never occurs in UTF-8.
EDGE = 0xFF
#: The end of a text as a token; no word is empty.
END = b""


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, then the end."""
    return [*text.lower().split(), END]


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of ORDER + 1 bytes, oldest byte lowest, for each byte and each end; where each text's begin)."""
    edge = bytes([EDGE])
    data = np.frombuffer(edge * ORDER + (edge + edge * ORDER).join(texts) + edge + bytes(8), np.uint8)
    sizes = lengths(texts) + 1
    windows = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    begins = ends_of(sizes)
    shift = np.repeat(np.arange(len(texts)) * ORDER, sizes)
    return windows[np.arange(begins[-1]) + shift] & np.uint64((1 << 8 * (ORDER + 1)) - 1), begins


class Index:
    """Finds places of 64-bit keys through hashed slots."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, min(22, int(np.ceil(np.log2(len(keys) + 1))) + 1))
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.places = order.astype(np.int32)
        self.keys = np.append(keys[order], np.uint64(2**64 - 1))
        counts = np.bincount(slot, minlength=1 << self.bits)
        self.first, self.most = ends_of(counts).astype(np.int32), int(counts.max()) if len(keys) else 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the array that was given, -1 where it is not in it."""
        slot = self._slot(keys)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(at < end)
        for _ in range(self.most):
            here = at[left]
            hit = self.keys[here] == keys[left]
            out[left[hit]] = self.places[here[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
            if not len(left):
                break
        return out


@dataclass
class Level:
    """Nodes with contexts of one length."""

    grams: np.ndarray  # symbol in the highest byte
    log_count: np.ndarray  # less the discount
    known: np.ndarray  # log chance of a gram whose context is the first
    contexts: np.ndarray
    log_escape: np.ndarray  # of a context, when it is the first
    log_rest_after: np.ndarray  # what the next shorter context has left, after an escape from this one
    log_escape_after: np.ndarray


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def _some(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in groups of about AT_ONCE bytes, to keep arrays over them small."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text) + 1
        if size >= AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


def shortened(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams without their oldest byte, in order, and how many different ones each comes from."""
    shorter, n = np.unique(grams >> np.uint64(8), return_counts=True)
    return shorter, n


def build_levels(counts: list[tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    """The levels from (ascending n-grams, counts) of each order, 0 first."""
    levels: list[Level] = []
    before = None  # contexts, totals, distinct, grams, counts of the next shorter order
    for order, (grams, n) in enumerate(counts):
        n = n.astype(np.float64)
        contexts, inverse = np.unique(grams & np.uint64((1 << 8 * order) - 1), return_inverse=True)
        total, distinct = np.bincount(inverse, n, len(contexts)), np.bincount(inverse, minlength=len(contexts)).astype(np.float64)
        rest_after, escape_after = np.ones(len(contexts)), np.ones(len(contexts))
        if before is not None:
            b_contexts, b_total, b_distinct, b_grams, b_n = before
            ruled_out = np.bincount(inverse, b_n[np.searchsorted(b_grams, grams >> np.uint64(8))], len(contexts))
            shorter = np.searchsorted(b_contexts, contexts >> np.uint64(8))
            new, rest = b_distinct[shorter] - distinct, b_total[shorter] - ruled_out
            rest_after = np.maximum(rest, 1e-300)
            escape_after = np.where(new > 0, DISCOUNT * new / rest_after, 1.0)
        log_count = _log(n - DISCOUNT)
        known = log_count - _log(total)[inverse]
        small = (x.astype(np.float32) for x in (_log(DISCOUNT * distinct / total), _log(rest_after), _log(escape_after)))
        levels.append(Level(grams, log_count.astype(np.float32), known.astype(np.float32), contexts, *small))
        before = contexts, total, distinct, grams, n
    return levels


class Trie:
    """Looks up code lengths of n-grams."""

    def __init__(self, levels: list[Level]):
        self.levels = levels
        self.grams = [Index(level.grams) for level in levels]
        self.contexts = [Index(level.contexts) for level in levels]
        self.known = levels[-1].known
        self.last = -math.log10(256 - len(levels[0].grams)) if len(levels[0].grams) < 256 else -math.log10(256)

    def log_chance(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the chance of each n-gram's last byte after the others."""
        at = self.grams[ORDER].find(grams)
        out = self.known[np.maximum(at, 0)] if len(self.known) else np.zeros(len(grams), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            distinct, inverse = np.unique(grams[miss], return_inverse=True)
            out[miss] = self._walk(distinct)[inverse]
        return out

    def _walk(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        open_ones = np.arange(len(grams))
        longer = np.full(len(grams), -1)  # place of the context that was escaped from
        for order in range(ORDER, -1, -1):
            if not len(open_ones):
                return out
            level = self.levels[order]
            own = grams[open_ones] >> np.uint64(8 * (ORDER - order))
            context = self.contexts[order].find(own & np.uint64((1 << 8 * order) - 1))
            gram = self.grams[order].find(own)
            up = longer[open_ones]
            first, after = (context >= 0) & (up < 0), up >= 0
            escape = np.zeros(len(own))
            escape[first] = level.log_escape[context[first]]
            seen = gram >= 0
            won = np.zeros(len(own))
            at = seen & first
            won[at] = level.known[gram[at]]
            if after.any():
                upper = self.levels[order + 1]
                escape[after] = upper.log_escape_after[up[after]]
                at = seen & after
                won[at] = level.log_count[gram[at]] - upper.log_rest_after[up[at]]
            out[open_ones[seen]] += won[seen]
            out[open_ones[~seen]] += escape[~seen]
            longer[open_ones] = np.where(context >= 0, context, -1)
            open_ones = open_ones[~seen]
        out[open_ones] += self.last
        return out


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """By the last LOW + 1 bytes of the context, so that a bucket holds whole contexts of more than LOW bytes."""
    return (mix64(grams >> np.uint64(8 * (ORDER - LOW - 1)) & np.uint64((1 << 8 * (LOW + 1)) - 1)) % np.uint64(buckets)).astype(np.int64)


def summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, with their counts added up."""
    if not len(grams):
        return grams, n
    by = np.argsort(grams)
    grams, n = grams[by], n[by]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    return grams[first], np.add.reduceat(n, first)


def squeezed(raw: bytes) -> bytes:
    """Compressed, with the size in front."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def released(data: bytes) -> bytes:
    """What was squeezed."""
    return pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(grams: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending n-grams and their counts (or other numbers of up to 63 bits): planes of bytes of the steps and counts, compressed."""
    wide = max(1, (int(n.max()).bit_length() + 7) // 8) if len(n) else 1
    planes = [x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:w].tobytes() for x, w in ((np.diff(grams, prepend=np.uint64(0)), ORDER + 1), (n, wide))]
    return squeezed(b"".join(planes))


def unpacked(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = released(data)
    planes = np.frombuffer(raw, np.uint8).reshape(-1, size) if size else np.zeros((ORDER + 2, 0), np.uint8)
    both = np.zeros((2, size, 8), np.uint8)
    both[0, :, : ORDER + 1], both[1, :, : len(planes) - ORDER - 1] = planes[: ORDER + 1].T, planes[ORDER + 1 :].T
    steps, n = both.view("<u8")[..., 0]
    return np.cumsum(steps, dtype=np.uint64), n.astype(np.int64)


def packed_words(words: list[bytes], n: np.ndarray) -> bytes:
    """Words and their counts."""
    return squeezed(n.astype("<i8").tobytes() + b" ".join(words))


def unpacked_words(raw: bytes, many: int) -> tuple[list[bytes], np.ndarray]:
    return raw[8 * many :].split(b" "), np.frombuffer(raw, "<i8", many)


class ChunkWords:
    """Numbers a chunk's distinct tokens and counts those of texts to learn from."""

    def __init__(self) -> None:
        self.numbers, self.n = Numbers(), np.zeros(0, np.int64)

    def add(self, texts: list[bytes], learned: np.ndarray) -> None:
        split = [tokens(t) for t in texts]
        sizes = lengths(split)
        ids = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        more = np.bincount(ids[np.repeat(learned, sizes)], minlength=len(self.numbers))
        more[: len(self.n)] += self.n
        self.n = more


class ChunkGrams:
    """Distinct n-grams of a chunk, with their counts in texts to learn from."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, texts: list[bytes], learned: np.ndarray) -> int:
        grams, begins = padded(texts)
        marked, times = np.unique(grams << np.uint64(1) | np.repeat(learned, np.diff(begins)), return_counts=True)
        self.parts.append((marked >> np.uint64(1), times * (marked & np.uint64(1)).astype(np.int64)))
        if len(self.parts) >= 4:
            self.parts = [self.all()]
        return int(begins[-1])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*map(np.concatenate, zip(*self.parts)))


def gathered(docs: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, chunk, n, data, ids): of each chunk of texts its ids and texts, its distinct n-grams of order LOW + 1, and for each bucket its words and its n-grams of the longest order.

    Words and n-grams have their counts in texts to learn from; n is the number of what was packed (of bytes for texts).
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["kind", "bucket", "chunk", "n", "data", "ids"]

    def rows(kind: int, chunk: int, buckets: list, n: list, data: list[bytes], ids: pa.Array) -> pa.RecordBatch:
        numbers = ([kind] * len(data), buckets, [chunk] * len(data), n)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(data, pa.binary()), ids], names=names)

    def dealt(bucket: np.ndarray) -> tuple[np.ndarray, list[int], list[slice]]:
        """(order, buckets that are not empty, where each lies in that order)."""
        ends = ends_of(np.bincount(bucket, minlength=buckets))
        held = np.flatnonzero(np.diff(ends)).tolist()
        return np.argsort(bucket, kind="stable"), held, [slice(ends[b], ends[b + 1]) for b in held]

    def chunk_rows(chunk: int, ids: list[pa.Array], texts: list[bytes], counted: ChunkGrams, words: ChunkWords) -> Iterator[pa.RecordBatch]:
        own = pa.concat_arrays(ids)
        none = lambda n: pa.nulls(n, pa.list_(own.type))
        raw = lengths(texts).tobytes() + b"".join(texts)
        yield rows(TEXTS, chunk, [0], [len(raw)], [squeezed(raw)], pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
        del raw
        listed = list(words.numbers)
        by, held, spans = dealt((np.fromiter(map(xxhash.xxh3_64_intdigest, listed), np.uint64, len(listed)) % np.uint64(buckets)).astype(np.int64))
        ordered = [listed[i] for i in by.tolist()]
        yield rows(WORDS, chunk, held, [s.stop - s.start for s in spans], [packed_words(ordered[s], words.n[by[s]]) for s in spans], none(len(held)))
        grams, n = counted.all()
        low = np.unique(grams[n > 0] >> np.uint64(8 * (ORDER - LOW - 1)))
        yield rows(LOWER, chunk, [0], [len(low)], [packed(low, np.ones(len(low), np.int64))], none(1))
        by, held, spans = dealt(bucket_of(grams, buckets))
        grams, n = grams[by], n[by]
        yield rows(GRAMS, chunk, held, [s.stop - s.start for s in spans], [packed(grams[s], n[s]) for s in spans], none(len(held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, chunk, grams, words = [], [], 0, TaskContext.get().partitionId(), ChunkGrams(), ChunkWords()
        for batch in batches:
            at, learn = 0, np.array(batch.column(2).to_pylist(), bool)
            for group in _some(texts_as_bytes(batch)):
                own = learn[at : at + len(group)]
                words.add(group, own)
                size += grams.add(group, own)
                ids.append(batch.column(0).slice(at, len(group)))
                texts += group
                at += len(group)
                if size >= CHUNK:
                    yield from chunk_rows(chunk, ids, texts, grams, words)
                    ids, texts, size, chunk, grams, words = [], [], 0, chunk + (1 << 32), ChunkGrams(), ChunkWords()
        if texts:
            yield from chunk_rows(chunk, ids, texts, grams, words)

    return docs.select("doc_id", "text", "learn").mapInArrow(run, f"kind long, bucket long, chunk long, n long, data binary, ids array<{kind}>")


def by_bucket(found: DataFrame, kinds: list[int], buckets: int) -> DataFrame:
    """(kind, bucket, chunk, data, n) with the rows of a bucket side by side."""
    rows = found.filter(F.col("kind").isin(kinds)).select("kind", "bucket", "chunk", "data", "n")
    tasks = min(len(kinds) * buckets, MOST_TASKS)
    return rows.repartitionById(tasks, ((F.col("bucket") * len(kinds) + F.col("kind") % len(kinds)) % tasks).cast("int")).sortWithinPartitions("kind", "bucket")


def bucket_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
    """(kind, bucket, rows) of batches of what ``by_bucket`` gives."""
    last, own = None, []
    for batch in batches:
        for kind, bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (kind, bucket) != last and own:
                yield *last, own
                own = []
            last = kind, bucket
            own.append(tuple(row))
    if own:
        yield *last, own


def counted_words(own: list[tuple[int, bytes, int]]) -> dict[bytes, int]:
    total: dict[bytes, int] = {}
    for _, data, many in own:
        words, n = unpacked_words(released(data), many)
        for w, c in zip(words, n.tolist()):
            total[w] = total.get(w, 0) + c
    return total


def word_totals(found: DataFrame, buckets: int) -> tuple[int, int]:
    """(number of training tokens, number of distinct ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, own in bucket_runs(batches):
            n = np.fromiter(counted_words(own).values(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])], names=["n", "distinct"])

    total, distinct = by_bucket(found, [WORDS], buckets).mapInArrow(run, "n long, distinct long").agg(F.sum("n"), F.sum("distinct")).first()
    return total or 0, distinct or 0


def lower_counts(found: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of orders up to LOW, and in how many longer ones each occurs: 256 ** (LOW + 1) of an order at most, however large the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros(0, np.uint64)
        for batch in batches:
            for data, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = np.union1d(grams, unpacked(data, many)[0])
        yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64))], names=["gram"])

    rows = found.filter(F.col("kind") == LOWER).select("data", "n").mapInArrow(run, "gram long")
    table = rows.distinct().groupBy(F.shiftright("gram", 8).alias("gram")).agg(F.count("*").alias("n")).toArrow()
    out = [summed(table["gram"].to_numpy().astype(np.uint64), table["n"].to_numpy())]
    for _ in range(LOW):
        out.append(shortened(out[-1][0]))
    return out[::-1]


def answers(found: DataFrame, lower: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """(kind, bucket, chunk, n, data): of each chunk and bucket its words with their counts, or its n-grams with their log chances."""
    sent = found.sparkSession.sparkContext.broadcast(lower)

    def of_words(own: list[tuple[int, bytes, int]]) -> list[bytes]:
        total = counted_words(own)
        out = []
        for _, data, many in own:
            words, _ = unpacked_words(released(data), many)
            out.append(packed_words(words, np.fromiter(map(total.__getitem__, words), np.int64, many)))
        return out

    def of_grams(own: list[tuple[int, bytes, int]]) -> list[bytes]:
        parts = [unpacked(data, many) for _, data, many in own]
        grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
        if len(sent.value[0][0]):
            higher = [(grams[n > 0], n[n > 0])]
            for _ in range(ORDER - LOW - 1):
                higher.append(shortened(higher[-1][0]))
            chance = Trie(build_levels([*sent.value, *higher[::-1]])).log_chance(grams).astype(np.float32)
        else:
            chance = np.full(len(grams), -math.log10(256), np.float32)
        ends = ends_of(lengths([g for g, _ in parts]))
        return [packed(g, chance[inverse[a:b]].view(np.uint32).astype(np.int64)) for (g, _), a, b in zip(parts, ends, ends[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, bucket, own in bucket_runs(batches):
            data = of_words(own) if kind == WORDS else of_grams(own)
            columns = [kind] * len(own), [bucket] * len(own), [c for c, *_ in own], [many for *_, many in own]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(data, pa.binary())], names=["kind", "bucket", "chunk", "n", "data"])

    return by_bucket(found, [WORDS, GRAMS], buckets).mapInArrow(run, "kind long, bucket long, chunk long, n long, data binary")


def summed_chances(texts: list[bytes], grams: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """The sum of each text's log chances; grams: ascending, with all of the texts' own."""
    own, begins = padded(texts)
    out = np.empty(len(own))
    for a in range(0, len(own), PLACES):
        some = own[a : a + PLACES]
        marked = np.sort(some << np.uint64(16) | np.arange(len(some), dtype=np.uint64))  # an n-gram has 48 bits
        here = marked >> np.uint64(16)
        first = np.append(True, here[1:] != here[:-1])
        found = chance[np.searchsorted(grams, here[first])]
        out[a + (marked & np.uint64(PLACES - 1)).astype(np.int64)] = found[np.cumsum(first) - 1]
    return np.add.reduceat(out, begins[:-1])


def scored(docs: DataFrame, learnable: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select("doc_id", "text", F.coalesce(learnable, F.lit(False)).alias("learn"))
    buckets = max(LEAST_BUCKETS, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)  # in proportion to the input, so that a bucket does not grow with it
    counts = checkpointed(gathered(texts, buckets))
    total, distinct = word_totals(counts, buckets)
    divisor = math.log10(total + 0.1 * (distinct + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def chunk_scores(ids: pa.Array, raw: bytes, words: list[tuple], found: list[tuple]) -> Iterator[pa.RecordBatch]:
        ends = ends_of(np.frombuffer(raw, np.int64, len(ids))) + 8 * len(ids)
        numbers, n = Numbers(), np.concatenate([n for _, n in words])
        for w in chain.from_iterable(w for w, _ in words):
            numbers[w]
        logs = np.log10(n + 0.1)
        grams, chance = (np.concatenate(x) for x in zip(*found))
        by = np.argsort(grams)
        grams, chance = grams[by], chance[by]
        at = 0
        for group in _some([raw[a:b] for a, b in zip(ends, ends[1:])]):
            split = [tokens(t) for t in group]
            sizes = lengths(split)
            which = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            first = ends_of(sizes)[:-1]
            columns = sizes, np.add.reduceat((n > 0)[which].astype(np.int64), first), np.add.reduceat(logs[which], first), summed_chances(group, grams, chance)
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(group)), *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "sum", "score"])
            at += len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for i, (what, many, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "n", "data")))):
                if what == TEXTS:
                    if now:
                        yield from chunk_scores(*now)
                    now = batch.column("ids")[i].values, released(data), [], []
                elif what == WORDS:
                    now[2].append(unpacked_words(released(data), many))
                else:
                    grams, bits = unpacked(data, many)
                    now[3].append((grams, bits.astype(np.uint32).view(np.float32)))
        if now:
            yield from chunk_scores(*now)

    own = counts.filter(F.col("kind") == TEXTS).select("kind", "bucket", "chunk", "n", "data", "ids")
    tasks = min(max(1, own.count()), MOST_TASKS)
    answered = answers(counts, lower_counts(counts), buckets).select("kind", "bucket", "chunk", "n", "data", F.lit(None).cast(f"array<{kind}>").alias("ids"))
    task = (F.col("chunk") % (1 << 32) + F.shiftright("chunk", 32) * 7) % tasks
    together = own.union(answered).repartitionById(tasks, task.cast("int")).sortWithinPartitions("chunk", "kind", "bucket")
    first = together.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, sum double, score double")
    return first.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("sum") - F.col("n_tokens") * F.lit(divisor)).alias("base_score"), "score")


def corpus_scores(docs: DataFrame) -> DataFrame:
    """Scores of all texts, learned from rows whose remainder modulo 10 is not 0."""
    found = scored(docs, remainder(10) != 0)
    return found.select("doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
