r"""Benchmark decontamination by Wu-Manber search for many word windows at once.

Texts become words (A-Z lower-cased) joined by single spaces, and a window becomes the string `` w1 w2 ... w10 ``. The
search looks at a block of bytes: a hashed shift table says how far the next place lies at which a pattern could end;
where that is no distance, the block's suffix bucket names the patterns to test, and comparing bytes confirms them. Many
stretches of a batch advance side by side, each by its own shift. Patterns are searched by classes of length, so that a
short one does not shorten every shift.

Contract
--------
``mark(docs, items)`` gives one row per document row: the id, the number of words, which word spans are hit, and the items
that occur. Null or empty texts have no words; items without words match nothing; repeated items count by their id, and an
item with a null id is left out of ``items``. Other columns are carried along when named in ``keep``.

Items are a stated query set. They are sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text: their number of
blocks comes from their measured size, and documents pass each block in turn without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._batches import bounded_batches, ends_of, lengths, ragged, texts_as_bytes, unused

#: Consecutive words of an item that count as found.
WINDOW = 10
#: Most bytes of item texts that go to the tasks at once.
BLOCK_BYTES = 4 << 20
#: Slots of the shift table (a power of two), and the largest length in bytes of each class of patterns.
SLOTS, CLASSES = 1 << 20, (8, 16, 32, 1 << 40)
#: Bytes of a batch that one scan goes through.
STRETCH = 1024

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = np.full(256, 0x20, np.uint8)
for _i in range(256):
    if chr(_i).isascii() and chr(_i).isalnum() or _i >= 0x80:
        _LOWER[_i] = ord(chr(_i).lower()) if _i < 0x80 else _i


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())  # bytes.lower() changes A-Z only


def windows_of(text: bytes) -> list[bytes]:
    """The windows of an item, as byte strings with a space at each end."""
    words = words_of(text)
    size = min(WINDOW, len(words))
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(len(words) - size + 1)] if words else []


def unaligned(data: np.ndarray, width: int) -> np.ndarray:
    """At each place the next ``width`` (at most 8) bytes as an integer; data needs 8 spare bytes at its end."""
    whole = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return whole if width == 8 else whole & np.uint64((1 << 8 * width) - 1)


def slots_of(blocks: np.ndarray) -> np.ndarray:
    return ((blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


class PatternClass:
    """Shift table and suffix buckets of patterns of similar length."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.patterns, self.numbers = patterns, np.array(numbers)
        self.reach = min(map(len, patterns))  # the part of each pattern that the tables know
        self.block = min(8, self.reach)
        data = np.frombuffer(b"".join(patterns) + bytes(8), np.uint8)
        starts = ends_of(lengths(patterns))[:-1]
        blocks = unaligned(data, self.block)
        furthest = self.reach - self.block + 1
        self.shift = np.full(SLOTS, furthest, np.int16 if furthest < 2**15 else np.int64)
        for at in range(furthest):
            np.minimum.at(self.shift, slots_of(blocks[starts + at]), furthest - 1 - at)
        last = slots_of(blocks[starts + furthest - 1])
        order = np.argsort(last, kind="stable")
        self.bucket_slots, first = np.unique(last[order], return_index=True)
        self.bucket_starts, self.members = np.append(first, len(order)), order
        self.heads = np.frombuffer(b"".join(p[:8].ljust(8, b"\0") for p in patterns), "<u8")
        self.head_masks = np.array([(1 << 8 * min(8, len(p))) - 1 for p in patterns], np.uint64)

    def search(self, data: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(places, pattern numbers) of all occurrences; data is text with 8 spare bytes."""
        n, back = len(text), self.reach - self.block
        if n < self.reach:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = unaligned(data, 8)
        keep = np.uint64((1 << 8 * self.block) - 1)
        at = np.arange(back, n - self.block + 1, STRETCH)  # where the block in question starts
        stop = np.minimum(at + STRETCH, n - self.block + 1)
        found = []
        while len(at):
            slot = slots_of(blocks[at] & keep)
            step = self.shift[slot].astype(np.int64)
            hit = step == 0
            if hit.any():
                found.append((at[hit], slot[hit]))
                step[hit] = 1
            at = at + step
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, slots = (np.concatenate(x) for x in zip(*found))
        bucket = np.searchsorted(self.bucket_slots, slots)
        real = self.bucket_slots[np.minimum(bucket, len(self.bucket_slots) - 1)] == slots
        places, bucket = places[real] - back, bucket[real]
        sizes = self.bucket_starts[bucket + 1] - self.bucket_starts[bucket]
        tested = self.members[ragged(self.bucket_starts[bucket], sizes)]
        places = np.repeat(places, sizes)
        same = (blocks[places] & self.head_masks[tested]) == self.heads[tested]
        places, tested = places[same], tested[same]
        sure = np.fromiter((text.startswith(self.patterns[k], p) for p, k in zip(places.tolist(), tested.tolist())), bool, len(places))
        return places[sure], self.numbers[tested[sure]]


class Patterns:
    """All windows of a block of items, by classes of length."""

    def __init__(self, items: list[tuple]):
        owners: dict[bytes, dict] = {}
        for item, text in items:
            for window in windows_of(text):
                owners.setdefault(window, {})[item] = None
        self.windows = list(owners)
        self.items = [[i for i in owners[w] if i is not None] for w in self.windows]
        self.n_words = np.array([w.count(b" ") - 1 for w in self.windows], np.int64)
        self.classes, low = [], 0
        for high in CLASSES:
            these = [i for i, w in enumerate(self.windows) if low < len(w) <= high]
            if these:
                self.classes.append(PatternClass([self.windows[i] for i in these], these))
            low = high


def plain(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts as space-separated words, each text between line feeds; and where each text starts."""
    raw = np.frombuffer(b" \n " + b" \n ".join(texts) + b" \n ", np.uint8)
    data = _LOWER[raw]
    fences = ends_of(lengths(texts) + 3) + 1
    data[fences] = 0x0A
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    return data[keep].tobytes(), (np.cumsum(keep) - 1)[fences]


def found_in(texts: list[bytes], patterns: Patterns) -> tuple[np.ndarray, list, list]:
    """Number of words of each text; its hit word spans [(start, end)], merged; the items whose windows occur, unordered."""
    text, fences = plain(texts)
    data = np.frombuffer(text + bytes(8), np.uint8)
    body = data[:-8]
    is_start = np.zeros(len(body) + 1, bool)
    is_start[1:-1] = (body[1:] > 0x20) & (body[:-1] <= 0x20)
    number = np.cumsum(is_start)  # words up to and with each place
    upto = number[fences]
    n_words = np.diff(upto)
    spans, items = [[] for _ in texts], [set() for _ in texts]
    places, which = [], []
    for one in patterns.classes:
        p, k = one.search(data, text)
        places.append(p)
        which.append(k)
    if places and sum(map(len, places)):
        place, kind = np.concatenate(places), np.concatenate(which)
        owner = np.searchsorted(fences, place, side="right") - 1
        first = number[place + 1] - 1 - upto[owner]  # a window starts with the space before its first word
        order = np.lexsort((first, owner))
        for d, a, k in zip(owner[order].tolist(), first[order].tolist(), kind[order].tolist()):
            items[d].update(patterns.items[k])
            b = a + int(patterns.n_words[k])
            own = spans[d]
            if own and a <= own[-1][1]:
                own[-1][1] = max(own[-1][1], b)
            else:
                own.append([a, b])
    return n_words, spans, items


def united(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of about BLOCK_BYTES of text at most (a larger item is a block of its own); the driver holds one at a time."""
    spark = items.sparkSession
    chosen = items.select(F.col("item_id").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = chosen.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-2 * size // BLOCK_BYTES))
    part = lambda rows: [(r["item"], r["text"].encode()) for r in rows.toArrow().to_pylist()]
    for b in range(n):
        yield part(chosen.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) if n > 1 else chosen)


def mark(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("n_words", "hit_spans", "item_ids")) -> DataFrame:
    """The columns in ``keep``, and under ``names`` the number of words, the merged spans of hit words, and the ids of items with occurring windows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = items.schema["item_id"].dataType
    spans_type, ids_type = pa.list_(pa.list_(pa.int64())), pa.list_(to_arrow_type(kind))
    (own_text,) = unused([*keep, *names], "text") if "text" not in keep else ("text",)
    carried = [*keep, *([] if "text" in keep else [own_text])]
    text = carried.index(own_text)
    base = docs.select(*keep, *([] if "text" in keep else [F.col("text").alias(own_text)])).select(
        *carried, F.lit(0).cast("long").alias(names[0]), F.lit(None).cast("array<array<bigint>>").alias(names[1]), F.lit(None).cast(f"array<{kind.simpleString()}>").alias(names[2])
    )
    n, schema = len(carried), base.schema
    for block in item_blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            patterns = Patterns(sent.value)
            for batch in batches:
                n_words, spans, found = found_in(texts_as_bytes(batch, text), patterns)
                before, known = batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist()
                spans = [united([*(a or []), *b]) for a, b in zip(before, spans)]
                ids = [sorted({*(a or []), *b}) for a, b in zip(known, found)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(ids, ids_type)], names=[*carried, *names])

        base = base.mapInArrow(run, schema)
    return base.select(*keep, *names)


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: words, hit words, items found, a digest of their ids, and whether any word is hit."""
    marked = mark(docs, items)
    as_text = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return marked.select("doc_id", "n_words", n_hit(F.col("hit_spans")).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(as_text, 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


#: The same rows in DuckDB's SQL.
CONTAMINATION_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes)),
hits AS (SELECT g.doc_id, g.i, g.k, b.item_id FROM grams g JOIN windows b ON g.k = b.k AND g.win = b.win),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
