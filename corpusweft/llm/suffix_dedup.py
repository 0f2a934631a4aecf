"""Removal of long repeated byte strings by a suffix array over content-chosen suffixes.

Only strings of ``LENGTH`` bytes matter, so not every suffix is sorted. Each string is represented by the suffix at its
anchor: the leftmost place, among its first ``WINDOW``, whose next eight bytes hash lowest. Equal strings have equal anchors,
and neighbouring strings mostly share one, which leaves about two suffixes in ``WINDOW`` bytes.

1. A suffix whose first ``LEAD`` bytes occur nowhere else cannot matter: fingerprints of the lead are counted. Where the whole
   stretch around an anchor (all strings that it represents) occurs twice, all of those are repeated, without reading them again.
2. The suffixes that are left, one for each different stretch, are range-partitioned by their leading bytes; Spark samples
   the splitters, and equal leads never lie across a boundary. Each bucket sorts the strings around its anchors by multikey
   quicksort, eight bytes at a time, dropping what has become unique; what stays equal to the end is repeated.
3. Repeated strings are united to byte ranges and cut out of the texts.

Contract
--------
``remove_repeats(docs)`` gives one row per input row; only id and text are read, and null ids or repeated rows are no
special case (a repeated row repeats every string of its text). A null text counts as empty; texts under LENGTH bytes keep
all. Strings are judged on the input, within and across documents, and never run across two documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._batches import bounded_batches, checkpointed, ends_of, lengths, mix64, ragged, texts_as_bytes, unused

LENGTH = 400
#: Places among which a string's anchor is chosen, and bytes after the anchor that all its strings share.
WINDOW, LEAD = 200, 200
#: Strings that a bucket sorts at once.
AT_ONCE = 400_000
#: From so many different stretches around one lead on, they are dealt out by what they share further on.
HOT_LEAD = 20_000
SLICE = 40

_WORDS = (LENGTH + WINDOW) // 8 + 1
_SALTS = np.random.default_rng(400).integers(0, 2**63, 2 * _WORDS + 2, dtype=np.uint64)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def fingerprint(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A hash of each byte range; words: the eight bytes at each place."""
    out = mix64(sizes.astype(np.uint64) + salts[-1])
    for i in range(int(-(-sizes.max() // 8)) if len(sizes) else 0):
        rest = sizes - 8 * i
        live = np.flatnonzero(rest > 0)
        out[live] += mix64((words[starts[live] + 8 * i] & _MASKS[np.minimum(rest[live], 8)]) ^ salts[i])
    return mix64(out)


def anchors(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor, first string, last string) in joined texts; places count from the start of everything."""
    n = len(words)
    low = (mix64(words ^ np.uint64(0x5BD1E995)) >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= WINDOW:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - span)], low[WINDOW - span :])
    counts = np.maximum(sizes - LENGTH + 1, 0)
    strings = ragged(starts, counts)
    text = np.repeat(np.arange(len(sizes)), counts)
    place = (low[strings] & np.uint64(2**32 - 1)).astype(np.int64)
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(new[1:], len(strings)) - 1
    return text[new], place[new], strings[new], strings[last[: len(new)]]


def words_at(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The eight bytes at each place of the joined texts, and where each text starts."""
    data = np.frombuffer(b"".join(texts) + bytes(LENGTH + 2 * WINDOW + 8), np.uint8)
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)), ends_of(lengths(texts))


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of ranges that touch, for each owner."""
    if not len(owner):
        return owner, start, end
    by = np.lexsort((start, owner))
    owner, start, end = owner[by], start[by], end[by]
    reach = np.maximum.accumulate(end + owner * (1 << 40)) - owner * (1 << 40)  # owners rise, so an earlier one never reaches into the next
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], start[first], reach[last]


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def suffixes(keyed: DataFrame) -> DataFrame:
    """(lead, whole, times, key, anchor, first, last, known): one row for each anchor of each different text of a task.

    Stretches that a text repeats within itself are united to ranges at once: rows that are ``known``, with a range of strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, texts = texts_as_bytes(batch, "key"), texts_as_bytes(batch)
            if len(seen) > 100_000:  # only a saving: copies are counted by their key anyhow
                seen.clear()
            fresh = []
            for i, key in enumerate(keys):
                if len(texts[i]) >= LENGTH and key not in seen:  # a copy's suffixes say nothing new; copies are counted by their key
                    seen.add(key)
                    fresh.append(i)
            if not fresh:
                continue
            own = [texts[i] for i in fresh]
            words, begins = words_at(own)
            text, anchor, first, last = anchors(words, begins[:-1], lengths(own))
            lead = fingerprint(words, anchor, np.full(len(anchor), LEAD), _SALTS)
            whole = fingerprint(words, first, last - first + LENGTH, _SALTS[_WORDS:]) ^ mix64((anchor - first).astype(np.uint64))
            by = np.lexsort((whole, lead, text))
            same = (np.diff(text[by]) == 0) & (np.diff(lead[by].view(np.int64)) == 0) & (np.diff(whole[by].view(np.int64)) == 0)
            again = np.zeros(len(by), bool)
            again[by[1:][same]] = again[by[:-1][same]] = True
            head = np.ones(len(by), bool)
            head[by[1:][same]] = False
            t, a, b = merged(text[again], first[again], last[again] + 1)
            n, m = int(head.sum()), len(t)
            owner = np.concatenate([text[head], t])
            base = begins[owner]
            column = lambda x, y: pa.array(np.concatenate([x, y]))
            yield pa.RecordBatch.from_arrays(
                [
                    column(lead[head].view(np.int64), mix64(np.arange(m, dtype=np.uint64) ^ np.uint64(int.from_bytes(keys[fresh[0]][:8], "big"))).view(np.int64)),
                    column(whole[head].view(np.int64), np.zeros(m, np.int64)),
                    column(again[head].astype(np.int32) + np.int32(1), np.ones(m, np.int32)),
                    pa.array([keys[fresh[i]] for i in owner.tolist()], pa.binary()),
                    pa.array(np.concatenate([anchor[head], a]) - base),
                    pa.array(np.concatenate([first[head], a]) - base),
                    pa.array(np.concatenate([last[head], b - 1]) - base),
                    pa.array(np.arange(n + m) >= n),
                ],
                names=["lead", "whole", "times", "key", "anchor", "first", "last", "known"],
            )

    return keyed.mapInArrow(run, "lead long, whole long, times int, key binary, anchor long, first long, last long, known boolean")


def judged(rows: DataFrame) -> DataFrame:
    """What counting says of each anchor whose lead is not unique: repeated as a whole, or open, or needed as a witness."""
    by_lead, by_whole = Window.partitionBy("lead"), Window.partitionBy("lead", "whole")
    counted = rows.repartition("lead").select(
        "*",
        F.sum("times").over(by_whole).alias("n_whole"),
        F.row_number().over(by_whole.orderBy("key", "anchor")).alias("rank"),
        F.sum("times").over(by_lead).alias("n_lead"),
        F.min("whole").over(by_lead).alias("low"),
        F.max("whole").over(by_lead).alias("high"),
        F.count("*").over(by_lead).alias("n_rows"),
    ).filter(F.col("known") | (F.col("n_lead") > 1))
    mixed = ~F.col("known") & (F.col("low") != F.col("high"))
    repeated = F.col("known") | (F.col("n_whole") > 1)
    return counted.select("key", "anchor", "first", "last", "lead", repeated.alias("repeated"), (mixed & (~repeated | (F.col("rank") == 1))).alias("sorted"), (F.col("n_rows") > HOT_LEAD).alias("hot"))


def stretches(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """The bytes around each chosen anchor: (bytes_1, lead, part, key, first, skip, strings, open, data)."""
    lists = chosen.groupBy("key").agg(F.collect_list(F.struct("lead", "anchor", "first", "last", F.col("repeated").alias("settled"), "hot")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for key, text, places in zip(texts_as_bytes(batch, "key"), texts_as_bytes(batch), batch.column(2).to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                for p in places:
                    first, last, anchor = p["first"], p["last"], p["anchor"]
                    lead = int.from_bytes(text[anchor : anchor + 7], "big")
                    if not p["hot"]:
                        out.append((lead, p["lead"], 0, key, first, anchor - first, last - first + 1, not p["settled"], text[first : last + LENGTH]))
                        continue
                    for number in range((anchor - last) // SLICE, (anchor - first) // SLICE + 1):
                        # a slice of offsets and what all its strings share: equal strings agree in both
                        near = anchor - number * SLICE
                        a, b = max(first, near - SLICE + 1), min(last, near)
                        part = int.from_bytes(hashlib.blake2b(bytes([number]) + text[near : near - SLICE + 1 + LENGTH], digest_size=7).digest(), "big")
                        out.append((lead, p["lead"], part, key, a, anchor - a, b - a + 1, not p["settled"], text[a : b + LENGTH]))
            columns = list(zip(*out)) or [()] * 9
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bytes_1", "lead", "part", "key", "first", "skip", "strings", "open", "data"])

    joined = keyed.join(lists, "key").select("key", "text", "places")
    return joined.mapInArrow(run, "bytes_1 long, lead long, part long, key binary, first long, skip long, strings long, open boolean, data binary")


def equal_strings(words: np.ndarray, group: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which strings of LENGTH bytes equal another one of their group: multikey quicksort by eight-byte keys."""
    left = np.arange(len(group))
    for i in range(0, LENGTH, 8):
        if not len(left):
            break
        key = words[start[left] + i]
        by = np.lexsort((key, group))
        left, group, key = left[by], group[by], key[by]
        edge = np.ones(len(left) + 1, bool)
        edge[1:-1] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        alone = edge[1:] & edge[:-1]
        group = np.cumsum(edge[:-1])[~alone]
        left = left[~alone]
    out = np.zeros(len(start), bool)
    out[left] = True
    return out


def sorted_buckets(around: DataFrame, partitions: int) -> DataFrame:
    """(key, start, end): ranges of repeated strings that sorting the buckets finds."""

    def ranges(run: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Of whole runs of equal (lead, part)."""
        data = [r[8] for r in run]
        words, begins = words_at(data)
        runs = np.cumsum([0] + [a[1:3] != b[1:3] for a, b in zip(run[1:], run)])
        skip, strings, is_open = (np.array([r[k] for r in run]) for k in (5, 6, 7))
        low = 0  # offsets from the anchor: strings of different offsets are never equal, so some offsets at a time will do
        offsets = np.sort(ragged(skip - strings + 1, strings))
        while low <= int(skip.max()):
            high = offsets[min(len(offsets) - 1, np.searchsorted(offsets, low) + AT_ONCE)]
            high = max(int(high), low)
            near, far = np.maximum(low, skip - strings + 1), np.minimum(high, skip)
            n = np.maximum(far - near + 1, 0)
            row = np.repeat(np.arange(len(run)), n)
            offset = ragged(near, n)
            start = begins[row] + skip[row] - offset
            same = equal_strings(words, runs[row] * (WINDOW + 1) + offset, start) & is_open[row]
            if same.any():
                at = (start - begins[row])[same]
                owner, a, b = merged(row[same], at, at + LENGTH)
                first = np.array([run[i][4] for i in owner.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([run[i][3] for i in owner.tolist()], pa.binary()), pa.array(first + a), pa.array(first + b)], names=["key", "start", "end"])
            low = high + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(9))))
            rows = open_run + rows
            cut = len(rows)
            while cut and rows[cut - 1][1:3] == rows[-1][1:3]:
                cut -= 1
            if cut:
                yield from ranges(rows[:cut])
            open_run = rows[cut:]
        if open_run:
            yield from ranges(open_run)

    dealt = around.repartitionByRange(partitions, "bytes_1", "lead", "part").sortWithinPartitions("bytes_1", "lead", "part")
    return dealt.mapInArrow(run, "key binary, start long, end long")


def repeats(docs: DataFrame) -> DataFrame:
    """(key, ranges): for each text with repeated strings the byte ranges [start, end) that they cover, united."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = docs.select(text_key(F.col("text")).alias("key"), "text").filter(F.octet_length("text") >= LENGTH)
    found = checkpointed(judged(suffixes(keyed)))
    around = checkpointed(stretches(keyed, found.filter("sorted")))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_sort = sorted_buckets(around, partitions)
    by_count = found.filter("repeated").select("key", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))
    copies = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("end")).filter("n > 1").select("key", F.lit(0).cast("long").alias("start"), "end")
    return by_count.union(by_sort).union(copies).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def united(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for r in ranges or []:
        if out and r["start"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], r["end"])
        else:
            out.append((r["start"], r["end"]))
    return out


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = ("kept", "n_bytes", "n_removed", "n_spans"), whole_characters: bool = False) -> DataFrame:
    """The columns in ``keep``, and under ``names`` the remaining bytes and the numbers of bytes, removed bytes and removed runs.

    whole_characters: what remains of a character that a cut splits goes too, so that the remaining bytes are UTF-8.
    """
    bounded_batches(docs.sparkSession)
    own_text, own_key, of, own_ranges = unused([*keep, *names], "text", "key", "of", "ranges")
    schema = docs.select(*keep).withColumns({names[0]: F.lit(b""), **{n: F.lit(0).cast("long") for n in names[1:]}}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans = [], [], []
            texts = texts_as_bytes(batch, len(keep))
            for text, ranges in zip(texts, batch.column(len(keep) + 1).to_pylist()):
                cuts = united(ranges)
                at, parts = 0, []
                for a, b in cuts:
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                if whole_characters and cuts:
                    parts = [p.decode(errors="ignore").encode() for p in parts]  # the text is UTF-8, so only edges of cuts are not
                kept.append(b"".join(parts))
                removed.append(sum(b - a for a, b in cuts))
                spans.append(len(cuts))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(kept, pa.binary()), pa.array(lengths(texts)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=[*keep, *names])

    keyed = docs.select(*keep, F.col("text").alias(own_text), text_key(F.col("text")).alias(own_key))
    found = repeats(docs).withColumnsRenamed({"key": of, "ranges": own_ranges})
    return keyed.join(found, keyed[own_key] == found[of], "left").select(*keep, own_text, own_ranges).mapInArrow(run, schema)


def removal_digests(docs: DataFrame) -> DataFrame:
    cut = remove_repeats(docs)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
