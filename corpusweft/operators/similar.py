"""Exact joins of texts by the ratio of their matching stretches: a count filter over q-grams, then the ratio itself.

The ratio is 2M / (|a| + |b|), M characters matched in order. A pair at or above a threshold leaves few characters of
either text unmatched, an unmatched one breaks at most q of a text's q-grams, and so all but K of a text's q-grams occur
in the other, where K follows from its length and the threshold. Put the q-grams of all texts in one order: then the first
K + SHARED of either text hold SHARED common ones, and only pairs that share so many such keys are looked at. The order has rare q-grams
first, so a q-gram that thousands of texts share is a key of none that has K + 1 rarer ones. The order's counts are only
coarse, which costs candidates, never pairs.

Keys are many times the text, so texts that share too few with every other are left out before keys are written anywhere:
texts of one scope and of lengths close enough to pair meet in cells of bounded size, and keys are made within a cell.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.matching import Second, ratios
from ..registry import query, shaped
from ..sources.shared import checkpointed
from . import drafts as D

#: Counters of the order of q-grams: one row each reaches the driver at most.
COUNTERS = 1 << 18
#: How many of their keys two texts have to share, where both are long enough to have so many more than they may lack.
SHARED = 8
#: Rounds in which only the first of each group of candidates is compared with the rest, before all pairs that are left.
ROUNDS = 2
#: Characters of a part of a cell: two parts of it meet in a task at most. A task needs some 30 times as many bytes.
CELL = 6_000_000
#: Characters whose q-grams are worked out at once, and meetings of texts that are counted at once.
SLICE, MEETINGS = 1_000_000, 2_000_000
#: Every character that counts as white space, for texts that are compared without it.
WHITE = r"[\s\x0B\x1C-\x1F\x85\xA0  -     　]+"
MIX, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def broken(threshold: float, q: int) -> float:
    """The most q-grams of a text, per character, that a text at or above the threshold can lack."""
    shorter = q * (2 - 2 * threshold) / (2 - threshold)
    longer = (q - 1) * (2 - 2 * threshold) / threshold
    return max(shorter, longer)


def gram_size(threshold: float) -> int:
    """The largest q, up to 8, of which half a text's q-grams at most can be lacking."""
    sizes = [q for q in range(1, 9) if broken(threshold, q) <= 0.5]
    if not sizes:
        raise ValueError(f"a threshold of {threshold} is too low for a filter by q-grams")
    return sizes[-1]


def close_lengths(a: Column, b: Column, threshold: float) -> Column:
    """Whether the lengths alone allow the threshold."""
    return 2 * F.least(a, b) >= threshold * (a + b) - 1e-9


def grams_of(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all q-grams of all texts, number of each text's)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    hashes = np.zeros(max(len(codes) - q + 1, 0), np.uint64)
    for k in range(q):
        hashes = (hashes + codes[k : len(codes) - q + 1 + k] + STEP) * MIX
        hashes ^= hashes >> np.uint64(29)
    counts = np.maximum(sizes - q + 1, 0)
    starts = np.cumsum(sizes) - sizes
    ends = np.cumsum(counts)
    return hashes[np.repeat(starts - (ends - counts), counts) + np.arange(counts.sum())], counts


def rarity(texts: DataFrame, q: int) -> np.ndarray:
    """The coarse frequency of each hashed q-gram: the binary logarithm of its counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            hashes, _ = grams_of(batch.column(0).to_pylist(), q)
            total += np.bincount((hashes % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["counter", "n"])

    level = np.zeros(COUNTERS, np.uint8)
    found = texts.select("text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).filter("n > 1").toPandas()
    level[found["counter"].to_numpy()] = np.log2(found["n"].to_numpy()).astype(np.uint8)
    return level


def keyed(texts: DataFrame, threshold: float, level: np.ndarray, scope: Column | None = None) -> DataFrame:
    """(id, size, need, key): the first K + SHARED q-grams of each text (id, text), rare ones first; a repeated q-gram is another one each time.

    need: how many keys a text shares at least with one that is similar to it, as far as its own length says.

    scope: texts of different scopes have different keys, but for chance.
    """
    q = gram_size(threshold)
    share = broken(threshold, q)
    kind = texts.schema["id"].dataType.simpleString()
    sent = texts.sparkSession.sparkContext.broadcast(level)  # 256 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).to_pylist()
            hashes, counts = grams_of(words, q)
            of = np.repeat(np.arange(len(words)), counts)
            order = np.lexsort((hashes, of))
            new = np.ones(len(order), bool)
            new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
            runs = np.flatnonzero(new)
            again = np.arange(len(order)) - np.repeat(runs, np.diff(np.append(runs, len(order))))
            rank = sent.value[(hashes[order] % np.uint64(COUNTERS)).astype(np.int64)]
            keys = (hashes[order] + again.astype(np.uint64) * STEP) * MIX
            order = np.lexsort((keys, rank, of[order]))
            ends = np.cumsum(counts)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            lacking = np.floor(sizes * share + 1e-9).astype(np.int64)
            take, need = np.minimum(counts, lacking + SHARED), np.clip(counts - lacking, 1, SHARED)
            own = batch.column(2).to_numpy().view(np.uint64)
            at = order[np.repeat(ends - counts - (np.cumsum(take) - take), take) + np.arange(take.sum())]
            who = np.repeat(np.arange(len(words)), take)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(sizes[who]), pa.array(need[who].astype(np.int32)), pa.array(((keys[at] ^ own[who]) * MIX).view(np.int64))], names=["id", "size", "need", "key"])

    return texts.select("id", "text", (F.lit(0).cast("long") if scope is None else F.xxhash64(scope)).alias("scope")).mapInArrow(run, f"id {kind}, size long, need int, key long")


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float, wanted: Column | None = None) -> DataFrame:
    """(a, b) of the keyed texts of both sides that share as many keys as both need and whose lengths allow the threshold; wanted: a test of a, b, m, n."""
    of = lambda df, i, n, k: df.select(F.col("id").alias(i), F.col("size").alias(n), F.col("need").alias(k), "key")
    met = of(left, "a", "n", "_x").join(of(right, "b", "m", "_y"), "key").filter(close_lengths(F.col("m"), F.col("n"), threshold))
    met = met if wanted is None else met.filter(wanted)
    counted = met.groupBy("a", "b").agg(F.count("*").alias("_n"), F.min(F.least("_x", "_y")).alias("_need"))
    return counted.filter(F.col("_n") >= F.col("_need")).select("a", "b")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ratio) of the pairs (a, b) whose texts (id, text) reach the threshold."""
    x = left.select(F.col("id").alias("a"), F.col("text").alias("x"))
    y = right.select(F.col("id").alias("b"), F.col("text").alias("y"))
    joined = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    kinds = [joined.schema[c].dataType.simpleString() for c in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = Second("")
        for batch in batches:
            scores = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if second.y != y:
                    second = Second(y)
                near = 2.0 * second.common(Counter(x)) / (len(x) + len(y)) >= threshold
                scores.append(second.ratio(x) if near else 0.0)
            found = np.array(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["a", "b", "ratio"]).filter(pa.array(found >= threshold))

    return joined.mapInArrow(run, f"a {kinds[0]}, b {kinds[1]}, ratio double")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, earlier: bool = False) -> DataFrame:
    """(a, b, ratio): every pair of a text of ``left`` and one of ``right``, both (id, text), at or above the threshold.

    Texts have to be longer than 2 (q - 1) characters, at most 14; null and shorter ones are in no pair. Ids are unique on
    either side. earlier: only pairs whose right id is the lesser. The pairs themselves are the size of the result.
    """
    q = gram_size(threshold)
    long = lambda df: df.select("id", "text").filter(F.length("text") > 2 * (q - 1))
    left, right = long(left), long(right)
    level = rarity(left.select("text").union(right.select("text")), q)
    a, b = keyed(left, threshold, level), keyed(right, threshold, level)
    pairs = candidate_pairs(a, b, threshold, F.col("b") < F.col("a") if earlier else None)
    return verified(pairs, left, right, threshold)


def in_company(texts: list[str], threshold: float, least: int, everything: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in their order: which may be similar to another one by their first q-grams, which to an earlier one, and pairs (later, earlier) of them.

    A later one has ``least`` characters or more. The pairs are those whose earlier text may be similar to none before it, or all.
    """
    q, n = gram_size(threshold), len(texts)
    share, low, number = broken(threshold, q), np.uint64(2**32 - 1), np.uint64(2**20 - 1)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    bounds = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1))
    parts = []
    for a, b in zip(bounds, [*bounds[1:], n]):
        hashes, counts = grams_of(texts[a:b], q)
        grams = np.sort(np.repeat(np.arange(b - a, dtype=np.uint64), counts) << np.uint64(32) | hashes >> np.uint64(32))
        runs = np.flatnonzero(np.diff(grams, prepend=grams[:1] ^ np.uint64(1)))
        again = (np.arange(len(grams)) - np.repeat(runs, np.diff(np.append(runs, len(grams))))).astype(np.uint64)
        keys = ((grams & low) + again * STEP) * MIX >> np.uint64(32)
        parts.append(((grams >> np.uint64(32)) + np.uint64(a) << np.uint64(44)) | keys)  # text, then room for the key's frequency, then the key
    grams = np.concatenate(parts)
    del parts
    by_key = np.sort((grams & low) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64))
    runs = np.flatnonzero(np.diff(by_key >> np.uint64(32), prepend=np.uint64(2**33)))
    times = np.diff(np.append(runs, len(by_key)))
    grams[(by_key & low).astype(np.int64)] |= np.repeat(np.minimum(times, 4095).astype(np.uint64) << np.uint64(32), times)
    del by_key
    grams.sort()  # of each text its rare keys first, in one order for all texts
    counts = np.maximum(sizes - q + 1, 0)
    lacking = np.floor(sizes * share + 1e-9).astype(np.int64)
    place = np.arange(len(grams)) - np.repeat(np.cumsum(counts) - counts, counts)
    grams = grams[(place < np.repeat(lacking + SHARED, counts)) & (grams >> np.uint64(32) & np.uint64(4095) > 1)]
    need = int(np.clip(counts - lacking, 1, SHARED).min())
    met = np.sort((grams & low) << np.uint64(20) | grams >> np.uint64(44))  # each key with the texts that have it
    del grams, place
    found, after, pairs = np.zeros(n, bool), np.zeros(n, bool), [np.zeros((2, 0), np.int64)]
    while True:
        of = (met & number).astype(np.int64)
        runs = np.flatnonzero(np.diff(met >> np.uint64(20), prepend=np.uint64(2**50)))
        times = np.diff(np.append(runs, len(met)))
        stay = (np.bincount(of, minlength=n)[of] >= need) & (np.repeat(times, times) > 1)
        if stay.all():
            break
        met = met[stay]

    def noted(codes: np.ndarray, first: int) -> np.ndarray:
        """Of meetings, a code each for two texts that have a key, the pairs (later, earlier) that share enough keys; they are noted."""
        codes.sort()
        often = np.unique(codes[need - 1 :][codes[: len(codes) - need + 1] == codes[need - 1 :]])
        x, y = (often >> np.uint64(20)).astype(np.int64) + first, (often & number).astype(np.int64)
        a, b = np.maximum(x, y), np.minimum(x, y)
        close = (a != b) & (sizes[a] >= least) & (2 * np.minimum(sizes[a], sizes[b]) >= threshold * (sizes[a] + sizes[b]) - 1e-9)
        a, b = a[close], b[close]
        found[a] = found[b] = after[a] = True
        return np.stack([a, b])

    same = np.diff(met >> np.uint64(20)) == 0
    noted((met[:-1][same] & number) << np.uint64(20) | of[1:][same].astype(np.uint64), 0)  # neighbours tell most that are after another one
    by_text = np.argsort(of, kind="stable")
    by_text = by_text if everything else by_text[~after[of[by_text]]]
    start, many = np.repeat(runs, times)[by_text], np.repeat(times, times)[by_text]
    cuts = np.flatnonzero(np.diff(of[by_text], prepend=-1))
    if len(cuts):
        pieces = np.flatnonzero(np.diff(np.cumsum(np.add.reduceat(many, cuts)) // MEETINGS, prepend=-1))
        edges = np.append(cuts, len(by_text))
        for a, b in zip(edges[pieces], edges[np.append(pieces[1:], len(cuts))]):
            at = np.repeat(start[a:b] - (np.cumsum(many[a:b]) - many[a:b]), many[a:b]) + np.arange(many[a:b].sum())
            first = int(of[by_text[a]])
            pairs.append(noted(np.repeat((of[by_text[a:b]] - first).astype(np.uint64) << np.uint64(20), many[a:b]) | of[at].astype(np.uint64), first))
    both = np.concatenate(pairs, axis=1)
    return found, after, np.unique(both if everything else both[:, ~after[both[1]]], axis=1)


def company(texts: DataFrame, threshold: float, least: int, everything: bool = False) -> DataFrame:
    """(n, after, b) of the texts (n, scope, text), n their order, that may be similar to others of their scope: whether to an earlier one, and in rows of their own pairs with an earlier b.

    A text meets all of lengths close enough in one of two cells. A cell of several parts, dealt by hash, is a task for each two
    of them. Scopes may be equal by chance of a hash.
    """
    step = math.log((2 - threshold) / threshold) * (1 + 1e-9) or 1e-9
    own = texts.select("n", F.xxhash64("scope").alias("s"), F.floor(F.log(F.length("text")) / step).alias("level"), "text")
    own = own.withColumn("level", F.explode(F.array(F.col("level") - 1, F.col("level"))))
    size = F.sum(F.greatest(F.length("text"), F.lit(24)))
    large = own.groupBy("s", "level").agg(F.ceil(size / CELL).cast("int").alias("parts")).filter("parts > 1")  # a row for CELL characters at most
    parted = own.join(F.broadcast(large), ["s", "level"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("n"), F.col("parts")).cast("int")
    dealt = parted.withColumn("i", part).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("i <> j or parts = 1")
    dealt = dealt.select("n", "text", F.xxhash64("s", "level", F.least("i", "j"), F.greatest("i", "j")).alias("cell"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("n")
        order = rows.column("n").to_numpy()
        found, after, (a, b) = in_company(rows.column("text").to_pylist(), threshold, least, everything)
        at = np.flatnonzero(found)
        none = pa.nulls(len(at), pa.int64()), pa.nulls(len(a), pa.bool_())
        return pa.table({"n": np.concatenate([order[at], order[a]]), "after": pa.concat_arrays([pa.array(after[at]), none[1]]), "b": pa.concat_arrays([none[0], pa.array(order[b], pa.int64())])})

    return dealt.groupBy("cell").applyInArrow(run, "n long, after boolean, b long")


def settled(edges: DataFrame) -> DataFrame:
    """(id) of those that go, of edges (b, a) from earlier to later texts: each that a staying earlier one reaches.

    Each round keeps what no open edge reaches and drops what those reach; rounds are as many as the longest chain has links.
    """
    gone = None
    while not edges.isEmpty():
        first = edges.select(F.col("b").alias("id")).distinct().join(edges.select(F.col("a").alias("id")), "id", "left_anti")
        dropped = edges.join(first.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        dropped = checkpointed(dropped)
        gone = dropped if gone is None else gone.union(dropped)
        edges = edges.join(first.withColumnRenamed("id", "b"), "b", "left_anti")
        for side in ("a", "b"):
            edges = edges.join(dropped.withColumnRenamed("id", side), side, "left_anti")
        edges = checkpointed(edges)
    return gone


def near_repeats(texts: DataFrame, threshold: float, least: int, scope: str | None = None) -> DataFrame:
    """(id) of the texts (id, text) that nearly repeat one that stays before them, where ids give the order and texts differ.

    scope: a field of the ids, which are structs then; only texts of one scope meet.

    A text of fewer than ``least`` characters never goes, but others may repeat it. Groups of copies shrink first: what comes
    first by all its keys stays for certain, so comparing it alone with its groups removes whatever repeats it.
    """
    q = gram_size(threshold)
    shortest = max(math.ceil(least * threshold / (2 - threshold) - 1e-9), 2 * q - 1)
    own = F.lit(None).cast("string") if scope is None else F.col(f"id.{scope}")
    # numbers in the order of the ids, which are small and compare fast; the checkpoint holds them fast
    rows = texts.filter(F.length("text") >= shortest).orderBy("id").select(F.monotonically_increasing_id().alias("n"), "id", own.alias("scope"), "text")
    rows = left = checkpointed(rows)
    gone = rows.select(F.col("n").alias("id")).limit(0)

    def similar(met: DataFrame, texts: DataFrame) -> DataFrame:
        """(a, b) of pairs (n, b)."""
        of = lambda side: texts.select(F.col("n").alias(side), F.col("scope").alias(f"_{side}"))  # noqa: E731  cells of two scopes may be equal by chance
        own = met.select(F.col("n").alias("a"), "b").distinct().join(of("a"), "a").join(of("b"), "b").filter(F.col("_a").eqNullSafe(F.col("_b"))).select("a", "b")
        plain = texts.select(F.col("n").alias("id"), "text")
        return verified(own, plain, plain, threshold).select("a", "b")

    for last in [False] * ROUNDS + [True]:
        met = checkpointed(company(left, threshold, least, everything=last))
        known = met.filter("b is null").groupBy("n").agg(F.bool_or("after").alias("after"))
        left = checkpointed(left.join(known, "n").select(*rows.columns, "after"))
        pairs = met.filter("b is not null")
        if last:
            more = settled(checkpointed(similar(pairs, left)))
            break
        certain = left.filter("not after").select(F.col("n").alias("b"))
        lost = checkpointed(similar(pairs.join(certain, "b", "left_semi"), left).select(F.col("a").alias("id")).distinct())
        gone = gone.union(lost)
        left = left.filter("after").drop("after").join(lost.withColumnRenamed("id", "n"), "n", "left_anti")
    lost = gone if more is None else gone.union(more)
    return rows.join(lost.select(F.col("id").alias("n")).distinct(), "n", "left_semi").select("id")


def blocks_of(text: Column) -> Column:
    """The paragraphs of a text, cut at empty lines, without the white space around the text."""
    return F.split(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WHITE}", ""), f"{WHITE}$", ""), "\n{2,}")


def kept_paragraphs(drafts: DataFrame, threshold: float = D.DUPLICATE, least: int = D.DUPLICATE_CHARS) -> DataFrame:
    """(project, draft_id, place, paragraph) of a project's paragraphs, without long ones that nearly repeat a kept one before them.

    drafts: (project, draft_id, text), in the order of draft_id; texts are compared without white space. A repeat of equal text is
    found by a hash. Null ids, empty texts: a null project is a project of its own; an empty text is one empty paragraph.
    """
    parts = drafts.select("project", "draft_id", F.posexplode(blocks_of(F.col("text"))).alias("place", "paragraph")).withColumn("bare", F.regexp_replace("paragraph", WHITE, ""))
    parts = parts.withColumn("at", F.struct("draft_id", "place")).withColumn("print", F.sha2("bare", 256))
    first = parts.filter("bare <> ''").groupBy("project", "print").agg(F.min("at").alias("lead"), F.first("bare").alias("bare"))
    texts = first.select(F.struct("project", F.col("lead").alias("at")).alias("id"), F.col("bare").alias("text"))
    gone = near_repeats(texts, threshold, least, "project").select(F.col("id.project").alias("p"), F.col("id.at").alias("gone"))
    # a repeat goes with its first occurrence or for it, where it is long enough; what goes is told by places and prints, texts are met with it once
    own = parts.select("project", "print", "at", F.length("bare").alias("size"))
    again = own.withColumn("lead", F.min("at").over(Window.partitionBy("project", "print"))).filter((F.col("size") >= least) & (F.col("at") != F.col("lead")))
    lost = again.select(F.col("project").alias("p"), F.col("at").alias("gone"), F.col("print").alias("of")).unionByName(gone.withColumn("of", F.lit(None).cast("string")))
    stay = parts.join(lost, F.col("project").eqNullSafe(F.col("p")) & (F.col("at") == F.col("gone")) & (F.col("of").isNull() | (F.col("of") == F.col("print"))), "left_anti")
    return stay.select("project", "draft_id", "place", "paragraph")


def deduped(drafts: DataFrame, threshold: float = D.DUPLICATE, least: int = D.DUPLICATE_CHARS) -> DataFrame:
    """(project, draft_id, text, n_removed) of each draft, put together again from the paragraphs that stay."""
    kept = kept_paragraphs(drafts, threshold, least).groupBy("project", "draft_id").agg(F.sort_array(F.collect_list(F.struct("place", "paragraph"))).alias("parts"))  # one text
    before = drafts.select("project", "draft_id", F.size(blocks_of(F.col("text"))).alias("n"))
    joined = before.alias("x").join(kept.alias("y"), F.col("x.project").eqNullSafe(F.col("y.project")) & F.col("x.draft_id").eqNullSafe(F.col("y.draft_id")), "left")
    whole = F.array_join(F.coalesce(F.col("parts.paragraph"), F.array().cast("array<string>")), "\n\n")
    return joined.select("x.project", "x.draft_id", F.regexp_replace(F.regexp_replace(whole, f"^{WHITE}", ""), f"{WHITE}$", "").alias("text"), (F.col("n") - F.coalesce(F.size("parts"), F.lit(0))).alias("n_removed"))


def reuse_similarity(sections: DataFrame, packs: DataFrame) -> DataFrame:
    """(section_id, score, block_id, source_title): the block of its own pack that each section repeats most, by the ratio of plain texts.

    sections: (section_id, text); packs: (section_id, place, block_id, source_title, text). Plain texts of fewer than 60
    characters take no part; of equal ratios the first place counts. A pack is what one section was written from: a few blocks.
    """
    return closest_blocks(with_plain(sections.select("section_id", "text")), with_plain(packs.select("section_id", "place", "block_id", "source_title", "text")))


def with_plain(texts: DataFrame) -> DataFrame:
    """The rows with plain texts, without short ones; a text is worked out once, not for the filter and again for the result."""
    plain = F.filter(F.array(D.plain_similarity(F.col("text"))), lambda x: F.length(x) >= D.REUSED_CHARS)
    return texts.select(*(c for c in texts.columns if c != "text"), F.explode(plain).alias("text"))


def closest_blocks(sections: DataFrame, packs: DataFrame) -> DataFrame:
    """The same for texts that are plain already."""
    own = sections.select(F.col("section_id").alias("_id"), F.col("text").alias("own"))
    joined = packs.join(own, F.col("section_id") == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ratios(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.float64())], names=[*batch.schema.names[:4], "score"])

    kinds = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in ("section_id", "place", "block_id", "source_title"))
    scored = joined.select("section_id", "place", "block_id", "source_title", "own", "text").mapInArrow(run, f"{kinds}, score double").filter("score > 0")
    best = scored.groupBy("section_id").agg(F.max_by(F.struct(F.round("score", 4).alias("score"), "block_id", "source_title"), F.struct("score", (-F.col("place")).alias("order"))).alias("b"))
    return best.select("section_id", "b.*")


def is_reused(score: Column, specificity: Column, parameter_sensitive: Column) -> Column:
    """Whether a section keeps too close to what it reuses: always at 0.98, from 0.92 on where it depends on the customer or on parameters."""
    bound = F.coalesce(parameter_sensitive, F.lit(False)) | F.lower(F.coalesce(F.nullif(specificity, F.lit("")), F.lit("medium"))).isin("medium", "high")
    return F.coalesce((score >= 0.98) | ((score >= 0.92) & bound), F.lit(False))


@query()
def paragraph_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each source's drafts without near repeats of earlier ones; a unit test holds them against a plain version."""
    return kept_paragraphs(shaped(spark, sf_dir, "SELECT source AS project, doc_id AS draft_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM {documents}"))


@query()
def reuse_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the two lines before each line of the documents the one that it repeats most; a unit test holds the function against a plain version."""
    docs = shaped(spark, sf_dir, "SELECT doc_id, source, text FROM {documents}")
    lines = with_plain(docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long")))
    number = lambda line: F.col("doc_id") * 1_000_000 + line
    sections = lines.select(number(F.col("line")).alias("section_id"), "text")
    packs = lines.withColumn("place", F.explode(F.array(F.lit(1), F.lit(2)))).select(number(F.col("line") + F.col("place")).alias("section_id"), "place", number(F.col("line")).alias("block_id"), F.col("source").alias("source_title"), "text")
    return closest_blocks(sections, packs)
