"""Phrases whose words occur together more often than apart: two passes, a count-min sketch before exact counts.

The first pass hashes every n-gram of one to four words into count-min sketches of bytes that stop at 255, one a task;
the sketches are added up slice by slice. A cell below the least frequency proves that none of its n-grams reaches it,
so the second pass aggregates only n-grams all of whose cells reach it, and those of the shorter n-grams in them, exactly,
by their words: the sketch can only let too much through, never too little. Every part of a phrase is at least as frequent as the phrase, so the survivors hold
all counts that scores need.

The sketch has one size whatever the input (two rows of 2**26 cells: 128 MB in a task, 16 MB as the bits that are
broadcast). Beyond some billion n-grams it fills up and lets more and more through, up to all n-grams; the second pass
then costs what plain counting costs, with equal results.

Contract
--------
``phrases(docs)`` gives (lang, rank, phrase, a, l, r, n, score), the first ``most`` of each language. A null lang is
``und``; a null or empty text has no words. Text is lower-cased in A-Z only, pieces end at ``. , ; : ! ?`` and line
ends, words at spaces and tabs. Ties go by a, then by phrase in byte order. Repeated rows count as often as they occur,
very long texts are one piece after another; an empty table gives no rows. Only text and lang are read, so clashing
names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._batches import Numbers, bounded_batches, checkpointed, mix64, texts_as_bytes

LONGEST = 4
LEAST = 30
SCALE = 2_000_000
#: A longer phrase with this share (percent) of a phrase's occurrences stands for it.
SUBSUMED = 80
MOST = 2000
UNKNOWN = "und"
ROWS, CELL_BITS, SLICE_BITS = 2, 26, 20
#: Texts of so many bytes are counted together before their counts leave a task.
TOGETHER = 4 << 20
#: Letters to lower case, ends of pieces to full stops, tabs to spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9 + b" ")
STOP = b"."


def languages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts) of about TOGETHER bytes; what a language has left comes at the end."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(1).to_pylist(), texts_as_bytes(batch, 0)):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
        for lang in [lang for lang, n in size.items() if n >= TOGETHER]:
            yield lang, held.pop(lang)
            del size[lang]
    yield from held.items()


class Grams:
    """The n-grams of some texts of one language: word numbers, and a hash of each n-gram."""

    def __init__(self, lang: str, texts: list[bytes]) -> None:
        words = b" . ".join([b"", *texts, b""]).translate(FOLD).replace(STOP, b" . ").split()
        numbers = Numbers()
        numbers[STOP] = 0
        self.ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        self.words = list(numbers)
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        self.hashes = own[self.ids]
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places of the first words, hashes) for each n."""
        at = np.flatnonzero(self.ids)
        hashes = np.full(len(at), self.seed, np.uint64)
        for n in range(1, LONGEST + 1):
            if n > 1:
                inside = self.ids[at + (n - 1)] > 0
                at, hashes = at[inside], hashes[inside]
            hashes = mix64(hashes + self.hashes[at + (n - 1)])
            yield n, at, hashes


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes if row == 0 else mix64(hashes ^ np.uint64(row))) >> np.uint64(64 - bits)).astype(np.int64)


def add(sketch: np.ndarray, at: np.ndarray) -> None:
    """Count the cells, stopping at 255."""
    found, number = np.unique(at, return_counts=True)
    sketch[found] = np.minimum(sketch[found] + number, 255)


def reached(docs: DataFrame, least: int, bits: int) -> bytes:
    """One bit for each cell of each row of the merged sketch: whether its count reaches ``least``."""
    slice_bits = min(SLICE_BITS, bits)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        sketch = np.zeros((ROWS, 1 << bits), np.uint8)
        for lang, texts in languages(batches):
            for _, _, hashes in Grams(lang, texts):
                for row in range(ROWS):
                    add(sketch[row], cells(hashes, row, bits))
        for number, part in enumerate(sketch.reshape(-1, 1 << slice_bits)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["part", "counts"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(zlib.decompress(packed), np.uint8)
                total[number] = np.minimum(total[number].astype(np.uint16) + counts, 255).astype(np.uint8) if number in total else counts
        for number, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.packbits(counts >= least).tobytes()], pa.binary())], names=["part", "bits"])

    rows = docs.mapInArrow(sketched, "part long, counts binary").repartition("part").mapInArrow(merged, "part long, bits binary").collect()
    out = bytearray(ROWS << bits >> 3)  # a size of its own: no more than ROWS * 2**bits / 8 bytes reach the driver
    width = (1 << slice_bits) >> 3
    for row in rows:
        out[row.part * width : (row.part + 1) * width] = row.bits
    return bytes(out)


def tallies(grams: Grams, at: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct n-gram, its count): by hash, where places of one hash hold the same words."""
    _, first, which, number = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    lead = at[first]
    for k in range(n):
        if not np.array_equal(grams.ids[lead + k][which], grams.ids[at + k]):  # two n-grams with one hash
            rows, first, number = np.unique(np.stack([grams.ids[at + j] for j in range(n)], 1), axis=0, return_index=True, return_counts=True)
            return at[first], number
    return lead, number


def frequencies(docs: DataFrame, least: int = LEAST, bits: int = CELL_BITS) -> DataFrame:
    """(lang, words array<string>, f): exact counts of all n-grams with f >= least; words is empty in the row of n."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("text").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    passed = spark.sparkContext.broadcast(reached(rows, least, bits))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(passed.value, np.uint8)
        for lang, texts in languages(batches):
            grams = Grams(lang, texts)
            total = 0
            passing = np.zeros(len(grams.ids), bool)  # where an n-gram starts that may reach ``least``
            for n, at, hashes in grams:
                total += len(at) * (n == 1)
                if n > 1:  # no n-gram is more frequent than either of the two one shorter in it
                    both = passing[at] & passing[at + 1]
                    at, hashes = at[both], hashes[both]
                for row in range(ROWS):
                    cell = cells(hashes, row, bits) + (row << bits)
                    keep = (flags[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
                    at, hashes = at[keep], hashes[keep]
                passing[:] = False
                passing[at] = True
                lead, number = tallies(grams, at, hashes, n)
                names = [grams.words[i] for i in grams.ids[(lead[:, None] + np.arange(n)).ravel()]]
                offsets = pa.array(np.arange(0, len(names) + 1, n, dtype=np.int32))
                words = pa.ListArray.from_arrays(offsets, pa.array(names, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(lead), pa.string()), words, pa.array(number.astype(np.int64))], names=["lang", "words", "f"])
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([[]], pa.list_(pa.string())), pa.array([total])], names=["lang", "words", "f"])

    counted = rows.mapInArrow(exact, "lang string, words array<string>, f long").groupBy("lang", "words").agg(F.sum("f").alias("f"))
    return checkpointed(counted.filter((F.col("f") >= least) | (F.size("words") == 0)))


def scored(known: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, words, a, l, r, score): each phrase with its lowest-scoring cut."""
    own = known.filter(F.size("words") > 1)
    cuts = own.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    parts = cuts.select("*", F.slice("words", 1, F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    of_head = known.select(F.col("lang"), F.col("words").alias("head"), F.col("f").alias("l"))
    of_tail = known.select(F.col("lang"), F.col("words").alias("tail"), F.col("f").alias("r"))
    joined = parts.join(of_head, ["lang", "head"]).join(of_tail, ["lang", "tail"])
    score = F.expr(f"cast({scale} as decimal(10, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return joined.groupBy("lang", "words", "a").agg(best).select("lang", "words", "a", "best.l", "best.r", "best.score")


def longest_holders(known: DataFrame) -> DataFrame:
    """(lang, words, most): for each phrase inside longer ones, the largest frequency among those."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda at: F.slice("words", at, n))))
    return known.filter(F.size("words") > 2).select("lang", "f", F.explode(inner).alias("words")).groupBy("lang", "words").agg(F.max("f").alias("most"))


def phrases(docs: DataFrame, least: int = LEAST, most: int = MOST, bits: int = CELL_BITS) -> DataFrame:
    """The first ``most`` phrases of each language (see the module's contract)."""
    known = frequencies(docs, least, bits)
    words = known.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    left = scored(known).join(longest_holders(known), ["lang", "words"], "left")
    left = left.filter(F.col("most").isNull() | (F.col("most").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * SUBSUMED))
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    rows = left.select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "score")
    # a language's phrases are ranked in parts first, so that no task gets them all
    parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return first.withColumn("rank", rank).filter(F.col("rank") <= most).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang
), sized AS (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS place FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), grams AS (
    SELECT lang, list_slice(w, place, place + k - 1) AS g, count(*) AS f FROM sized GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
    SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM grams WHERE len(g) > 1
), scores AS (
    SELECT c.lang, c.g, c.f AS a, c.k, h.f AS l, t.f AS r, (2000000::HUGEINT * c.f) // (h.f + t.f) AS score
    FROM cuts c JOIN grams h ON h.lang = c.lang AND h.g = list_slice(c.g, 1, c.k) JOIN grams t ON t.lang = c.lang AND t.g = list_slice(c.g, c.k + 1, len(c.g))
), best AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), spans AS (
    SELECT lang, f, g, k, unnest(range(1, len(g) - k + 2)) AS place FROM grams, (SELECT unnest([2, 3]) AS k) WHERE len(g) > k
), holders AS (
    SELECT lang, list_slice(g, place, place + k - 1) AS g, max(f) AS most FROM spans GROUP BY ALL
), kept AS (
    SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN holders h ON h.lang = b.lang AND h.g = b.g
    WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT p.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM placed p JOIN totals USING (lang) WHERE rank <= 2000
"""
