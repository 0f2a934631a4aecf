"""Best-fit packing of documents into sequences under several capacities.

A piece of a document asks for tokens, for one document, and for attention (the square of its length, as a piece
attends within itself). A sequence has a capacity of each. Since a piece's demands follow from its length, the plan
needs only the number of pieces of each length: lengths fall, and all pieces of one length go, a range of sequences at
a time, where the weighted residual is smallest in norm (or its dot product with the demand largest). Its rows say
which pieces, by rank within their length, go to which sequences at which offset, and every task places its own pieces
by binary search. The plan's size follows from the number of lengths, not from the corpus.

Ranks come from counts by (length, salt), so no group grows with a frequent length.

Contract
--------
``pieces(docs, path)`` tokenises whole texts and gives (id, piece, start, length, ids_crc32[, ids]); a null or empty
text is one piece that holds only the end id. ``pack(pieces)`` adds sequence_id and offset: sequences are gapless from
offset 0 and within every capacity. Repeated rows are packed as often as they occur, null ids like any other; very long
texts are cut into pieces of the token capacity, of which only the last may be shorter. An empty table gives no rows.
Only the id and the text are read, so clashing names do no harm. ``assembled`` joins the ids of each sequence.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._batches import Numbers, bounded_batches, checkpointed, ends_of, lengths, ragged, texts_as_bytes
from .bpe import LONG_SLICE, NONE, Vocabulary

TOKENS = 2048
END_ID = 0
#: Stands between texts; no UTF-8 text holds this byte.
BREAK = b"\xff"
#: Put between words that are encoded together: a control character, which is a token of its own; words that hold one are encoded apart.
FENCE = "\x01"
TOGETHER = 256
#: Classes of bytes: ASCII letters, and ASCII punctuation. Between a letter and punctuation after it there is always an edge of tokens.
LETTERS, PUNCTUATION = (np.array([c < 128 and test(chr(c)) for c in range(256)]) for test in (str.isalpha, lambda c: c.isprintable() and not c.isalnum() and c != " "))
#: So many different words are remembered with their ids before a worker starts anew.
CACHE_WORDS = 600_000
#: Pieces of one length and salt, about: what one task numbers in order.
PER_SALT = 1_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and how much each residual weighs."""

    tokens: int = TOKENS
    documents: int = TOKENS
    attention: int = TOKENS * TOKENS
    weights: tuple[float, float, float] | None = None  # None: by how scarce each is, the corpus' demand over the capacity
    rule: str = "norm"  # or "dot"


class Ragged:
    """Lists of ids that grows at its end."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.flat, self.counts, self.starts = flat, counts, ends_of(counts)[:-1]

    def extend(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + ends_of(counts)[:-1]])
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])

    def of(self, which: np.ndarray) -> np.ndarray:
        """The ids of the given lists, one after the other."""
        return self.flat[ragged(self.starts[which], self.counts[which])]


class WordMerges(Vocabulary):
    """The merges of words of a-z alone, many words at once; a word's last letter is given in upper case, as it is a symbol of its own."""

    def __init__(self, tokenizer) -> None:
        model = json.loads(tokenizer.to_str())["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        values = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        if (np.diff(values) <= 0).any():
            raise ValueError("ids do not rise with the rank of merges")
        self.ranks = {}  # no shortcut for whole words
        self.single = np.zeros(256, np.int32)
        for letter in "abcdefghijklmnopqrstuvwxyz":
            self.single[ord(letter)], self.single[ord(letter.upper())] = vocabulary[letter], vocabulary[letter + end]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.uint64)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = np.append(keys[order], np.uint64(2**64 - 1)), np.append(values[order], NONE)
        counts = np.bincount(slot, minlength=1 << 20)
        self.first, self.most = ends_of(counts).astype(np.int32), int(counts.max())


class WordEncoder:
    """Ids of texts, word by word: white space ends every token, so words can be encoded apart and remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.fence = self._ids(FENCE)
        self.merges = WordMerges(self.tokenizer)
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each) by the tokenizer: many words a call, as a call costs more than a word."""
        words = [w.decode() for w in words]
        if len(self.fence) != 1 or any(FENCE in word for word in words):
            each = [self._ids(word) for word in words]
            return np.fromiter(itertools.chain.from_iterable(each), np.uint32), lengths(each)
        texts = [f" {FENCE} ".join([*words[at : at + TOGETHER], ""]) for at in range(0, len(words), TOGETHER)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])
        fences = np.flatnonzero(ids == self.fence[0])
        return np.delete(ids, fences), np.diff(fences, prepend=-1) - 1

    def _forget(self) -> None:
        self.numbers, self.tails = Numbers(), Numbers()
        self.numbers[BREAK] = 0
        self.words = Ragged(np.array([END_ID], np.uint32), np.ones(1, np.int64))
        self.of_tails = Ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learn(self, words: list[bytes]) -> None:
        """Encode words not met before: ASCII letters before an optional tail of punctuation by the library's own merging, others by the tokenizer."""
        raw = np.frombuffer(BREAK.join([*words, b""]), np.uint8)
        ends = np.flatnonzero(raw == BREAK[0])
        starts = np.concatenate([[0], ends[:-1] + 1])
        others, beyond = (np.flatnonzero(~table[raw]) for table in (LETTERS, PUNCTUATION))
        middle = others[np.searchsorted(others, starts)]  # where a word's first letters end
        plain = (middle > starts) & (beyond[np.searchsorted(beyond, middle)] == ends) & (middle - starts <= LONG_SLICE)
        low = np.where(LETTERS[raw], raw | 0x20, raw)
        low[middle[plain] - 1] &= 0xDF
        sizes = (middle - starts)[plain] + 1
        stems = low[ragged(starts[plain], sizes)]
        stems[np.cumsum(sizes) - 1] = BREAK[0]
        tailed = np.flatnonzero(plain & (middle < ends))
        known = len(self.tails)
        tails = np.fromiter((self.tails[words[i][k:]] for i, k in zip(tailed.tolist(), (middle - starts)[tailed].tolist())), np.int64, len(tailed))
        if len(self.tails) > known:
            self.of_tails.extend(*self._together(list(itertools.islice(self.tails, known, None))))
        rest = np.flatnonzero(~plain)
        parts = [self.merges.encode_slices(stems.tobytes().split(BREAK)[:-1]), self._together([words[i] for i in rest])]
        pool = Ragged(np.concatenate([*(ids.astype(np.uint32) for ids, _ in parts), self.of_tails.flat]), np.concatenate([*(counts for _, counts in parts), self.of_tails.counts]))
        which = np.full((len(words), 2), -1)
        which[plain, 0] = np.arange(len(sizes))
        which[rest, 0] = len(sizes) + np.arange(len(rest))
        which[tailed, 1] = len(words) + tails
        counts = pool.counts[which[:, 0]]
        counts[tailed] += self.of_tails.counts[tails]
        self.words.extend(pool.of(which[which >= 0]), counts)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; 0 and where each text's ids end)."""
        if len(self.numbers) > CACHE_WORDS:
            self._forget()
        words = b" \xff ".join([*texts, b""]).split()
        known = len(self.numbers)
        which = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.numbers) > known:
            self._learn(list(itertools.islice(self.numbers, known, None)))
        ends = ends_of(self.words.counts[which])[1:][which == 0]
        return self.words.of(which), np.concatenate([[0], ends])


@functools.cache
def encoder_of(path: str) -> WordEncoder:
    """One a worker process, so that its tasks share what is remembered."""
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, size: int = TOKENS, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Whole texts as pieces of at most ``size`` tokens, the end id included."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            ids, ends = encoder.encode(texts_as_bytes(batch, 1))
            counts = -(-np.diff(ends) // size)
            of = np.repeat(np.arange(len(counts)), counts)
            piece = np.arange(len(of)) - np.repeat(ends_of(counts)[:-1], counts)
            start = piece * size
            length = np.minimum(size, np.diff(ends)[of] - start)
            at = ends[:-1][of] + start
            raw = memoryview(ids.tobytes())
            parts = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.fromiter(map(zlib.crc32, parts), np.int64, len(parts)))]
            if keep_ids:
                columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def planned(counts: dict[int, int], capacity: Capacity) -> np.ndarray:
    """Rows (length, first rank, number of pieces, first sequence, offset): vector best fit with falling lengths.

    Sequences with equal contents stay together as ranges; a step fills a whole range or uses a length up.
    """
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], np.int64)
    lengths_, numbers = (np.array(list(v), np.float64) for v in (counts.keys(), counts.values()))
    demands = np.array([lengths_ @ numbers, numbers.sum(), lengths_**2 @ numbers]) / full
    weights = np.array(capacity.weights) if capacity.weights else demands / max(demands.max(), 1e-300)
    room = np.zeros((0, 3), np.int64)  # of each open range
    first, number = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, sequences, order = [], 0, sorted(counts, reverse=True)
    smallest = order[-1] if order else 0
    least = np.array([smallest, 1, smallest * smallest], np.int64)
    for length in order:
        demand, rank, left = np.array([length, 1, length * length], np.int64), 0, counts[length]
        if (demand > full).any():
            raise ValueError(f"a piece of {length} tokens is beyond a sequence's capacity")
        while left:
            fits = np.flatnonzero((room >= demand).all(1))
            if not len(fits):  # open as many as this length alone fills or uses
                each = int((full // demand).min())
                opened = -(-left // each)
                room, first, number = np.vstack([room, full]), np.append(first, sequences), np.append(number, opened)
                sequences += opened
                continue
            if capacity.rule == "dot":
                best = fits[np.argmax((room[fits] / full * (demand / full)) @ weights)]
            else:
                best = fits[np.argmin((((room[fits] - demand) / full) ** 2) @ weights)]
            taken = int(min(left, number[best]))
            rows.append((length, rank, taken, first[best], full[0] - room[best, 0]))
            if taken < number[best]:
                room, first, number = np.vstack([room, room[best]]), np.append(first, first[best] + taken), np.append(number, number[best] - taken)
                number[best] = taken
            room[best] -= demand
            rank, left = rank + taken, left - taken
            if (room[best] < least).any():
                room, first, number = np.delete(room, best, 0), np.delete(first, best), np.delete(number, best)
    return np.array(rows, np.int64).reshape(-1, 5)


def ranked(found: DataFrame, id_column: str, counts: dict[int, int]) -> DataFrame:
    """The pieces with their rank (from 0) within their length; counts: of each length."""
    parts = found.sparkSession.createDataFrame([(length, -(-n // PER_SALT)) for length, n in counts.items()], "length long, salts long")
    salt = F.pmod(F.xxhash64(id_column, "piece", "ids_crc32"), F.col("salts"))
    salted = found.join(F.broadcast(parts), "length").withColumn("salt", salt).drop("salts")  # a row a length at most
    own = salted.groupBy("length", "salt").count()
    before = own.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_column, "piece", "ids_crc32")) - 1
    return salted.withColumn("inside", inside).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside")).drop("salt", "before", "inside")


def pack(found: DataFrame, capacity: Capacity = Capacity(), id_column: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset; ``found`` is read twice, so give it checkpointed."""
    counts = {row.length: row["count"] for row in found.groupBy("length").count().collect()}  # one row a length
    plan = planned(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    lead = np.searchsorted(plan[:, 0], np.arange(capacity.tokens + 2))  # where a length's rows begin
    placed = ranked(found, id_column, counts)
    columns = [c for c in placed.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            order = np.lexsort((rank, length))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = order[np.searchsorted(length, n, sorter=order) : np.searchsorted(length, n, "right", sorter=order)]
                at[own] = lead[n] + np.searchsorted(plan[lead[n] : lead[n + 1], 1], rank[own], "right") - 1
            sequence = plan[at, 3] + rank - plan[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(plan[at, 4])], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in columns) + ", sequence_id long, offset long"
    return placed.mapInArrow(run, schema)


def assembled(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids binary) of packed pieces that carry ids; a sequence is bounded by its capacity."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("inside", F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), inside.alias("inside")).select("sequence_id", "n_tokens", joined.alias("ids"))


def packed(docs: DataFrame, path: str, capacity: Capacity = Capacity(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokenise whole texts, cut them and pack them; the query's columns."""
    found = checkpointed(pieces(docs, path, capacity.tokens, id_column, text_column))
    return pack(found, capacity, id_column).select(id_column, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
