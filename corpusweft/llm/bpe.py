"""Byte-level BPE: encode whole texts with offsets, and decode the ids again.

Pre-tokens are found without a regular expression. Every code point maps to a class; class and lookahead give a
symbol, and each symbol is a function from automaton states to states. Composition of such functions is associative,
so all states of a batch come from a blocked scan over function numbers. Slices between the boundaries are numbered
through a dictionary; only slices not met before are merged, many at once, by ascending rank.

Contract
--------
``encode(docs)`` gives one row per input row with the id column and ``token_ids`` / ``token_ends`` (binary, packed
little-endian unsigned 32-bit integers: ids, and the byte offset at which each token ends). A null or empty text has
no tokens. Other columns of the input are not read, so clashing names do no harm; repeated rows give repeated rows.
``decode(encoded)`` gives the bytes back.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import Numbers, bounded_batches, ends_of, lengths, ragged, texts_as_bytes

#: Classes of code points.
LETTER, NUMBER, OTHER, SPACE, BLANK, APOSTROPHE = range(6)
#: Symbols: classes with what the lookahead says. *_LAST: white space before something else; *_MID: before more of it, or at the end.
(S_LETTER, S_NUMBER, S_OTHER, S_CONTRACT_1, S_CONTRACT_2, S_WHITE_MID, S_SPACE_LAST, S_BLANK_LAST) = range(8)
#: States: what the open pre-token takes next. OUT: nothing; LED: a space that any run may follow; ONE, TWO: letters of a contraction.
OUT, IN_LETTERS, IN_NUMBERS, IN_OTHER, LED, IN_WHITE, ONE, TWO = range(8)
#: A number of slices after which the cache of a task is dropped, to bound its memory.
CACHE_SLICES = 200_000
#: Longer slices are merged one by one with a heap.
LONG_SLICE = 48
NONE = np.int32(2**31 - 1)


@functools.cache
def code_point_classes() -> np.ndarray:
    """The class of every code point, from the Unicode tables of the tokeniser library itself."""
    import tiktoken

    classes = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        found = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        classes[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    classes[0x20], classes[0x27] = SPACE, APOSTROPHE
    return classes


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each symbol's function, composition table, states after each function, cut[state, symbol]).

    Symbols from 8 on are those of a document's first character: they forget what came before.
    """
    step, cut = np.zeros((8, 8), np.int64), np.ones((8, 8), bool)
    for state in range(8):
        for symbol in range(8):
            joins, then = False, OUT
            if state in (ONE, TWO) and symbol == S_LETTER:  # what else might follow does not, by the lookahead
                joins, then = True, OUT if state == ONE else ONE
            elif symbol in (S_LETTER, S_NUMBER, S_OTHER):
                then = (IN_LETTERS, IN_NUMBERS, IN_OTHER)[symbol]
                joins = state in (then, LED)
            elif symbol in (S_CONTRACT_1, S_CONTRACT_2):
                joins = state in (IN_OTHER, LED)
                then = IN_OTHER if joins else (ONE if symbol == S_CONTRACT_1 else TWO)
            elif symbol == S_WHITE_MID:
                joins, then = state == IN_WHITE, IN_WHITE
            else:
                then = LED if symbol == S_SPACE_LAST else OUT
            step[state, symbol], cut[state, symbol] = then, not joins
    first = [tuple(step[:, s]) for s in range(8)] + [(step[OUT, s],) * 8 for s in range(8)]
    functions = list(dict.fromkeys([tuple(range(8)), *first]))
    for f in functions:  # grows until it is closed under composition with a symbol
        for g in first:
            h = tuple(g[s] for s in f)
            if h not in functions:
                functions.append(h)
    number = {f: i for i, f in enumerate(functions)}
    compose = np.zeros((len(functions), len(functions)), np.uint8)
    for f in functions:
        for g in functions:
            compose[number[f], number[g]] = number[tuple(g[s] for s in f)]
    cuts = np.ones((8, 16), bool)
    cuts[:, :8] = cut
    return np.array([number[f] for f in first], np.uint8), compose, np.array(functions, np.uint8), cuts


def scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive composition of all functions up to each place: scans blocks side by side, then their totals."""
    n = len(functions)
    if n <= 32:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], functions[i]]
        return out
    height = min(512, int(n**0.5) + 1)
    width = -(-n // height)
    block = np.zeros((width, height), np.uint8)  # function 0 is the identity
    block.reshape(-1)[:n] = functions
    block = np.ascontiguousarray(block.T)
    flat, size = compose.reshape(-1), np.int32(len(compose))
    for i in range(1, height):
        block[i] = flat[block[i - 1] * size + block[i]]
    before = np.concatenate([np.zeros(1, np.uint8), scan(block[-1], compose)[:-1]])
    block = flat[before[None, :] * size + block]
    return np.ascontiguousarray(block.T).reshape(-1)[:n]


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for the code points of several texts; firsts: where each non-empty text starts."""
    kind = code_point_classes()[points]
    n = len(kind)
    white = (kind == SPACE) | (kind == BLANK)
    is_first = np.zeros(n + 1, bool)
    is_first[firsts] = is_first[n] = True
    following = np.empty(n, bool)  # white space or the end of the text follows
    following[:-1], following[-1:] = white[1:], True
    following |= is_first[1:]
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_SPACE_LAST, S_BLANK_LAST, S_OTHER], np.uint8)[kind]
    symbol[white & following] = S_WHITE_MID
    marks = np.flatnonzero(kind == APOSTROPHE)
    if len(marks):
        ahead = np.zeros((2, len(marks)), np.uint32)
        for k in (1, 2):
            at = np.minimum(marks + k, n - 1)
            ahead[k - 1] = np.where((marks + k < n) & ~is_first[np.minimum(marks + k, n)] & (ahead[0] > 0 if k == 2 else True), points[at], 0)
        one = np.isin(ahead[0], [ord(c) for c in "stmd"])
        two = np.isin(ahead[0] * 256 + np.minimum(ahead[1], 255), [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & (ahead[0] < 256)
        symbol[marks[one]], symbol[marks[two]] = S_CONTRACT_1, S_CONTRACT_2
    symbol[firsts] += 8
    of_symbol, compose, states, cuts = automaton()
    after = states[:, OUT][scan(of_symbol[symbol], compose)]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = OUT, after[:-1]
    return cuts.reshape(-1)[before.astype(np.int16) * 16 + symbol]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Pieces:
    """The bytes of all ids as flat arrays: all that decoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        ordered = sorted(ranks, key=ranks.get)
        self.sizes = np.zeros(ranks[ordered[-1]] + 1, np.int64)
        self.sizes[[ranks[t] for t in ordered]] = lengths(ordered)
        self.starts = ends_of(self.sizes)[:-1]
        self.bytes = np.frombuffer(b"".join(ordered), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and each id's number of bytes."""
        sizes = self.sizes[ids]
        return self.bytes[ragged(self.starts[ids], sizes)], sizes


class Vocabulary(Pieces):
    """Ranks of byte strings, and a hashed table of the pairs of ids that merge."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        super().__init__(self.ranks)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int32)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = np.append(keys[order], np.uint64(2**64 - 1)), np.append(values[order], NONE)
        counts = np.bincount(slot, minlength=1 << 20)
        self.first, self.most = ends_of(counts).astype(np.int32), int(counts.max())

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's concatenation, NONE where it has none."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = self._slot(keys)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(keys), NONE, np.int32)
        left = np.flatnonzero(at < end)
        for _ in range(self.most):
            if not len(left):
                break
            here = at[left]
            hit = self.keys[here] == keys[left]
            out[left[hit]] = self.values[here[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def encode_slices(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many slices, one after the other, and how many each has."""
        sizes = lengths(slices)
        counts, parts = np.zeros(len(slices), np.int64), []
        whole = np.fromiter((self.ranks.get(s, -1) for s in slices), np.int64, len(slices))
        done = np.flatnonzero(whole >= 0)
        counts[done] = 1
        parts.append((done, whole[done].astype(np.int32)))
        low = 0
        for high in (8, 16, LONG_SLICE):
            these = np.flatnonzero((whole < 0) & (sizes > low) & (sizes <= high))
            for i in range(0, len(these), 20_000):
                some = these[i : i + 20_000]
                ids, n = self._merge_together([slices[j] for j in some], sizes[some], high)
                counts[some] = n
                parts.append((some, ids))
            low = high
        for j in np.flatnonzero((whole < 0) & (sizes > LONG_SLICE)):
            ids = self._merge_long(slices[j])
            counts[j] = len(ids)
            parts.append((np.array([j]), ids))
        starts = ends_of(counts)
        out = np.empty(starts[-1], np.int32)
        for which, ids in parts:
            out[ragged(starts[which], counts[which])] = ids
        return out, counts

    def _merge_together(self, slices: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """One merge per slice and round: the leftmost of the lowest rank, as a slice on its own would be merged."""
        n, flat = len(slices), np.frombuffer(b"".join(slices), np.uint8)
        ids = np.full((n, width + 1), -1, np.int32)
        rows = np.repeat(np.arange(n), sizes)
        columns = ragged(np.zeros(n, np.int64), sizes)
        ids[rows, columns] = self.single[flat]
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (n, 1))
        ahead = np.tile(np.arange(-1, width, dtype=np.int16), (n, 1))
        rank = np.full((n, width), NONE, np.int32)
        r, c = np.nonzero(ids[:, 1:] >= 0)
        rank[r, c] = self.merged(ids[r, c], ids[r, c + 1])
        live = np.arange(n)
        while len(live):
            at = rank[live].argmin(1) if len(live) < n else rank.argmin(1)
            best = rank[live, at]
            going = best < NONE
            live, at, best = live[going], at[going], best[going]
            if not len(live):
                break
            gone = after[live, at]
            then = after[live, gone]
            ids[live, at], ids[live, gone] = best, -1
            after[live, at] = then
            rank[live, at] = NONE
            more = gone < width
            rank[live[more], gone[more]] = NONE
            has = then < width
            has[has] = ids[live[has], then[has]] >= 0
            l, a, t = live[has], at[has], then[has]
            ahead[l, t] = a
            rank[l, a] = self.merged(best[has], ids[l, t])
            p = ahead[live, at]
            has = p >= 0
            l, p = live[has], p[has]
            rank[l, p] = self.merged(ids[l, p], best[has])
        kept = ids >= 0
        return ids[kept], kept.sum(1)

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Merging one long slice with a heap of (rank, place), in O(n log n)."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # where the part that starts here ends; 0: merged away
        start_before = list(range(-1, n - 1))
        heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        longest = int(self.sizes.max())

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n:
                middle, last = end[i], end[end[i]]
                if last - i <= longest and (rank := ranks.get(piece[i:last])) is not None:
                    heapq.heappush(heap, (rank, i, middle, last))

        while heap:
            _, i, middle, last = heapq.heappop(heap)
            if end[i] != middle or end[middle] != last:
                continue
            end[i], end[middle] = last, 0
            if last < n:
                start_before[last] = i
            offer(i)
            offer(start_before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return np.array(out, np.int32)

@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """Read once per worker process; the file is part of the installation on every node."""
    return Vocabulary(path)


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    """For workers that only decode."""
    return Pieces(read_ranks(path))


class Encoder:
    """Encodes batches of texts, keeping the ids of slices it has met."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.flat, self.starts, self.counts = Numbers(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[bytes], cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, byte offset in the joined texts at which each token ends, number of tokens of each text).

        cuts: byte offsets in the joined texts at which a new pre-token has to start, as at a document's start.
        """
        sizes = lengths(texts)
        blob = b"".join(texts)
        if not blob:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(blob, np.uint8)
        points = np.frombuffer(blob.decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        text_starts = ends_of(sizes)
        starts = text_starts[:-1][sizes > 0]
        if cuts is not None:
            starts = np.union1d(starts, cuts[cuts < len(raw)])
        starts_at = lead[boundaries(points, np.searchsorted(lead, starts))]
        del points
        marked = np.full(len(raw) + len(starts_at) - 1, 0xFF, np.uint8)  # 0xFF never occurs in UTF-8
        shift = np.zeros(len(raw), np.int32)
        shift[starts_at[1:]] = 1
        marked[np.arange(len(raw)) + np.cumsum(shift)] = raw
        slices = marked.tobytes().split(b"\xff")
        del marked, shift
        if len(self.numbers) > CACHE_SLICES:
            self._forget()
        known = len(self.numbers)
        which = np.fromiter(map(self.numbers.__getitem__, slices), np.int64, len(slices))
        if len(self.numbers) > known:
            keys = list(self.numbers)
            ids, counts = self.vocabulary.encode_slices(keys[known:])
            self.starts = np.concatenate([self.starts, len(self.flat) + ends_of(counts)[:-1]])
            self.flat, self.counts = np.concatenate([self.flat, ids]), np.concatenate([self.counts, counts])
        counts = self.counts[which]
        ids = self.flat[ragged(self.starts[which], counts)]
        ends = np.cumsum(self.vocabulary.sizes[ids])
        return ids, ends, np.diff(np.searchsorted(ends, text_starts, side="right"))


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column from all rows' unsigned 32-bit integers."""
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((ends_of(sizes) * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, np.uint32))])


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``token_ids``, ``token_ends`` (see the module's contract)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts = texts_as_bytes(batch)
            ids, ends, counts = encoder.encode(texts)
            ends = ends - np.repeat(ends_of(lengths(texts))[:-1], counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(ids, counts), _packed(ends, counts)], names=["id", "token_ids", "token_ends"])

    kept = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return kept.mapInArrow(run, f"id {kind}, token_ids binary, token_ends binary").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: id, the columns in ``keep``, and ``decoded`` (the bytes of ``token_ids``; null counts as none)."""
    bounded_batches(encoded.sparkSession)
    columns = [id_column, *keep]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in columns) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in batches:
            packed = texts_as_bytes(batch, "token_ids_in")
            counts = lengths(packed) // 4
            data, sizes = table.decode(np.frombuffer(b"".join(packed), np.uint32))
            ends = ends_of(sizes)[ends_of(counts)].astype(np.int32)
            decoded = pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), decoded], names=[*columns, "decoded"])

    return encoded.select(*columns, F.col("token_ids").alias("token_ids_in")).mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of tokens, and digests of the packed ids and of the bytes decoded from them."""
    decoded = decode(encode(docs, path), path, keep=("token_ids",))
    return decoded.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
