import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusweft.llm import packing as pk

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def brute(rows, size):
    t = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), size):
            part = np.array(ids[k : k + size], "<u4").tobytes()
            out.append((i, k // size, k, len(part) // 4, zlib.crc32(part)))
    return sorted(out, key=str)


def check(out, size, documents=None, attention=None):
    """Sequences are gapless from 0 and within every capacity; the number of sequences."""
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size and len(parts) <= (documents or size) and sum(n * n for _, n in parts) <= (attention or size * size)
    return len(by)


ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "a" * 50_000), (4, "Hello, WORLD's it's 12 345!!! don't"), (5, "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>"), (6, "é É İ ΣΣ   　 \x85 \x1c\x1f z"),
    (7, "tab\tnew\nline\rform\x0cvert\x0bend"), (8, "\x01 fence \x01\x01 a\x01b"), (9, "\U0001f600 中文字 مرحبا 한글"), (10, "word " * 9_000), (11, "́leading mark"), (12, "...,,, -- $$$ a,b.c"), (13, "H\u0331, I\u0307. dogs' \u2026, \u00e9\u2026! It'S, A<|endoftext|>. X'LL... (Yes) \U0001d400, 9's"),
]


def test_pieces_match_the_tokenizer(spark):
    rows = ODD + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(4, ODD[4][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, piece int").repartition(4)
    for size in (2048, 100):
        found = [tuple(r) for r in pk.pieces(df, PATH, size).collect()]
        assert sorted(found, key=str) == brute(rows, size)


def test_packed_rows_and_ids_read_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pk.packed(docs, PATH).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute(rows, 2048)
    assert check(out, 2048) <= -(-sum(r.length for r in out) // 2048) + 1  # no packing can have less than one fewer
    parts = pk.pieces(docs, PATH, keep_ids=True).persist()
    whole = {r.sequence_id: r.ids for r in pk.assembled(pk.pack(parts)).collect()}
    for r in pk.pack(parts).collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(spark, rule):
    rng = random.Random(3)
    sizes = [min(100, int(rng.expovariate(1 / 40)) + 1) for _ in range(3000)] + [7] * 4000  # one length has most rows
    df = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    capacity = pk.Capacity(tokens=200, documents=6, attention=12_000, rule=rule) if rule == "norm" else pk.Capacity(tokens=200, documents=50, attention=200 * 200, rule=rule)
    out = pk.pack(df, capacity).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(sizes)))
    used = check(out, 200, capacity.documents, capacity.attention)
    least = max(-(-sum(sizes) // 200), -(-len(sizes) // capacity.documents), -(-sum(n * n for n in sizes) // capacity.attention))
    assert used <= 1.2 * least  # the bound takes each capacity alone


def test_a_piece_beyond_a_capacity_is_an_error():
    with pytest.raises(ValueError):
        pk.planned({200: 1}, pk.Capacity(tokens=200, attention=100))


def test_plan_against_one_by_one_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, 65), 20)}
        plan = pk.planned(counts, pk.Capacity(tokens=64, documents=64, attention=4096, weights=(1, 0, 0)))
        room = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fits = [(left - n, k) for k, left in enumerate(room) if left >= n]
                if fits:
                    room[min(fits)[1]] -= n
                else:
                    room.append(64 - n)
        assert (plan[:, 3] + plan[:, 2]).max() <= len(room) + 1
        assert {n: int(plan[plan[:, 0] == n, 2].sum()) for n in counts} == counts


def test_hot_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pk, "PER_SALT", 100)
    df = spark.createDataFrame([(i % 50, 0, 0, 5, 1) for i in range(2000)] + [(None, 0, 0, 3, 1)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert sorted(r["rank"] for r in pk.ranked(df, "doc_id", {5: 2000, 3: 1}).filter("length = 5").collect()) == list(range(2000))
    assert check(pk.pack(df, pk.Capacity(tokens=16, documents=16, attention=256)).collect(), 16) <= 1.01 * 2000 / 3


def test_empty_table_and_text_ids(spark):
    assert pk.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    out = pk.packed(spark.createDataFrame([("a", "one"), (None, None)], "doc_id string, text string"), PATH).collect()
    assert check(out, 2048) == 1 and sorted(r.length for r in out) == [1, 2]
