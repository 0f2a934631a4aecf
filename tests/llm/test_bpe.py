import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from corpusweft.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def judge():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    bits = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "B", "9", "٣", "é", "中", "😀", "!", "?", " ", "　", "\r", "x", "e"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(3000)]
    long = ["a" * 3000, "ab" * 2000, " " * 2000, "!?" * 900, "".join(chr(rng.randint(0x80, 0x2FFF)) for _ in range(3000)), "thou and the " * 9000]
    return [*texts, "", " ", "'", "'r", *long]


def test_encode_equals_the_library_and_offsets_fit(judge):
    texts = odd_texts()
    encoder = bpe.Encoder(PATH)
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        ids, ends, counts = encoder.encode([t.encode() for t in some])
        stops = np.cumsum(counts)
        joined = "".join(some).encode()
        for text, stop, count in zip(some, stops, counts):
            own = ids[stop - count : stop].tolist()
            assert own == judge.encode_ordinary(text), repr(text)
        starts = [0, *ends[:-1]]
        assert all(joined[a:b] == judge.decode_single_token_bytes(i) for a, b, i in zip(starts, ends, ids.tolist()))


def test_query_rows(spark, judge):
    rows = [(1, "it's  the 1st", "x"), (2, None, None), (3, "", "y"), (None, "naïve 中文", "z"), (1, "it's  the 1st", "x"), (5, "w " * 60_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = sorted(map(tuple, bpe.token_digests(docs, PATH).collect()), key=str)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    ids = [(i, judge.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows]
    want = [(i, len(x), digest(np.array(x, "<u4").tobytes()), digest(t)) for i, x, t in ids]
    assert got == sorted(want, key=str)
    assert bpe.token_digests(docs.limit(0), PATH).count() == 0
