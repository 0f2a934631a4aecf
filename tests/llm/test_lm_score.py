import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusweft.llm import lm_score as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), " "]


def ppm(training, texts, order):
    """Prediction by partial matching with exclusion, symbol by symbol; shorter contexts count the longer ones in which a symbol occurs."""
    seen = defaultdict(Counter)
    for t in training:
        data = bytes([255]) * order + (t or "").encode() + b"\xff"
        for i in range(order, len(data)):
            seen[data[i - order : i]][data[i]] += 1
    for k in range(order, 0, -1):
        for context in [c for c in seen if len(c) == k]:
            for symbol in seen[context]:
                seen[context[1:]][symbol] += 1
    out = []
    for t in texts:
        data, total = bytes([255]) * order + (t or "").encode() + b"\xff", 0.0
        for i in range(order, len(data)):
            excluded = set()
            for k in range(order, -1, -1):
                own = {s: c for s, c in seen.get(data[i - k : i], {}).items() if s not in excluded}
                if not own:
                    continue
                rest = sum(own.values())
                if data[i] in own:
                    total += math.log10((own[data[i]] - lm.DISCOUNT) / rest)
                    break
                total += math.log10(lm.DISCOUNT * len(own) / rest)
                excluded |= own.keys()
            else:
                total += math.log10(1 / (256 - len(excluded)))
        out.append(total)
    return out


def corpus():
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["the", "Then", "thou", "and", "é", "an", "x9", "\n"], k=rng.randint(0, 25))) for _ in range(120)]
    return [(i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, "never seen Ω"), (203, "the " * 4000), (None, "the and"), (5, texts[5])]


def test_scores_match_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    learn = [t for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    counts = Counter(w for t in learn for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, t), score in zip(rows, ppm(learn, [t for _, t in rows], lm.ORDER)):
        own = words_of(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((i, zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0, len(own), sum(counts[w] > 0 for w in own), n, base, score))
    got = sorted(map(tuple, lm.corpus_scores(docs).collect()), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in sorted(want, key=str)]
    for a, b in zip(got, sorted(want, key=str)):
        assert a[5:] == pytest.approx(b[5:], rel=1e-5, abs=1e-6)


def test_chances_of_all_symbols_add_up_to_one():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcd efgh", weights=range(1, 10), k=300)).encode() for _ in range(30)]
    grams = lm.padded(texts)[0]
    counts = [np.unique(grams, return_counts=True)]
    for _ in range(lm.ORDER):
        counts.append(lm.shortened(counts[-1][0]))
    trie = lm.Trie(lm.build_levels(counts[::-1]))
    every = np.arange(256, dtype=np.uint64) << np.uint64(8 * lm.ORDER)
    for gram in [*grams[::97], np.uint64(0x7A)]:
        context = gram & np.uint64((1 << 8 * lm.ORDER) - 1)
        assert (10.0 ** trie.log_chance(context | every).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_empty_table_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(0, "a"), (1, None)], "doc_id long, text string")
    assert lm.corpus_scores(docs.limit(0)).count() == 0
    from pyspark.sql import functions as F

    rows = lm.scored(docs, F.lit(False)).collect()
    assert {r.n_known for r in rows} == {0} and all(r.score < 0 and r.train_tokens == 0 for r in rows)


def test_no_ngram_is_dropped_however_many_there_are(spark, monkeypatch):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789 "
    rows = [(i, "".join(rng.choices(letters, k=6000))) for i in range(90)]  # over 400,000 distinct n-grams of each long order
    rows += [(1000 + i, rows[i][1][:500] + "é" + rows[i + 1][1][-500:]) for i in range(20)] + [(1100, None), (1101, "")]
    learn = [t for i, t in rows if i < 90]
    some = [t for i, t in rows if i % 7 == 3 or i >= 1000]
    want = dict(zip([i for i, t in rows if i % 7 == 3 or i >= 1000], ppm(learn, some, lm.ORDER)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    for chunk, bucket in ((lm.CHUNK, lm.BUCKET_BYTES), (50_000, 30_000)):  # one chunk a task, and many of them
        monkeypatch.setattr(lm, "CHUNK", chunk)
        monkeypatch.setattr(lm, "BUCKET_BYTES", bucket)
        monkeypatch.setattr(lm, "AT_ONCE", min(lm.AT_ONCE, chunk))
        got = {r.doc_id: r.score for r in lm.scored(docs, F.col("doc_id") < 90).collect()}
        assert len(got) == len(rows)
        assert {i: got[i] for i in want} == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_held_out_texts_cost_less_than_by_the_unigram_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n, base, score = lm.corpus_scores(docs).filter("held_out").selectExpr("sum(n_tokens)", "sum(base_score)", "sum(score)").first()
    assert score / n > base / n
