import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from corpusweft.llm import suffix_dedup as sd

L = sd.LENGTH


def cuts(texts):
    """(bytes, whether each byte goes) of each text."""
    texts = [(t or "").encode() for t in texts]
    found = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - L + 1):
            found[t[i : i + L]].append((d, i))
    cut = [np.zeros(len(t) + 1, bool) for t in texts]
    for places in found.values():
        if len(places) > 1:
            for d, i in places:
                cut[d][i : i + L] = True
    return zip(texts, cut)


def brute(texts):
    out = []
    for t, c in cuts(texts):
        kept = bytes(b for b, gone in zip(t, c) if not gone)
        out.append((len(t), int(c.sum()), int((np.diff(c.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    passages = [noise(rng.choice([L - 30, L - 1, L, L + 1, 700, 1500])) for _ in range(12)]
    texts = [noise(rng.randint(0, 900)) for _ in range(25)]
    for _ in range(60):
        parts = [noise(rng.choice([0, 1, 3, 50, 300]))]
        for _ in range(rng.randint(1, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.choice([0, 0, 5, 100]), rng.choice([len(p), len(p), len(p) - 7])))
            parts += [p[a:b], noise(rng.choice([0, 1, 2, 40]))]
        texts.append("".join(parts))
    texts += [texts[40]] * 5 + [texts[3]] * 2 + ["x" * 1500, "y" * 399, "xy" * 700, "z" * 401, noise(200) + passages[4] + passages[4]]
    base = noise(2500)
    for _ in range(12):  # near copies, changed in one place each
        i = rng.randrange(len(base))
        texts.append(base[:i] + "#" + base[i + 1 :])
    return texts + [None, "", "short"]


@pytest.mark.parametrize("hot", [sd.HOT_LEAD, 3])
def test_removals_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT_LEAD", hot)
    monkeypatch.setattr(sd, "AT_ONCE", 500)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in sd.removal_digests(docs).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_null_ids_and_empty_table(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=500))
    docs = spark.createDataFrame([(None, long), (None, long), (1, "q" + long[:399])], "doc_id long, text string")
    assert sorted(r.n_removed for r in sd.removal_digests(docs).collect()) == [0, 500, 500]
    assert sd.removal_digests(docs.limit(0)).count() == 0
