import random

import numpy as np

from corpusweft.llm import language_id as li

WORDS = {
    "en": "the of and to in that is was for it with as his on be at by".split(),
    "fr": "le la les des une est dans pour que qui sur avec être pas nous été".split(),
    "de": "der die und das nicht ein eine für auf mit über schön größe ist sich".split(),
}


def documents(n=400):
    rng = random.Random(8)
    for i in range(n):
        lang = rng.choice(list(WORDS))
        yield i, " ".join(rng.choices(WORDS[lang], k=rng.randint(8, 60))).capitalize() + ".", lang, "s"


def test_grams_are_those_of_a_plain_loop():
    texts = ["Ab, c!", "", "1 2", "É", "a" * 5000]
    hashed, owners, has = li.grams([t.encode() for t in texts])
    assert has.tolist() == [True, False, False, True, True]
    slow = []
    for t in texts:
        s = " "
        for c in t.lower():
            s += c if c.isalpha() else (" " if s[-1] != " " else "")
        slow.append([sum(1 for i in range(len(s) - k + 1) if (s[i : i + k].strip() if k == 1 else s[i : i + 2].strip())) for k in (1, 2, 3)])
    fast = [[int((o == i).sum()) for o in owners] for i in range(len(texts))]
    assert fast[0] == slow[0] and fast[4] == slow[4] and fast[1] == [0, 0, 0]


def test_held_out_languages_and_edges(spark):
    rows = [*documents(), (1000, None, "en", "s"), (1001, "", None, "s"), (1002, "12 .. 34", "fr", "s"), (None, "the of and to in that", None, None), (1003, "le la les " * 50_000, None, "s")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")
    got = {r.doc_id: r for r in li.identified(docs).collect()}
    assert len(got) == len(rows)
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in rows[:400] if got[i].held_out]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[None].lang_pred == "en" and got[1003].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "the", None, "s")], "doc_id long, text string, lang string, source string")
    assert li.identified(docs).first().lang_pred == "und"
    assert li.identified(docs.limit(0)).count() == 0


def test_scores_match_a_plain_model(spark):
    """FTRL over dicts of n-grams, the temperature and the scores, written plainly, on the same documents."""
    import math
    import zlib
    from collections import Counter, defaultdict

    rows = list(documents(160))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    def features(text):
        owner, feature, n, total = li.counts_of([text.encode()])  # n-grams themselves are held against a plain loop above
        return dict(zip(feature.tolist(), n.tolist())), int(total[0])

    learn = [(i, t, lang) for i, t, lang, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    counted = {i: features(t) for i, t, _ in learn}
    df = Counter(f for own, _ in counted.values() for f in own)
    idf = lambda f: math.log((1 + len(learn)) / (1 + df.get(f, 0))) + 1
    keys = {r.doc_id: r.key for r in docs.selectExpr("doc_id", "xxhash64(cast(doc_id as string), text, 'sample') as key").collect()}
    languages = sorted({lang for _, _, lang in learn})
    train, hold = [], []
    for k, (i, _, lang) in enumerate(sorted(learn, key=lambda r: (keys[r[0]], r[2]))):
        own, total = counted[i]
        values = {f: n / total * idf(f) * li.SCALE for f, n in own.items()} | {"bias": 1.0}
        (hold if k % 5 == 0 else train).append((values, languages.index(lang)))
    z, n = defaultdict(float), defaultdict(float)

    def weight(f, c):
        a = z[f, c]
        return 0.0 if abs(a) <= li.L1 else (math.copysign(li.L1, a) - a) / ((li.BETA + math.sqrt(n[f, c])) / li.ALPHA + li.L2)

    def chances(values, divisor=1.0):
        logits = [sum(v * weight(f, c) for f, v in values.items()) / divisor for c in range(len(languages))]
        e = [math.exp(x - max(logits)) for x in logits]
        return [x / sum(e) for x in e]

    order = np.random.default_rng(7)
    for _ in range(li.EPOCHS):
        for k in order.permutation(len(train)):
            values, label = train[k]
            p = chances(values)
            for c in range(len(languages)):
                error = p[c] - (c == label)
                for f, v in values.items():
                    g, w = v * error, weight(f, c)
                    grown = n[f, c] + g * g
                    z[f, c] += g - (math.sqrt(grown) - math.sqrt(n[f, c])) / li.ALPHA * w
                    n[f, c] = grown
    loss = lambda t: -sum(math.log(max(chances(v, t)[c], 1e-12)) for v, c in hold) / len(hold)
    t = min(np.geomspace(0.05, 20, 121).tolist(), key=loss)
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identified(docs).collect()}
    for i, text, _, _ in rows[:60]:
        own, total = features(text)
        p = chances({f: m / total * idf(f) * li.SCALE for f, m in own.items()} | {"bias": 1.0}, t)
        assert got[i][0] == languages[int(np.argmax(p))] and abs(got[i][1] - max(p)) < 2e-3
