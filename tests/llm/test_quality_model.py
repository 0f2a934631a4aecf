import random

import numpy as np

from corpusweft.llm import quality_model as qm


def test_forest_learns_an_interaction_and_flattened_trees_agree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = qm.fit_forest(x[:3000], y[:3000])
    assert ((forest.chance(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95

    def slow(row):
        total = forest.start
        for at in forest.roots:
            while forest.child[at] >= 0:
                at = forest.child[at] + int(row[forest.feature[at]] > forest.threshold[at])
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([slow(r) for r in x[3000:3050]], forest.chance(x[3000:3050]))


def test_held_out_scores_and_edges(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        rows.append((i, " ".join(word() + ("" if good else rng.choice(["###", "!!", "%%"])) for _ in range(rng.randint(5, 60))), "en", "s"))
        labels.append((i, int(good), 0))
    rows += [(5000, None, None, None), (5001, "", "en", "s"), (None, "plain words here", "en", "s"), (5002, "word " * 50_000, "en", "s"), rows[0]]
    labels += [(6000, 1, 0), (5001, None, None), (None, 1, 0)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, source string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = qm.scored(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    assert {r.score for r in qm.scored(docs, marks.limit(0)).collect()} == {0.5}
    assert qm.scored(docs.limit(0), marks).count() == 0


def plain_forest(x, y):
    """The same boosting without histograms: every split of every node is tried by looking at all rows."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, qm.BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    prior = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(prior / (1 - prior)))
    margin, trees = np.full(len(y), start), []
    for _ in range(qm.TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(rows, depth):
            leaf = -qm.RATE * g[rows].sum() / (h[rows].sum() + qm.PENALTY)
            best = (1e-6, None)
            for f, e in enumerate(edges) if depth < qm.DEPTH else ():
                for t in e.tolist():
                    left = rows[x[rows, f] <= t]
                    a, b = h[left].sum(), h[rows].sum() - h[left].sum()
                    if a < qm.LEAST_WEIGHT or b < qm.LEAST_WEIGHT:
                        continue
                    c, d = g[left].sum(), g[rows].sum() - g[left].sum()
                    gain = c**2 / (a + qm.PENALTY) + d**2 / (b + qm.PENALTY) - g[rows].sum() ** 2 / (h[rows].sum() + qm.PENALTY)
                    if gain > best[0] + 1e-9:
                        best = gain, (f, t)
            if best[1] is None:
                return leaf
            f, t = best[1]
            low = x[rows, f] <= t
            return f, t, grow(rows[low], depth + 1), grow(rows[~low], depth + 1)

        def value(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        tree = grow(np.arange(len(y)), 0)
        trees.append(tree)
        margin += [value(tree, r) for r in x]
    return lambda row: 1 / (1 + np.exp(-(start + sum(value(t, row) for t in trees))))


def test_scores_of_documents_match_plain_boosting(spark, monkeypatch):
    """From texts and labels to scores, against trees that are grown and walked the plain way."""
    import zlib

    monkeypatch.setattr(qm, "TREES", 6)
    monkeypatch.setattr(qm, "DEPTH", 3)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    good = [rng.random() < 0.6 for _ in range(220)]
    texts = [" ".join(word() + ("" if g or rng.random() < 0.4 else "##!") for _ in range(rng.randint(5, 40))) for g in good]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int")
    x = qm.statistics([t.encode() for t in texts])
    learn = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    plain = plain_forest(x[learn].astype(np.float32), np.array([float(good[i]) for i in learn]))
    got = {r.doc_id: r.score for r in qm.scored(docs, marks).collect()}
    assert np.mean([abs(got[i] - plain(x[i])) < 1e-6 for i in range(len(texts))]) > 0.98
