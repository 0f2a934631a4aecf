import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusweft.functions import headings as H
from corpusweft.functions import text as T
from corpusweft.operators import lookups, ranking


def test_a_task_keeps_the_best_over_all_batches():
    draw = np.random.default_rng(1)
    best, seen = ranking.Best(3, 4), []
    for _ in range(9):
        row, ids, score = draw.integers(0, 3, 30000), draw.permutation(30000), draw.integers(0, 5000, 30000) / 8
        best.add(row, pa.array(ids), score)
        seen += zip(row, -score, ids)
    assert best.size <= 1 << 16
    row, ids, score = best.all()
    assert list(zip(row, -score, ids.to_pylist())) == [x for r in range(3) for x in sorted(v for v in seen if v[0] == r)[:4]]


def test_scores_of_many_queries_need_no_large_matrix(spark):
    draw = np.random.default_rng(2)
    vectors = [(i, v) for i, v in enumerate(draw.integers(-3, 4, (3000, 3)).astype(float).tolist())]
    points = spark.createDataFrame(vectors, "id long, vector array<double>").coalesce(1)
    asked = spark.createDataFrame(vectors[:700] + [(9000, [1.0]), (9001, [])], "query_id long, vector array<double>")
    x = np.array([v for _, v in vectors])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    score = unit(x[:700]) @ unit(x).T
    got = {}
    for r in ranking.dense_top_k(points, asked, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.id))
    assert set(got) == {*range(700), 9000, 9001}
    for i in range(700):
        assert np.allclose([s for _, s, _ in sorted(got[i])], np.sort(score[i])[::-1][:3])
    assert [n for _, _, n in sorted(got[9001])] == [0, 1, 2]  # all scores are 0


def test_requests_for_global_assets_are_dealt_out(spark):
    requests = spark.createDataFrame([(i, "p", True, [], [], []) for i in range(300)], "request_id long, project_id string, with_global boolean, asset_types array<string>, doc_types array<string>, names array<string>")
    assets = spark.createDataFrame([(1, 1, "table", True), (2, 2, "table", True)], "asset_id long, raw_id long, asset_type string, usable boolean")
    raws = spark.createDataFrame([(1, "q", "global", "own", "d"), (2, "p", "global", "own", "d")], "raw_id long, project_id string, scope string, doc_type string, name string")
    found = lookups.assets_of_requests(requests, assets, raws)
    assert sorted((r.request_id, r.asset_id) for r in found.collect()) == [(i, a) for i in range(300) for a in (1, 2)]
    assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()


def test_assets_of_requests_are_not_shuffled_once_found(spark):
    """Against a plain loop, with ids that ask more than once, and without a window over what is found."""
    rng = random.Random(11)
    pick = lambda *values: rng.choice(values)
    requests = [(pick(None, *range(150)), pick(None, "p", "q", "r"), pick(None, True, False), *(pick(None, [], ["", " "], [x], [x, y, x, None]) for x, y in (("table", "figure"), ("own", "old"), ("d1", "d9")))) for _ in range(120)]
    assets = [(i, i % 37, pick(None, "table", "figure", "chart"), pick(True, True, False, None)) for i in range(120)]
    raws = [(i, pick(None, "p", "q", "s"), pick("global", "project", None), pick(None, "own", "old"), pick(None, "d1", "d2", "d3")) for i in range(35)]
    by_raw, rows = {r[0]: r[1:] for r in raws}, []
    for request, project, world, *wanted in requests:
        types, docs, names = ([x for x in w or [] if x and x.strip()] for w in wanted)
        for asset, raw, kind, usable in assets:
            owner, scope, doc, name = by_raw.get(raw, (None,) * 4)
            if usable and raw in by_raw and ((project is not None and owner == project) or (world and scope == "global")) and (not types or kind in types) and (not docs or doc in docs):
                rows.append((request, asset, raw, not names or name in names))
    some = {r[0] for r in rows if r[3]}
    found = lookups.assets_of_requests(
        spark.createDataFrame(requests, "request_id long, project_id string, with_global boolean, asset_types array<string>, doc_types array<string>, names array<string>"),
        spark.createDataFrame(assets, "asset_id long, raw_id long, asset_type string, usable boolean"), spark.createDataFrame(raws, "raw_id long, project_id string, scope string, doc_type string, name string"))
    order = lambda r: tuple((x is not None, x) for x in r)
    want = [r for r in rows if r[3] or r[0] not in some]
    assert sorted(map(tuple, found.collect()), key=order) == sorted(want, key=order)
    assert {a for *_, a in want} == {True, False} and len(want) < len(rows)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_are_found_as_by_looking_for_each():
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab中", k=rng.randint(0, 400))) for _ in range(60)] + ["", "a", "b" * 40]
    phrases = [t[i : i + n] for t in texts for n in (1, 15, 16, 17, 60) for i in (0, 3)] + ["", "c" * 20, texts[3][-16:] + texts[4][:16], texts[5]]
    want = {(i, j) for i, p in enumerate(phrases) if p for j, t in enumerate(texts) if p in t}
    assert ranking.Phrases(phrases).inside(texts) == want
    assert ranking.Phrases(["", "a"]).inside([]) == ranking.Phrases([]).inside(["abc"]) == set()


def test_a_task_sends_on_its_best_and_a_text_is_digested_once(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 5} common") for i in range(3000)], "id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "common word3"), (2, "other2"), (3, None)], "query_id long, text string")
    sent = []
    real = ranking._ranked
    ranking._ranked = lambda hits, k: sent.append(hits.count()) or real(hits, k)
    try:
        out = ranking.sparse_top_k(docs, asked, 4).collect()
    finally:
        ranking._ranked = real
    assert sent == [8]
    assert sorted((r.query_id, r.rank, r.id) for r in out) == [(1, n + 1, 3 + 7 * n) for n in range(4)] + [(2, n + 1, 2 + 5 * n) for n in range(4)]
    own = docs.limit(1).select(T.fallback_vector(F.col("text")).alias("v"))
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2(") < plan.index("lambdafunction(")  # the argument of the outer lambda, not a part of it
    assert len(own.first().v) == 64


def test_the_compact_form_is_the_normalised_one_without_spaces_by_one_pattern_less(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choices(" \t\n\x0b\f\r\u3000\u00a0.。·…:：+,，、;；/\\-()（）[]【】12第三章节一中ab", k=rng.randint(0, 14))),) for _ in range(20000)] + [(None,)]
    df = spark.createDataFrame(rows, "text string")
    text = F.col("text")
    plain = F.replace(H.normalised(text), F.lit(" "), F.lit(""))
    assert df.filter(~plain.eqNullSafe(H.compact(text))).count() == 0
    assert df.select(H.compact(text).alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
