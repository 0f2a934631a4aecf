"""What a query works out once, where it did so many times over."""

import re

from pyspark.sql import functions as F

from corpusweft.functions import chunks as C
from corpusweft.operators import caps, cases, chunking, drafts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_formula_is_one_pattern_and_comes_first(spark):
    texts = [chr(n) for n in range(1, 0x3000) if not 0xD800 <= n < 0xE000] + ["a/ b", "a/1", "/\n x", "/", "", "é / ü", "\U0001d400", "a / \t b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    assert df.filter(C.is_formula(t) != (t.rlike(C.MATH) | t.rlike(C.SCRIPTS))).count() == 0
    assert plan(chunking.formula_candidates(spark, "/root/testdata/sf0.001")).count("(?=[=^_/") >= 1


def test_stripped_takes_white_space_before_no_line_separator(spark):
    df = spark.createDataFrame([(" \t  a\x0b ",), ("a  ",), ("\r\n\x0c",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(C.stripped(F.col("t")).alias("x")).collect()] == ["  a", "a  ", "", "", None]


def test_content_rules_cut_a_text_once(spark):
    df = spark.createDataFrame([("t", "intro", "x vfd lci vfd\n\n# y\n## 1\n \n[[ASSET:A:b]] z"), ("t", "intro", None)], "title string, kind string, text string")
    found = df.select(drafts.content_issues(F.col("title"), F.col("kind"), F.col("text"), ["lci."], [("VFD", ["LCI"])]).alias("i"))
    assert len(re.findall(r"split\(", plan(found))) <= 2  # into lines and into paragraphs
    assert [[x.code for x in r.i] for r in found.collect()] == [["KW010"], []]


def test_caps_tell_names_of_reasons_once(spark):
    for step in (caps.parent_competition, caps.support_tail_caps):
        told = plan(step(spark, "/root/testdata/sf0.001"))
        assert told.count("substring_index(") == 1


def test_broad_words_are_looked_for_in_a_heading_normalised_once(spark):
    df = spark.createDataFrame([("1 系统 方案",), ("a.b",), ("axb",), ("",), (None,)], "h string")
    out = [r.x for r in df.select(cases.is_broad(F.col("h"), ("系统方案", "ab")).alias("x")).collect()]
    assert out == [True, True, False, False, None]
    assert [r.x for r in df.select(cases.is_broad(F.col("h"), ()).alias("x")).collect()][:1] == [False]
    assert plan(df.select(cases.is_broad(F.col("h")))).count("btrim") + plan(df.select(cases.is_broad(F.col("h")))).count("BOTH") <= 1


def test_terms_of_many_texts_go_on_as_one_row_each(spark):
    import random

    from corpusweft.operators import aggregates

    rng = random.Random(6)
    words = sorted({"".join(rng.choices("abcdefghij", k=4)) for _ in range(700)})
    texts = [[(i % 2 and "x") or None, " ".join(rng.choices(words, k=80)), f"s{i % 5}"] for i in range(700)] + [["x", None, "s9"], ["x", "", "s9"]]
    df = spark.createDataFrame(texts, "lang string, text string, source string").repartition(3)
    n, n_docs, places = {}, {}, {}
    for lang, text, source in texts:
        own = (text or "").split()
        for t in [*own, *map(" ".join, zip(own, own[1:]))]:
            n[lang, t] = n.get((lang, t), 0) + 1
            places.setdefault((lang, t), set()).add(source)
        for t in {*own, *map(" ".join, zip(own, own[1:]))}:
            n_docs[lang, t] = n_docs.get((lang, t), 0) + 1
    want = set()
    for lang in ("x", None):
        best = sorted((-c, t) for (g, t), c in n.items() if g == lang and t != words[0] and c >= 3)[:30]
        want |= {(lang, t, -c, n_docs[lang, t], tuple(sorted(places[lang, t])[:3]), k + 1) for k, (c, t) in enumerate(best)}
    rows = aggregates.mined_terms(df, "lang", [words[0]], 3, 30, "source").collect()
    assert {(r.lang, r.term, r.n, r.n_docs, tuple(r.examples), r.rank) for r in rows} == want
    few = spark.createDataFrame([["x", "aa bb aa bb aa bb cc", "s"], ["x", "aa bb cc", "t"]], "lang string, text string, source string")
    found = {(r.term, r.n, r.n_docs, r.rank) for r in aggregates.mined_terms(few, "lang", ["bb"], 3, 30, "source").collect()}
    assert found == {("aa", 4, 2, 1), ("aa bb", 4, 2, 2)}
    assert aggregates.mined_terms(few.limit(0), "lang", ["bb"], 3, 30, "source").collect() == []


def test_codes_are_counted_in_all_and_by_text():
    import numpy as np

    from corpusweft.operators import aggregates

    codes, n, n_docs = aggregates.counted(np.array([3, 1, 3, 3, 1]), np.array([0, 0, 0, 1, 2]))
    assert (codes.tolist(), n.tolist(), n_docs.tolist()) == ([1, 3], [2, 3], [2, 2])
    assert [len(x) for x in aggregates.counted(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0, 0]


def test_plain_text_is_worked_out_once_for_a_line(spark):
    from corpusweft.operators import similar

    df = spark.createDataFrame([(1, "x" * 80)], "section_id long, text string")
    plan = similar.with_plain(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_section_tree_deals_rows_once_and_knows_all_ancestors(spark):
    import random

    from corpusweft.operators import chunking

    rng = random.Random(8)
    rows = [(d, p * 3, rng.randint(0, 10), f"t{p}") for d in range(12) for p in range(60)] + [(None, 1, 1, "x"), (None, 2, 2, "y")]
    want = {(None, 1): ("1", None, "x"), (None, 2): ("2", None, "y")}
    for d in range(12):
        made, stack = {}, []
        for _, p, level, title in (r for r in rows if r[0] == d):
            over = [s for s in stack if s[0] < level]
            above = over[-1] if over else (0, "", "")
            made[above[1]] = made.get(above[1], 0) + 1
            number = f"{above[1]}.{made[above[1]]}".lstrip(".")
            path = f"{above[2]} > {title}" if over else title
            want[d, p] = (number, above[1] or None, path)
            if 1 <= level <= 8:  # others are no parents
                stack = [*over, (level, number, path)]
    found = chunking.section_tree(spark.createDataFrame(rows, "doc_id long, place long, level int, title string"))
    assert {(r.doc_id, r.place): (r.section_id, r.parent_id, r.path) for r in found.collect()} == want
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1


def test_pairs_of_blocks_work_out_no_patterns(spark, monkeypatch):
    """What a request or a block alone tells comes before they meet."""
    from corpusweft.operators import search

    plans = []

    def kept(df):
        plans.append(plan(df))
        raise StopIteration

    monkeypatch.setattr(search, "checkpointed", kept)
    try:
        search.ranked_blocks(spark, "/root/testdata/sf0.001")
    except StopIteration:
        pass
    pairs, _, apart = plans[0].partition("Join")
    assert "regexp_replace(" in apart and not re.search(r"regexp_(replace|extract)\(|RLIKE", pairs)


def test_broad_headings_are_told_once_before_the_windows(spark):
    told = plan(cases.broad_parents(spark, "/root/testdata/sf0.001"))
    top, window, below = told.partition("Window")
    assert "RLIKE" in below and "RLIKE" not in top
