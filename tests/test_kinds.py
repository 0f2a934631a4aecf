"""Rows that ask for the same are one kind, and only kinds meet what they ask for."""

import random
import re

from corpusweft.operators import evidence, knowledge


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sections_that_ask_for_the_same_meet_the_items_once(spark):
    rows = [(b, 100 * b + i, ("steel Pump", "pump steel", "none")[i % 3], ("a", None, "b")[i % 3], "e") for b in range(3) for i in range(9)]
    sections = spark.createDataFrame(rows, "bundle_id long, section_id long, title string, section_type string, equipment_type string")
    items = spark.createDataFrame([(b, i, "a pump" if i % 4 == 0 else "other", "a" if i % 2 and b < 2 else None, "e", i / 8, i == 5) for b in range(3) for i in range(8)], "bundle_id long, evidence_id long, summary string, section_type string, equipment_type string, relevance_score double, is_fallback boolean")
    found = {}
    for r in evidence.selected_evidence(sections, items, 2).collect():
        found.setdefault((r.bundle_id, r.section_id), {})[r.place] = (r.evidence_id, r.points)
    assert found[0, 0] == found[0, 3] == {1: (7, 0.625), 2: (3, 0.525)}  # by its type; 4 shares a word, with less
    assert found[0, 1] == {1: (4, 0.35), 2: (0, 0.25)}  # no type: words alone
    assert found[0, 2] == {1: (7, 0.325), 2: (6, 0.3)}  # nothing fits
    assert (2, 202) not in found  # no item has a type, so nothing is known
    joined = evidence.selected_evidence(sections, items, 2)
    assert "Aggregate [bundle_id" in plan(joined)


def test_cards_meet_combinations_of_values(spark):
    draw = random.Random(5)
    some = lambda values: draw.sample(values, draw.randint(0, 2)) + draw.choice([[], [None], [values[0]]])
    cards = [(i, some(["d1", "d2", "d3"]), some(["s1", "s2"]), some(["e1", "e2"]), draw.choice([["Ring", ""], ["gear", "ring"], [], ["x"]])) for i in range(40)]
    entries = [(i, draw.choice(["d1", "d2", "d3", "d4", None]), draw.choice(["s1", "s2", "s3"]), draw.choice(["e1", "e2", None]), draw.choice(["a ring", "GEAR and ring", "none"])) for i in range(120)]
    df = knowledge.card_evidence(spark.createDataFrame(cards, "card long, documents array<string>, sections array<string>, equipment array<string>, terms array<string>"), spark.createDataFrame(entries, "entry long, document string, section string, equipment_type string, text string"), 4)
    want = set()
    for card, d, s, e, t in cards:
        points = [(-(4 * (y is not None and y in d) + 3 * (z in s) + 2 * (w is not None and w in e) + any(x and x.lower() in v.lower() for x in t)), i) for i, y, z, w, v in entries]
        want |= {(card, i, -p, n) for n, (p, i) in enumerate(sorted(x for x in points if x[0])[:4], 1)}
    assert {tuple(r) for r in df.select("card", "entry", "points", "place").collect()} == want
    assert not re.search(r"Aggregate \[card#\d+L?, entry#", plan(df))  # cards do not meet the entries


def test_titles_are_taken_apart_before_they_meet(spark):
    rows = lambda titles: spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "outline_id long, section_id long, title string")
    found = knowledge.best_titles(rows(["1.2 Motor control", "Valve"]), rows(["motor Control", "cooling"]))
    assert {(r.title, r.section_id, r.score) for r in found.collect()} == {("1.2 Motor control", 0, 1.0), ("Valve", None, 0.0)}
    lines = plan(found).splitlines()
    assert min(i for i, x in enumerate(lines) if "Join" in x) < min(i for i, x in enumerate(lines) if "regexp" in x)
