import random
import re

import numpy as np
import pytest

from corpusweft.llm import near_dedup as nd
from corpusweft.llm import _components
from corpusweft.llm._components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = {}
    for i, text in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.setdefault(i, []).append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    flat = [(i, s) for i, own in sets.items() for s in own]
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for x, (i, a) in enumerate(flat):
        for j, b in flat[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                top[max(find(i), find(j))] = min(find(i), find(j))
    return {(i, len(s), find(i)) for i, s in flat}


def corpus():
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 999))
    rows, n = [], 0
    for _ in range(12):  # families at all distances around the threshold
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(len(own))] = word()
            rows.append((n, " ".join(own)))
            n += 1
    hot = [word() for _ in range(120)]
    for k in range(150):  # a large group of near copies, partly beyond the threshold from each other
        own = list(hot)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = word()
        rows.append((n, " ".join(own)))
        n += 1
    rows += [(n + k, rows[5][1].upper()) for k in range(20)]
    n += 20
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "two one"), (n + 6, "w " * 60_000), rows[0]]


def test_components_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    got = nd.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_small_blocks_and_bad_pivots_lose_no_link(spark, monkeypatch):
    """With all in one bucket and blocks of few members, the blocks have to find the rest."""
    monkeypatch.setattr(nd, "BLOCK_BYTES", 8000)
    monkeypatch.setattr(nd, "bands", lambda found: np.zeros((len(found), nd.REGISTERS // nd.ROWS), np.int64))
    rows = corpus()[:90]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in nd.near_duplicates(docs).collect()} == brute(rows)


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)", "int"])
@pytest.mark.parametrize("local", [0, 1_000_000])
def test_ids_of_any_type(spark, monkeypatch, kind, local):
    monkeypatch.setattr(_components, "LOCAL_EDGES", local)
    monkeypatch.setattr(nd, "BLOCK_BYTES", 8000)
    monkeypatch.setattr(nd, "bands", lambda found: np.zeros((len(found), nd.REGISTERS // nd.ROWS), np.int64))
    rows = [(100 + i, t) for i, t in corpus()[:40]]  # ids of equal length, so that they sort alike as strings
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    found = nd.near_duplicates(docs)
    assert found.schema["component_id"].dataType.simpleString() == kind
    assert {(int(r.doc_id), r.n_shingles, int(r.component_id)) for r in found.collect()} == brute(rows)


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in nd.near_duplicates(docs).collect()) == [(0, 0, True), (0, 0, True), (1, 1, True)]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 2**64, 900, dtype=np.uint64) for _ in range(2))
    both = nd.registers([a, b, np.concatenate([a, b])])
    assert (np.maximum(both[0], both[1]) == both[2]).all()
    shared = rng.integers(0, 2**64, 800, dtype=np.uint64)
    near = nd.registers([np.concatenate([shared, a[:100]]), np.concatenate([shared, b[:100]]), b])
    n = np.array([900.0])
    assert nd.may_be_similar(near[:1], near[1:2], n, n)[0] and not nd.may_be_similar(near[:1], near[2:], n, n)[0]


@pytest.mark.parametrize("local", [0, 1000])
def test_components_of_a_long_chain(spark, monkeypatch, local):
    monkeypatch.setattr(_components, "LOCAL_EDGES", local)
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 99), (99, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99, 101: 99}
