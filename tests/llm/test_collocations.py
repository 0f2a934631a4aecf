import re
from collections import Counter

import duckdb
import pytest

from corpusweft.llm import collocations as cl


def brute(rows, least, most):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3, 4):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        hold = Counter()
        for g, a in own.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    if a >= least:
                        hold[g[i : i + k]] = max(hold[g[i : i + k]], a)
        rows = []
        for g, a in own.items():
            if len(g) > 1 and a >= least and 100 * hold[g] < 80 * a:
                score, _, l, r = min((2_000_000 * a // (own[g[:k]] + own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def found(spark, rows, least=30, most=2000, bits=16):
    df = spark.createDataFrame([(t, g, 1) for t, g in rows], "text string, lang string, rank int").repartition(3)
    return sorted(tuple(r) for r in cl.phrases(df, least, most, bits).collect())


TEXTS = (
    [("New York, new york city is a city; in New York State!", "en")] * 40
    + [("el sol\tde laé mañana. El SOL de laÉ mañana", "es")] * 35
    + [("a a a a a a", "en"), ("a b a b a b a b", "en")] * 20
    + [(None, "en"), ("", None), ("lone words here", None), (" .,;:!?\n\x0b\x0c\r\t ", "xx"), ("new york new york", "en")]
    + [("und und und", None)] * 31
    + [("w" + str(k % 7) + " x" + str(k % 3) + " y" + str(k % 2), "de") for k in range(400)]
)


@pytest.mark.parametrize("bits", [3, 10, 20])  # a full sketch, a crowded one and a roomy one
def test_rows_match_brute_force(spark, bits):
    assert found(spark, TEXTS, bits=bits) == brute(TEXTS, 30, 2000)


@pytest.mark.parametrize("least, most", [(1, 50), (2, 5), (35, 1)])
def test_other_limits(spark, least, most):
    assert found(spark, TEXTS, least, most) == brute(TEXTS, least, most)


def test_sketch_never_says_too_little(spark):
    import numpy as np

    df = spark.createDataFrame(TEXTS, "text string, lang string").fillna("und", ["lang"]).repartition(4)
    flags = np.frombuffer(cl.reached(df, 30, 8), np.uint8)
    for lang in ("en", "es", "de", "und"):
        grams = cl.Grams(lang, [(t or "").encode() for t, g in TEXTS if (g or "und") == lang])
        for _, _, hashes in grams:
            own, number = np.unique(hashes, return_counts=True)
            for row in range(cl.ROWS):
                cell = cl.cells(own[number >= 30], row, 8) + (row << 8)
                assert ((flags[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).all()


def test_equal_hashes_are_told_apart():
    import numpy as np

    grams = cl.Grams("en", [b"a b a b c d c d a b"])
    at = np.flatnonzero(grams.ids)[:-1]
    at = at[grams.ids[at + 1] > 0]
    lead, number = cl.tallies(grams, at, np.zeros(len(at), np.uint64), 2)
    assert {(grams.words[grams.ids[i]], grams.words[grams.ids[i + 1]]): int(k) for i, k in zip(lead, number)} == {(b"a", b"b"): 3, (b"b", b"a"): 1, (b"b", b"c"): 1, (b"c", b"d"): 2, (b"d", b"c"): 1, (b"d", b"a"): 1}


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", TEXTS)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({cl.PHRASES_SQL})").fetchall()) == found(spark, TEXTS)


def test_empty_table_long_text_and_scores_beyond_64_bits(spark):
    assert found(spark, []) == []
    long = [("again and " * 60_000, "en")]
    assert found(spark, long) == brute(long, 30, 2000)
    known = spark.createDataFrame([("en", ["a", "b"], 1 << 60), ("en", ["a"], (1 << 61) + 1), ("en", ["b"], 1 << 61)], "lang string, words array<string>, f long")
    assert cl.scored(known).first().score == 2_000_000 * (1 << 60) // ((1 << 62) + 1)
