import hashlib
import random
import re

from corpusweft.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall((body or "").translate(LOWER))
        size = min(10, len(own))
        wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wanted:
                hit.update(range(i, i + size))
                if item is not None:
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def case():
    rng = random.Random(4)
    bits = ["a", "B", "é", "Éa", "x1", "the", "long-word", "中", "zz,", "\n"]
    text = lambda low, high: " ".join(rng.choices(bits, k=rng.randint(low, high)))
    items = [(i, text(1, 25)) for i in range(60)] + [(100, None), (101, "..."), (102, "b"), (7, text(12, 12)), (103, "one two three four five six seven eight nine ten eleven")]
    docs = [text(0, 50) + " " + (rng.choice(items)[1] or "").upper() if rng.random() < 0.5 else text(0, 80) for _ in range(120)]
    return items, [*docs, None, "", " . ", "word " * 40_000 + "one two three four five six seven eight nine ten", "Ten one, two three four five six seven eight nine ten eleven one"]


def test_marks_match_brute_force(spark):
    items = case()[0]
    rng = random.Random(6)
    docs = []
    for i in range(150):
        body = " ".join(rng.choices(["a", "B", "é", "x1", "the", "zz,", "\n"], k=rng.randint(0, 60)))
        pick = rng.choice(items)[1] or ""
        docs.append((i, body + " " + pick.upper() + " " + body if i % 2 else body, "x"))
    docs += [(900 + i, t, "y") for i, t in enumerate([None, "", " . ", "word " * 40_000 + "one two three four five six seven eight nine ten", "Ten one, two three four five six seven eight nine ten eleven one"])]
    frame = spark.createDataFrame([*docs, docs[1]], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame([*items, (None, "a a")], "item_id long, text string")
    items = [*items, (None, "a a")]
    got = [tuple(r) for r in dc.contamination(frame, bench).collect()]
    assert sorted(got) == sorted((i, *brute(t, items)) for i, t, _ in [*docs, docs[1]])
    assert dc.contamination(frame.limit(0), bench).count() == 0
    assert {r.n_hit for r in dc.contamination(frame, bench.limit(0)).collect()} == {0}


def test_blocks_of_items_give_the_same_rows(spark, monkeypatch):
    items, docs = case()
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dc.contamination(frame, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 1500)
    assert len(list(dc.item_blocks(bench))) > 2
    assert sorted(map(tuple, dc.contamination(frame, bench).collect())) == whole
