import random
import re

from corpusweft.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def sample_texts():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "bé", "中文", "###", "\n", "x\n", "\x0b", "\x85", " "], k=rng.randint(0, 60))) for _ in range(300)]
    return [*texts, None, "", " \n ", "one two three four five six seven eight " * 2, "a " * 40, "line\nline\n\n\n line"]


def test_counts_match_brute_force(spark):
    texts = sample_texts() + ["word " * 50_000]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int, kept int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.apply_rules(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts[:-1]):
        assert got[i] == brute(text), repr(text)
    assert got[len(texts) - 1] == (50_000, 200_000, 0, 0, 50_000)


SCHEMA = "doc_id long, text string, lang string, source string"
PLAIN = "these are plain words that say one thing after another and never twice the same way so nothing here is odd at all {}"


def cutoffs(spark, rows):
    counts = rules.measured(spark.createDataFrame(rows, SCHEMA))
    found = rules.cutoffs(rules.sketched(rules.with_ratios(counts))).collect()
    return {(r.lang, r.source): r.asDict() for r in found}


def test_cutoffs_follow_their_group(spark):
    rows = [(i, PLAIN.format(i), "en", "a") for i in range(600)] + [(1000, PLAIN.format("#" * 12), "en", "a")]
    rows += [(2000 + i, PLAIN.format("#" * (i % 13)), "en", "code") for i in range(300)]
    rows += [(3000, PLAIN.format(3), None, None), (3001, None, "en", "a"), (3002, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id: r.kept for r in rules.apply_rules(docs).collect()}
    assert all(kept[i] for i in range(600)) and all(kept[2000 + i] for i in range(300))  # symbols are usual in their own source
    assert not kept[1000] and not kept[3001] and not kept[3002] and kept[3000]
    assert rules.apply_rules(docs.limit(0)).count() == 0


def test_a_shift_of_one_group_moves_its_own_cutoff_most(spark):
    rng = random.Random(5)
    rows = [(i, PLAIN.format("#" * rng.randint(0, 4)), lang, source) for lang in ("en", "fr") for source in ("a", "b") for i in range(400)]
    before = cutoffs(spark, rows)
    after = cutoffs(spark, [(i, t + "#" * 6 if (lang, source) == ("en", "a") else t, lang, source) for i, t, lang, source in rows])
    moved = {k: after[k]["max_symbol_ratio"] - before[k]["max_symbol_ratio"] for k in before}
    assert moved["en", "a"] > 0.03
    assert moved["en", "a"] > 3 * abs(moved["en", "b"]) and moved["en", "a"] > 6 * abs(moved["fr", "a"]) and moved["fr", "a"] == moved["fr", "b"]


def test_no_size_of_a_group_changes_how_it_is_judged(spark):
    """One document more moves a cutoff a little: there is no number at which another sketch takes over."""
    rng = random.Random(6)
    other = [(i, PLAIN.format(i), "en", "b") for i in range(500)]
    own = [(1000 + i, PLAIN.format("#" * rng.randint(0, 9)), "en", "a") for i in range(130)]
    seen = [cutoffs(spark, other + own[:n])["en", "a"]["max_symbol_ratio"] for n in (98, 99, 100, 101)]
    assert max(abs(x - y) for x, y in zip(seen, seen[1:])) < 0.05 * seen[0]


def test_each_measure_alone_rejects_a_document(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randint(3, 7)))
    text = lambda n=120: "\n".join(" ".join(word() for _ in range(10)) for _ in range(n // 10))
    rows = [(i, text(), "en", "a") for i in range(300)]
    line = " ".join(word() for _ in range(5))
    passage = " ".join(word() for _ in range(15))
    odd = {
        "symbols": text() + " " + "# " * 30,
        "repeats": text(480) + f" {passage}" * 2 + text(10) + f" {passage}" * 3,
        "stutters": text() + " so so so so so so so so no no no no no no me me me me me me",
        "lines": text() + "\n" + "\n".join(line + "\n" + word() for _ in range(6)),
        "capitals": text() + " ABCDEFGH IJKLMNOP QRSTUVWX ABCDEFGH IJKLMNOP",
        "shouts": text() + " a! b! c! d! e! f! g! h! i! j!",
        "long words": " ".join(word() + "zzzzzzzzzzzz" + word() for _ in range(60)),
        "short words": " ".join(rng.choices("abcdefghijklm", k=80)),
    }
    found = {r.doc_id: r for r in rules.apply_rules(spark.createDataFrame(rows + [(1000 + i, t, "en", "a") for i, t in enumerate(odd.values())], SCHEMA)).collect()}
    for i, name in enumerate(odd):
        assert not found[1000 + i].base_failed and not found[1000 + i].kept, (name, found[1000 + i])
    assert sum(not found[i].kept for i in range(300)) <= 3
