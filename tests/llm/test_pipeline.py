import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from test_near_dedup import brute as near_brute
from test_suffix_dedup import cuts

WORDS = {"en": "the of and to in that is was for it with as his on be at by".split(), "fr": "le la les des une est dans pour que qui sur avec être pas nous".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that stages use inside, as columns of the input.
CLASHING = ["token_ids", "_key", "_kept", "_bytes", "_text", "_of", "_ranges", "_lang_score", "_lang_pred", "lang_pred", "_words", "_spans", "_items", "words", "spans", "items", "place", "kept", "bytes", "removed", "missing", "key", "of", "ranges", "id", "component_id", "learn"]


def texts():
    rng = random.Random(21)
    rows = []
    for i in range(160):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(w + rng.choice("aeiou") + str(rng.randint(0, 99)) if rng.random() < 0.5 else w for w in rng.choices(WORDS[lang], k=rng.randint(30, 150))), lang))
    long = " ".join(rng.choices(WORDS["en"], k=200))
    item = "zulu yankee xray whiskey victor uniform tango sierra romeo quebec papa"
    rows += [(200, rows[3][1], "en"), (201, rows[3][1] + " more", "en"), (202, None, "en"), (203, "12 34 ... !", "fr"), (204, "", "fr"), (205, rows[7][1] + " " + long, rows[7][2]), (206, rows[9][1] + " � " + long + " é", rows[9][2])]
    rows += [(207, rows[11][1] + " " + item.upper(), rows[11][2] + ""), (208, "le la les " + item, "fr"), (None, rows[12][1] + " without an id", rows[12][2])]
    return rows, item


def judge():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, item = texts()
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)
    docs.select("*", *(F.lit("x").alias(c) for c in CLASHING)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t or "")]
    keep = {i for i, _, component in near_brute([r for r in left if r[0] is not None]) if i == component}
    left = [(i, t) for i, t in left if i is None or i in keep]
    cut = []
    for (i, t), (data, gone) in zip(left, cuts([t for _, t in left])):
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=1))
        pieces = [data[a:b] for a, b in zip(edges[::2], [*edges[1::2], len(data)][: len(edges[::2])])]
        kept = "".join(p.decode(errors="ignore") for p in pieces)  # of a character that a cut splits nothing stays
        if kept or not gone.any():
            cut.append((i, t, int(gone.sum()), kept))
    with_cuts = {i for i, _, removed, _ in cut if removed}
    assert 206 in with_cuts
    clean = {i for i, t, _, _ in cut if "zulu yankee xray" not in t.lower()}
    assert set(got) == clean and 207 not in got and 202 not in got and 200 not in got and 201 not in got

    tokens = judge()
    for i, _, _, kept in cut:
        if i in got:
            ids = tokens.encode_ordinary(kept)
            assert got[i].n_tokens == len(ids) and np.frombuffer(got[i].token_ids, np.uint32).tolist() == ids
            assert got[i].decoded_sha256 == hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table_and_clashing_names(spark, tmp_path, name):
    rows = [(i, " ".join(WORDS["en"][i % 7 :] * 3), "en", "s", 1) for i in range(30)] + [(40, None, None, None, None), (41, "", "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in ("id",)))
    spark.createDataFrame([(1, "zulu yankee")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    ids = [r.doc_id for r in out.collect()]
    if name == "bpe":
        assert len(ids) == len(rows)
    else:
        assert out.columns == docs.columns
        assert (40 in ids) == (None in ids) == (41 in ids) == (name != "language_id")


def test_rows_of_one_id_leave_one_that_is_defined(spark):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(1, words(2), "en", "b", 1), (1, words(1), "en", "a", 2), (1, None, "en", "c", 3), (2, words(3), "en", "a", 4), (2, words(3), "en", "b", 5)]
    left = [corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(r, SCHEMA), "").collect() for r in (rows, rows[::-1])]
    assert sorted(left[0]) == sorted(left[1]) and len(left[0]) == 2
    assert {r.doc_id: r.text for r in left[0]}[1] == words(1)
