"""Quality rules whose cutoffs adapt to each language and source.

Measures of whole texts come from one pass. Each measure's distribution per (language, source) is kept in a mergeable
quantile sketch: counts of logarithmic buckets (relative error ``ACCURACY``), which are summed across tasks before the
shuffle and added up again for each language and for everything. A cutoff lies beyond the sketch's upper tail by a multiple
of the tail's distance from the median. A group's quantiles are shrunk towards its language's and those towards the corpus's,
each by its number of documents: a group of ``SHRINK`` documents counts as much as what it is shrunk to, at every size alike.
Cutoffs are joined back; a document goes if it has more of something than its group's cutoff allows a text of its length,
plus the few (``MEASURES``) that a short text may have by chance.

Contract
--------
``apply_rules(docs)`` gives one row per input row. Words are runs of bytes other than ASCII white space. A null or empty
text has no words and fails the base rules. Null languages and sources form groups of their own. Only the four named
columns are read, so other columns may have any name; repeated rows each get a row, and count in the sketches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._batches import Numbers, bounded_batches, checkpointed, ends_of, lengths, mix64, texts_as_bytes

#: Relative error of the sketches' quantiles.
ACCURACY = 0.01
#: Documents of a group (or language) that weigh as much as the language (or corpus) that it is shrunk to.
SHRINK = 100.0
#: The upper tail, and so many times its distance from the median the cutoff lies beyond it; the same for lower tails.
TAIL, STRETCH = 0.90, 2.0
#: Measures: (what is counted, of what, how many are allowed beyond the cutoff's share). Three of each; three windows that come twice.
MEASURES = {
    "symbol_ratio": ("n_symbols", "word_chars", 3),
    "repeat_ratio": ("n_repeat_words", "n_words", 48),
    "stutter_ratio": ("n_stutters", "n_words", 3),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 3),
    "capital_ratio": ("n_capitals", "word_chars", 3),
    "shout_ratio": ("n_shouts", "word_chars", 3),
    "word_length": ("word_chars", "n_words", 3),
}
#: The measures of which too little is as odd as too much.
BOTH_SIDES = ("word_length",)
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
CAPITALS = bytes(range(0x41, 0x5B))
SHOUTS = b"!?"
_NOT_FIRST = WHITE + bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutters", "n_capitals", "n_shouts")


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, found = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            found += 1
        elif line.strip(WHITE):
            seen.add(line)
    return found


def repeat_words(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many words lie in windows of WINDOW words that it has twice or more, and how many equal the one before."""
    sizes = lengths(words)
    at = ends_of(sizes)
    numbers = Numbers()
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, at[-1])
    owner = np.repeat(np.arange(len(words)), sizes)
    stutters = np.bincount(owner[1:][(ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])], minlength=len(words))
    if at[-1] < WINDOW:
        return np.zeros(len(words), np.int64), stutters
    scrambled = mix64(ids + 1)
    n = at[-1] - WINDOW + 1
    keys = mix64(owner[:n] + (1 << 40))
    for j in range(WINDOW):
        keys += scrambled[j : n + j] * np.uint64(2 * j * j * 0x9E3779B97F4A7C15 + 0x51ED27 * j + 1 & 2**64 - 1 | 1)
    starts = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    keys = keys[starts]
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    marks = np.zeros(at[-1] + 1, np.int64)
    if len(twice):
        where = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = np.flatnonzero(twice[where] == keys)
        hit = hit[np.argsort(where[hit], kind="stable")]
        group = where[hit]
        firsts = np.flatnonzero(np.diff(group, prepend=-1))
        leader = starts[hit[firsts]][np.cumsum(np.diff(group, prepend=-1) > 0) - 1]
        same = np.all(ids[starts[hit][:, None] + np.arange(WINDOW)] == ids[leader[:, None] + np.arange(WINDOW)], 1)  # the words themselves decide
        found = starts[hit[same]]
        np.add.at(marks, found, 1)
        np.add.at(marks, found + WINDOW, -1)
    covered = ends_of(np.cumsum(marks[:-1]) > 0)
    return covered[at[1:]] - covered[at[:-1]], stutters


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    words = [t.split() for t in texts]
    repeats, stutters = repeat_words(words)
    count = lambda t, drop: len(t) - len(t.translate(None, drop))
    per_text = lambda f: np.fromiter(map(f, texts), np.int64, len(texts))
    return {
        "n_words": lengths(words),
        "word_chars": per_text(lambda t: len(t.translate(None, _NOT_FIRST))),
        "n_symbols": per_text(lambda t: count(t, SYMBOLS)),
        "n_dup_lines": per_text(dup_lines),
        "n_repeat_words": repeats,
        "n_stutters": stutters,
        "n_capitals": per_text(lambda t: count(t, CAPITALS)),
        "n_shouts": per_text(lambda t: count(t, SHOUTS)),
        "n_lines": per_text(lambda t: t.count(b"\n") + 1),
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, and the counts of each whole text."""
    bounded_batches(docs.sparkSession)
    names = [*COUNTS, "n_lines"]
    kinds = [docs.schema[c].dataType.simpleString() for c in ("doc_id", "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(texts_as_bytes(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(found[n]) for n in names)], names=["doc_id", "lang", "source", *names])

    schema = f"doc_id {kinds[0]}, lang {kinds[1]}, source {kinds[2]}, " + ", ".join(f"{n} long" for n in names)
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, schema)


def with_ratios(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.withColumns({m: share(a, b) for m, (a, b, _) in MEASURES.items()})


def sketched(ratios: DataFrame) -> DataFrame:
    """Sketches as rows (lang, source, measure, bucket, n): bucket 0 holds zeros, others values within ACCURACY of each other."""
    step = math.log((1 + ACCURACY) / (1 - ACCURACY))
    bucket = F.when(F.col("value") < 1e-6, F.lit(0)).otherwise((F.ceil(F.log(F.col("value") / F.lit(1e-6)) / F.lit(step)) + 1).cast("int"))
    long = ratios.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES))).alias("m"))
    return long.select("lang", "source", "m.measure", F.col("m.value").alias("value")).groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def bucket_value(bucket: Column) -> Column:
    """The value that stands for a bucket."""
    step = math.log((1 + ACCURACY) / (1 - ACCURACY))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.exp((bucket - 1) * F.lit(step)) * F.lit(1e-6 * (1 - ACCURACY)))


def quantiles(sketch: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """n and the lower tail, median and upper tail of each key's sketch, the names marked: buckets in which that share of the values is reached."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "measure")
    upto = merged.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("all", F.sum("n").over(by))
    reached = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("bucket")))
    found = upto.groupBy(*keys, "measure").agg(F.max("all").alias("n"), reached(1 - TAIL).alias("low"), reached(0.5).alias("mid"), reached(TAIL).alias("high"))
    return found.select(*(F.col(k).alias(f"{mark}_{k}") for k in [*keys, "measure", "n"]), *(bucket_value(F.col(c)).alias(f"{mark}_{c}") for c in ("low", "mid", "high")))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): the cutoffs of each measure, as shares."""
    group, by_lang, by_all = quantiles(sketch, ["lang", "source"], "g"), quantiles(sketch, ["lang"], "l"), quantiles(sketch, [], "a")
    joined = group.join(by_lang, F.col("g_lang").eqNullSafe(F.col("l_lang")) & (F.col("g_measure") == F.col("l_measure"))).join(by_all, F.col("g_measure") == F.col("a_measure"))

    def shrunk(c: str) -> Column:
        of_lang = (F.col("l_n") * F.col(f"l_{c}") + F.lit(SHRINK) * F.col(f"a_{c}")) / (F.col("l_n") + F.lit(SHRINK))
        return (F.col("g_n") * F.col(f"g_{c}") + F.lit(SHRINK) * of_lang) / (F.col("g_n") + F.lit(SHRINK))

    chosen = joined.select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), F.col("g_measure").alias("measure"), *(shrunk(c).alias(c) for c in ("low", "mid", "high")))
    out = []
    for m in MEASURES:
        out.append(F.max(F.when(F.col("measure") == m, F.col("high") + F.lit(STRETCH) * (F.col("high") - F.col("mid")))).alias(f"max_{m}"))
        if m in BOTH_SIDES:
            out.append(F.max(F.when(F.col("measure") == m, F.col("low") - F.lit(STRETCH) * (F.col("mid") - F.col("low")))).alias(f"min_{m}"))
    return chosen.groupBy("lang", "source").agg(*out)


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, ``base_failed``, the measures with their cutoffs, and ``kept``."""
    ratios = with_ratios(checkpointed(measured(docs)))  # read twice: for the sketches, and against the cutoffs
    found = cutoffs(sketched(ratios)).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = ratios.join(found, ratios["lang"].eqNullSafe(found["of_lang"]) & ratios["source"].eqNullSafe(found["of_source"]), "left").drop("of_lang", "of_source")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    within = F.lit(True)
    for m, (counted, of, more) in MEASURES.items():
        within = within & (F.col(counted) <= F.col(f"max_{m}") * F.col(of) + F.lit(float(more)))
        if m in BOTH_SIDES:
            within = within & (F.col(counted) >= F.col(f"min_{m}") * F.col(of) - F.lit(float(more)))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & within)


def _sql() -> str:
    step = repr(math.log((1 + ACCURACY) / (1 - ACCURACY)))
    measures = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS measure, {m} AS value, {a} AS counted, {b} AS of_what, {more!r}::DOUBLE AS more, {m in BOTH_SIDES} AS both_sides FROM ratios" for m, (a, b, more) in MEASURES.items())
    quantiles = lambda keys: f"SELECT {keys}measure, max(total) AS n, " + ", ".join(f"min(bucket) FILTER (WHERE upto >= ceil(total * {q!r}::DOUBLE)) AS {c}" for c, q in (("low", 1 - TAIL), ("mid", 0.5), ("high", TAIL))) + f" FROM (SELECT {keys}measure, bucket, sum(n) OVER (PARTITION BY {keys}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS total FROM (SELECT {keys}measure, bucket, count(*) AS n FROM bucketed GROUP BY ALL)) GROUP BY ALL"
    value = lambda b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE exp(({b} - 1) * {step}::DOUBLE) * {1e-6 * (1 - ACCURACY)!r}::DOUBLE END"
    shrunk = lambda c: f"(g.n::DOUBLE * {value(f'g.{c}')} + {SHRINK}::DOUBLE * ((l.n::DOUBLE * {value(f'l.{c}')} + {SHRINK}::DOUBLE * {value(f'a.{c}')}) / (l.n::DOUBLE + {SHRINK}::DOUBLE))) / (g.n::DOUBLE + {SHRINK}::DOUBLE) AS {c}"
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END"
    return rf"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(l) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM docs)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY 1),
counts AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutters,
  len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals, len(regexp_extract_all(t, '[!?]'))::BIGINT AS n_shouts, len(l)::BIGINT AS n_lines FROM docs d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
ratios AS (SELECT *, {", ".join(f"{share(a, b)} AS {m}" for m, (a, b, _) in MEASURES.items())} FROM counts),
measured AS ({measures}),
bucketed AS (SELECT *, CASE WHEN value < 1e-6 THEN 0 ELSE (ceil(ln(value / 1e-6) / {step}::DOUBLE) + 1)::INT END AS bucket FROM measured),
g AS ({quantiles("lang, source, ")}), l AS ({quantiles("lang, ")}), a AS ({quantiles("")}),
chosen AS (SELECT g.lang, g.source, g.measure, {shrunk("low")}, {shrunk("mid")}, {shrunk("high")} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.measure = l.measure JOIN a ON g.measure = a.measure),
verdicts AS (SELECT m.doc_id, bool_and(counted <= (high + {STRETCH}::DOUBLE * (high - mid)) * of_what + more AND (NOT both_sides OR counted >= (low - {STRETCH}::DOUBLE * (mid - low)) * of_what - more)) AS within
  FROM measured m JOIN chosen s ON m.lang IS NOT DISTINCT FROM s.lang AND m.source IS NOT DISTINCT FROM s.source AND m.measure = s.measure GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND within AS kept FROM ratios JOIN verdicts USING (doc_id)
"""


#: The contract's columns in DuckDB's SQL.
RULES_SQL = _sql()
