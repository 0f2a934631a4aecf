"""A quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics of each text become quantile bins; boosting sums gradients by (node, feature, bin) and splits each level of a
tree at once. The finished trees are flattened into arrays (feature, threshold, first child, value), which score a batch by
stepping all (document, tree) pairs down one level at a time.

Contract
--------
The trees are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` on average, chosen by a hash of the id). Labels,
language, source and id are never inputs. ``score`` gives one row per input row, between 0 and 1; null and empty texts have
all statistics 0 and a score as any other. Without labels every score is 0.5. Labels that are null teach nothing; of repeated
labels each counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_rules
from ._batches import bounded_batches, lengths, texts_as_bytes, unused
from .language_id import remainder

#: Mean number of labelled rows that the trees are fitted on; at 12 bytes a row their ids are small enough to broadcast.
SAMPLE_ROWS = 20_000
BINS, TREES, DEPTH, RATE, PENALTY, LEAST_WEIGHT = 64, 80, 4, 0.15, 1.0, 4.0
#: A text counts as good from this score on.
CUTOFF = 0.3
PUNCTUATION, DIGITS = b".,;:'\"()-", b"0123456789"
HIGH = bytes(range(0x80, 0x100))
STATISTICS = (
    "log_bytes", "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "shout_share",
    "words_per_line", "digit_share", "punctuation_share", "high_share", "distinct_share", "longest_word", "bar_share", "at_share",
)


def statistics(texts: list[bytes]) -> np.ndarray:
    """(texts, STATISTICS) as 32-bit floats."""
    found = quality_rules.measure(texts)
    per_text = lambda f: np.fromiter(map(f, texts), np.float64, len(texts))
    share_of = lambda chars: per_text(lambda t: len(t) - len(t.translate(None, chars)))
    size = lengths(texts).astype(np.float64)
    words, chars = np.maximum(found["n_words"], 1), np.maximum(found["word_chars"], 1)
    at_least_1 = np.maximum(size, 1)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(found["n_words"]), found["word_chars"] / words, found["n_symbols"] / chars, found["n_dup_lines"] / found["n_lines"], found["n_repeat_words"] / words,
            found["n_capitals"] / chars, found["n_shouts"] / chars, found["n_words"] / found["n_lines"], share_of(DIGITS) / at_least_1, share_of(PUNCTUATION) / at_least_1, share_of(HIGH) / at_least_1,
            per_text(lambda t: len(set(t.split()))) / words, per_text(lambda t: max(map(len, t.split()), default=0)), share_of(b"|") / words, share_of(b"@") / words,
        ]
    ).astype(np.float32)


@dataclass
class Forest:
    """All trees in one set of arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray  # of values up to the threshold; the other child follows it
    value: np.ndarray
    roots: np.ndarray
    start: float

    def chance(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            right = x[rows, self.feature[at]] > self.threshold[at]
            at = np.where(self.child[at] < 0, at, self.child[at] + right)
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(1))))


def fit_forest(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the log loss, by histograms."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    flat_bins = binned + np.arange(width) * BINS
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(prior / (1 - prior)))
    margin = np.full(n, start)
    feature, threshold, child, value, roots = [], [], [], [], []
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        g, h = chance - y, chance * (1 - chance)
        base = len(feature)
        roots.append(base)
        node = np.zeros(n, np.int64)  # of each row, counted from base
        level, made = [0], 1
        for c, v in ((feature, 0), (threshold, np.float32(np.inf)), (child, -1), (value, 0.0)):
            c.append(v)
        for depth in range(DEPTH + 1):
            place = np.full(made, -1)
            place[level] = np.arange(len(level))
            slot = place[node]
            live = slot >= 0
            sums = []
            for w in (g, h):
                key = (slot[live, None] * (width * BINS) + flat_bins[live]).ravel()
                sums.append(np.bincount(key, np.repeat(w[live], width), len(level) * width * BINS).reshape(len(level), width, BINS))
            total_g, total_h = (s[:, 0].sum(1) for s in sums)
            for k, at in enumerate(level):
                value[base + at] = -RATE * total_g[k] / (total_h[k] + PENALTY)
            if depth == DEPTH:
                break
            left_g, left_h = (s.cumsum(2) for s in sums)
            right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h
            gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - (total_g**2 / (total_h + PENALTY))[:, None, None]
            gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = 0
            best = gain.reshape(len(level), -1).argmax(1)
            following = []
            for k, at in enumerate(level):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] <= 1e-6:
                    continue
                feature[base + at], threshold[base + at], child[base + at] = f, edges[f][b], base + made
                mine = node == at
                node[mine] = made + (binned[mine, f] > b)
                following += [made, made + 1]
                made += 2
                for c, v in ((feature, 0), (threshold, np.float32(np.inf)), (child, -1), (value, 0.0)):
                    c += [v, v]
            if not following:
                break
            level = following
        margin += np.array(value[base:])[node]
    return Forest(np.array(feature), np.array(threshold, np.float32), np.array(child), np.array(value), np.array(roots), start)


def _statistics_of(docs: DataFrame) -> pa.Table:
    """Label and packed statistics of each sampled row (a bounded number of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(texts_as_bytes(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "label", "x"])

    return docs.select("key", "label", "text").mapInArrow(run, "key long, label double, x binary").toArrow()


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "quality") -> Forest | None:
    bounded_batches(docs.sparkSession)
    key = F.xxhash64(F.col("doc_id").cast("string"), "label", F.lit("sample"))
    usable = labels.select("doc_id", F.col(label).cast("double").alias("label")).filter(learnable & F.col("label").isNotNull() & F.col("doc_id").isNotNull()).withColumn("key", key)
    n = usable.count()
    if not n:
        return None
    share = int(min(1.0, SAMPLE_ROWS / n) * 1_000_000)
    sample = usable.filter(F.pmod("key", F.lit(1_000_000)) < share).dropDuplicates(["key"]).orderBy("key").limit(2 * SAMPLE_ROWS)
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("of_text", F.xxhash64("text"))
    rows = _statistics_of(met.dropDuplicates(["key", "of_text"]).orderBy("key", "of_text").limit(2 * SAMPLE_ROWS))
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(rows.num_rows, len(STATISTICS))
    y = (rows["label"].to_numpy() > 0).astype(np.float64)
    order = np.lexsort((y, *x.T, rows["key"].to_numpy()))  # the same trees whatever order the rows come in
    return fit_forest(x[order], y[order])


def score(docs: DataFrame, forest: Forest | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and ``quality_score``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(forest)
    schema = docs.select(*keep).withColumn("quality_score", F.lit(0.0)).schema
    (own_text,) = unused([*keep, "quality_score"], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent.value is None:
                chance = np.full(batch.num_rows, 0.5)
            else:
                chance = sent.value.chance(statistics(texts_as_bytes(batch, len(keep))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(chance)], names=[*keep, "quality_score"])

    return docs.select(*keep, F.col("text").alias(own_text)).mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labelled rows whose remainder modulo 5 is not 0."""
    found = score(docs, fit(docs, labels, remainder(5) != 0))
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= CUTOFF).cast("int").alias("predicted"))
