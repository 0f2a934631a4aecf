"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three code points of the lower-cased letters (anything else is one space between words) are hashed
into ``FEATURES`` slots. Document frequencies come from every document that may be learned from, summed in each task before
the shuffle. The weights are fitted on a bounded sample (``SAMPLE_PER_LANGUAGE`` documents a language on average, chosen by
a hash of id and text, so repeated rows count once, and twice that number at most) by follow-the-regularised-leader with elastic-net penalties; a fifth of it is kept back to fit the
temperature that calibrates the scores. Prediction adds up the weights of all n-grams of a whole text.

Contract
--------
``predict`` gives one row per input row. A text that is null, empty or without a letter is ``und`` with score 0. Documents
without a language teach nothing. With no labelled document at all everything is ``und``. Language, source and id are never
inputs of a prediction, and columns other than the named ones are only carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import bounded_batches, ends_of, lengths, texts_as_bytes, unused
from .bpe import LETTER, code_point_classes

FEATURES = 1 << 15
ORDERS = 3
#: Mean number of sampled documents of each language; the classifier's weights are fitted on these.
SAMPLE_PER_LANGUAGE = 800
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.01
#: Relative term frequencies are small numbers; the weights are fitted on this multiple of them.
SCALE = 50.0


def grams(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(hashed n-grams of each order, the text each belongs to, whether each text has a letter)."""
    lowered = [t.decode("utf-8", "replace").lower() for t in texts]
    points = np.frombuffer("".join("\0" + t for t in lowered).encode("utf-32-le"), np.uint32)
    fences = ends_of(lengths(lowered) + 1)
    letter = code_point_classes()[points] == LETTER
    letter[fences[:-1]] = False
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # a letter, or the first of what lies between words
    kept[fences[:-1]] = True
    owner = np.repeat(np.arange(len(texts)), np.diff(fences))[kept]
    codes = np.where(letter, points, 32)[kept].astype(np.uint64) + np.uint64(1)
    letter = letter[kept]
    hashed, owners = [], []
    n, key = len(codes), np.zeros(len(codes), np.uint64)
    for order in range(1, ORDERS + 1):
        m = n - order + 1
        if m <= 0:
            break
        key = (key[:m] * np.uint64(0x100000001B3) + codes[order - 1 :]) & np.uint64(2**64 - 1)
        inside = owner[:m] == owner[order - 1 :]
        inside &= letter[:m] if order == 1 else letter[:m] | letter[1 : m + 1]
        slots = ((key[inside] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
        hashed.append(slots.astype(np.int32))
        owners.append(owner[:m][inside])
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    return hashed, owners, has


def counts_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of each n-gram that a text has, and the number of n-grams of each text."""
    hashed, owners, _ = grams(texts)
    slots, owner = np.concatenate([*hashed, np.zeros(0, np.int32)]), np.concatenate([*owners, np.zeros(0, np.int64)])
    keys, n = np.unique(owner.astype(np.int64) * FEATURES + slots, return_counts=True)
    return keys // FEATURES, keys % FEATURES, n, np.bincount(owner.astype(np.int64), minlength=len(texts))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many texts have each feature, and, last, how many texts there are."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            texts = texts_as_bytes(batch)
            for i in range(0, len(texts), 64):
                some = texts[i : i + 64]
                hashed, owners, has = grams(some)
                seen = np.zeros((len(some), FEATURES), bool)
                for s, o in zip(hashed, owners):
                    seen[o, s] = True
                total[:-1] += seen.sum(0)
                total[-1] += has.sum()
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["feature", "n"])

    rows = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # FEATURES + 1 rows at most
    out = np.zeros(FEATURES + 1, np.int64)
    out[rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return out


def sample_counts(docs: DataFrame) -> list[dict]:
    """The sampled documents as rows (lang, features, counts, total)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_as_bytes(batch)
            owner, feature, n, total = counts_of(texts)
            at = np.searchsorted(owner, np.arange(len(texts) + 1))
            pack = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pack(feature, "<u2"), pack(n, "<u4"), pa.array(total, pa.int64())], names=["key", "lang", "features", "counts", "total"])

    out = docs.select("key", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "key long, lang string, features binary, counts binary, total long")
    return sorted(out.toArrow().to_pylist(), key=lambda r: (r["key"], r["lang"], r["features"]))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (languages, FEATURES), with IDF, scale and temperature in them
    bias: np.ndarray

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of the languages for each text, whether it has a letter)."""
        hashed, owners, has = grams(texts)
        logits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for slots, owner in zip(hashed, owners):
            if not len(slots):
                continue
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            at = owner[first]
            total[at] += np.diff(np.append(first, len(owner)))
            for k, w in enumerate(self.weights):
                logits[at, k] += np.add.reduceat(w[slots], first)
        logits = logits / np.maximum(total, 1)[:, None] + self.bias
        return softmax(logits), has


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int) -> np.ndarray:
    """FTRL-proximal over (features, values, class) rows; the last row of the weights is the bias."""
    z, n = np.zeros((FEATURES + 1, n_classes)), np.zeros((FEATURES + 1, n_classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            features, values, label = rows[i]
            zi, ni = z[features], n[features]
            w = weights(zi, ni)
            error = softmax(values @ w)
            error[label] -= 1.0
            g = values[:, None] * error
            grown = ni + g * g
            z[features] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[features] = grown
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that the weights have not seen."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()
    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def fit(docs: DataFrame, learnable: Column) -> Model | None:
    """A model from the rows of docs (doc_id, text, lang) for which ``learnable`` holds."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(learnable & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.filter(F.length("text") > 0).groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    languages = sorted(sizes)
    frequency = document_frequencies(rows)
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, SAMPLE_PER_LANGUAGE / sizes[lang]))))
    key = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("sample"))
    chosen = rows.filter(F.length("text") > 0).withColumn("key", key).filter(F.pmod(key, F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    sample = sample_counts(chosen.select("key", "lang", "text").dropDuplicates(["key", "lang"]).orderBy("key", "lang").limit(2 * SAMPLE_PER_LANGUAGE * len(languages)))
    number = {lang: i for i, lang in enumerate(languages)}
    learn, hold = [], []
    for i, r in enumerate(sample):
        if r["total"]:
            features = np.frombuffer(r["features"], "<u2").astype(np.int64)
            values = np.frombuffer(r["counts"], "<u4") / r["total"] * idf[features] * SCALE
            (hold if i % 5 == 0 else learn).append((np.append(features, FEATURES), np.append(values, 1.0), number[r["lang"]]))
    if not learn:
        learn = hold
    w = fit_weights(learn, len(languages))
    held = np.array([v @ w[f] for f, v, _ in hold]).reshape(len(hold), len(languages))
    t = temperature(held, np.array([label for _, _, label in hold], np.int64))
    return Model(languages, np.ascontiguousarray((w[:-1] * idf[:, None] * SCALE / t).T.astype(np.float32)), w[-1] / t)


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns in ``keep``, and the language and its score under ``names``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    if model is None:
        return docs.select(*keep, F.lit("und").alias(names[0]), F.lit(0.0).alias(names[1]))
    sent = spark.sparkContext.broadcast(model)  # FEATURES x languages numbers
    schema = docs.select(*keep).withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema
    text = keep.index("text") if "text" in keep else len(keep)
    (own_text,) = unused([*keep, *names], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance, has = sent.value.scores(texts_as_bytes(batch, text))
            best = chance.argmax(1)
            found = np.array(sent.value.languages, object)[best]
            found[~has] = "und"
            score = np.where(has, chance[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found.tolist(), pa.string()), pa.array(score)], names=[*keep, *names])

    return docs.select(*keep, *([] if "text" in keep else [F.col("text").alias(own_text)])).mapInArrow(run, schema)


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows whose remainder modulo 3 is not 1."""
    found = predict(docs, fit(docs, remainder(3) != 1))
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
