"""A corpus in, token ids of its clean documents out: stages that each apply one operator to all that is left.

Contract
--------
Each stage works on any columns beside ``doc_id`` and ``text`` (and ``lang``, ``n_chars``), whatever their names, and all
but the last return the columns that it was given. An empty table gives an empty table. Texts may be of any length.

* ``language_id``: null and empty texts, and those without a letter, are rejected. Repeated rows and null ids are like others.
* ``near_dedup``: null and empty texts are linked with nothing and stay, as do rows with a null id. Of rows with one id, the
  one with the smallest text stays (of equal texts, the one with the smallest hash of all columns); of a group, the smallest id.
* ``suffix_dedup``: null, empty and short texts stay as they are; a repeated row repeats all its text, so both go. Where a cut
  splits a character, the rest of it goes too.
* ``decontaminate``: null and empty texts stay.
* ``bpe``: null and empty texts have no tokens; a row for each row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweft.llm import bpe, decontaminate, language_id, near_dedup, suffix_dedup
from corpusweft.llm._batches import shared_folder, unused
from corpusweft.llm.queries import vocabulary_path

#: Documents whose most likely language scores less are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; learned from those whose remainder modulo 3 is not 1."""
    model = language_id.fit(docs, language_id.remainder(3) != 1)
    lang, score = unused(docs.columns, "lang_pred", "lang_score")
    found = language_id.predict(docs, model, tuple(docs.columns), names=(lang, score))
    return found.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id; one row for each id."""
    kept = near_dedup.near_duplicates(docs).filter("kept").select("doc_id")
    (place,) = unused(docs.columns, "place")
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*hashed))
    chosen = docs.join(kept, "doc_id", "left_semi").select(*docs.columns).withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1)
    return chosen.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings of 400 bytes; documents of which nothing is left go."""
    others = tuple(c for c in docs.columns if c != "text")
    kept, size, removed, spans, missing = unused(docs.columns, "kept", "bytes", "removed", "spans", "missing")
    cut = suffix_dedup.remove_repeats(docs.withColumn(missing, F.col("text").isNull()), (*others, missing), names=(kept, size, removed, spans), whole_characters=True)
    changed = F.col(removed) > 0
    out = cut.filter(~changed | (F.length(kept) > 0)).withColumn("text", F.when(~F.col(missing), F.col(kept).cast("string")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words, spans, found = unused(docs.columns, "words", "spans", "items")
    marked = decontaminate.mark(docs, items, tuple(docs.columns), names=(words, spans, found))
    return marked.filter(F.size(spans) == 0).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, packed token ids, and digests of ids and of the bytes decoded from them."""
    path = vocabulary_path()
    decoded = bpe.decode(bpe.encode(docs, path), path, keep=("token_ids",))
    return decoded.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", decontaminate_benchmark),
    ("bpe", tokenize),
]

#: SQL can express neither the language model nor the tokeniser; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again as the next one's input.

    The stages' tables stay under ``pipeline-*`` in that folder, for reading and for restarts; whoever owns the folder clears it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
