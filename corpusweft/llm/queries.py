"""The queries opN_<name>: each applies its operator, with production parameters, to its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, collocations, decontaminate, language_id, lm_score, near_dedup, packing, passage_dedup, quality_model, quality_rules, suffix_dedup, whitening

#: Where the vocabulary lies on every node; never a part of the repository.
VOCABULARY = os.environ.get("BPE_VOCABULARY", "")
WORD_VOCABULARY = os.environ.get("WORD_BPE_VOCABULARY", "")


def vocabulary_path() -> str:
    if VOCABULARY:
        return VOCABULARY
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def word_vocabulary_path() -> str:
    if WORD_VOCABULARY:
        return WORD_VOCABULARY
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(table(spark, sf_dir, "conversations"), vocabulary_path())


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.shared_passages(table(spark, sf_dir, "documents"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.corpus_scores(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), word_vocabulary_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_decontaminate, op2_chat, op3_bpe, op4_quality_rules, op5_passages, op6_quality_model, op7_lm_score, op8_language_id, op9_near_dedup, op10_suffix_dedup, op11_whitening, op12_collocations, op13_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.CONTAMINATION_SQL, "op4_quality_rules": quality_rules.RULES_SQL, "op12_collocations": collocations.PHRASES_SQL}
