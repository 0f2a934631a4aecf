"""Projections of documents and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..registry import query, table


@query(
    """SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, greatest(1, length(text) // 4)::BIGINT AS chunk_tokens,
    trim(regexp_replace(regexp_replace(lower(source || ' ' || lang || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
    array_to_string(list_filter([lang, source], lambda x: x <> ''), chr(10)) AS retrieval_text FROM documents"""
)
def document_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimates, slug and retrieval text."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.estimated_tokens(text).alias("tokens"),
        T.chunk_tokens(text).alias("chunk_tokens"),
        T.slug(F.concat_ws("", "source", F.lit(" "), "lang", F.lit("!"))).alias("slug"),
        T.joined_parts(F.col("lang"), F.col("source")).alias("retrieval_text"),
    )


@query(
    r"""SELECT doc_id, CASE WHEN length(flat) <= 180 THEN flat ELSE rtrim(substring(flat, 1, 179), ' ') || '...' END AS summary
    FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS flat FROM documents)"""
)
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 180 characters of each document as one line."""
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 180).alias("summary"))


@query(
    """SELECT o_orderkey, round(greatest(0.0, least(1.0, (o_totalprice / 500000.0) * (CASE WHEN o_orderpriority LIKE '1%' THEN 0.55 WHEN o_orderpriority LIKE '2%' THEN 0.8 ELSE 1.0 END)
    * (CASE WHEN o_orderstatus = 'F' THEN 0.35 ELSE 1.0 END) * (CASE WHEN o_orderstatus = 'P' THEN 0.85 ELSE 1.0 END))), 4) AS reusability FROM orders"""
)
def reusability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores scaled by risk, front matter and missing assets."""
    risk = F.when(F.col("o_orderpriority").startswith("1"), F.lit("high")).when(F.col("o_orderpriority").startswith("2"), F.lit("medium")).otherwise(F.lit("low"))
    scored = S.reusability(F.col("o_totalprice") / 500000.0, risk, F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P")
    return table(spark, sf_dir, "orders").select("o_orderkey", scored.alias("reusability"))


@query(
    """SELECT event_id, CAST(value AS DECIMAL(10, 4)) AS cost, round(1 / (1 + exp(-value / 100)), 6) AS chance, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 0 THEN round(value / TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 9) END AS ratio FROM events"""
)
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal cost, sigmoid, safe casts and safe ratios."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf_dir, "events").select("event_id", F.col("value").cast("decimal(10,4)").alias("cost"), F.round(S.sigmoid(F.col("value") / 100), 6).alias("chance"), k.alias("k"), F.round(S.safe_ratio(F.col("value"), k), 9).alias("ratio"))


@query(
    r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[a-z]+\.[0-9]+@mail[0-9]+\.example\.com'))) AS found FROM documents WHERE contains(text, '@mail')"""
)
def address_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sorted matches of a pattern."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[a-z]+\.[0-9]+@mail[0-9]+\.example\.com"), 0)))
    return table(spark, sf_dir, "documents").filter(F.col("text").contains("@mail")).select("doc_id", found.alias("found"))
