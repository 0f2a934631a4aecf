"""Filters over payloads, terms and chunk quality."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query, table

#: As many terms as a search of the kind takes, unless its caller says otherwise.
MAX_TERMS = 8


def json_long(column: str, path: str) -> Column:
    return F.get_json_object(column, path).try_cast("long")


def any_term(columns: list[str], terms: list[str], most: int = MAX_TERMS) -> Column:
    """Whether any column contains any of the terms, whatever the case; % and _ in a term mean themselves. More than ``most`` terms are an error."""
    clean = [t.lower() for t in terms if t]
    if len(clean) > most:
        raise ValueError(f"{len(clean)} terms, but at most {most} are looked for")
    return reduce(or_, (F.coalesce(F.lower(c).contains(t), F.lit(False)) for c in columns for t in clean), F.lit(False))


@query(
    """SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
    WHERE event_type IN ('click', 'view', 'purchase') AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50"""
)
def payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjunction of match-any and a range over JSON payloads."""
    k = json_long("props", "$.k")
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view", "purchase") & (k >= 50)).select("event_id", "event_type", k.alias("k"))


@query(
    """SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%idiot%' OR lower(text) LIKE '%scum%' OR lower(text) LIKE '%license%' OR contains(lower(text), '@mail')
    OR lower(source) LIKE '%idiot%' OR lower(source) LIKE '%scum%' OR lower(source) LIKE '%license%' OR contains(lower(source), '@mail')"""
)
def term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any of several terms in any of several columns."""
    return table(spark, sf_dir, "documents").filter(any_term(["text", "source"], ["idiot", "scum", "license", "@mail"])).select("doc_id", "source")


@query(
    """SELECT source, sum(length(text) - length(replace(text, 'tion', '')))::BIGINT // 4 AS n_tion, sum(CASE WHEN contains(lower(text), 'disgusting') THEN 1 ELSE 0 END)::BIGINT AS n_forbidden FROM documents GROUP BY source"""
)
def term_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a term occurs, and how many documents hold a forbidden phrase, by source."""
    found = table(spark, sf_dir, "documents").select("source", T.occurrences(F.col("text"), "tion").alias("n"), F.lower("text").contains("disgusting").cast("long").alias("bad"))
    return found.groupBy("source").agg(F.sum("n").alias("n_tion"), F.sum("bad").alias("n_forbidden"))
