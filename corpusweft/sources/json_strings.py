"""The texts of files of any shape: raw ones whole, JSON ones as the strings that stand in it, at any depth.

JSON is read as VARIANT and opened level by level; only what still holds other values goes to the next level, so a level
costs what is left, and the number of levels is that of the deepest file. Objects lose the order of their keys on the way:
fragments come with the places that lead to them, keys in alphabetical order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, shaped
from .shared import checkpointed

#: Keys whose strings are texts; strings under other keys are none, but lists and objects are looked into.
TEXT_KEYS = ("content_md", "contextual_text", "semantic_retrieval_text", "section_path", "source_heading", "heading_path", "title", "display_title", "summary")
#: Keys whose scalars tell where evidence comes from, and how many different ones count.
EVIDENCE_KEYS = ("title", "section_title", "source_title", "source_heading", "section_path", "heading_path", "retrieval_subsection_title", "document_name", "file_name", "reason", "retrieval_reason")
MOST = 300


def fragments(files: DataFrame, keys: tuple[str, ...] = TEXT_KEYS) -> DataFrame:
    """(path, place array<int>, fragment) of files (path, text): a text as it is, or a JSON file's strings under the keys and in lists.

    What is no valid JSON counts as text. A null text has no fragment; an empty one is an empty fragment.
    """
    c = F.col
    rows = files.select("path", "text").filter(c("text").isNotNull()).withColumn("value", F.when(F.lower("path").endswith(".json"), F.try_parse_json("text")))
    none = F.array().cast("array<int>")
    out = [rows.filter(c("value").isNull()).select("path", none.alias("place"), c("text").alias("fragment"))]
    level = checkpointed(rows.filter(c("value").isNotNull()).select("path", none.alias("place"), F.lit(None).cast("string").alias("key"), "value"))
    while not level.isEmpty():
        kind = F.schema_of_variant("value")
        text = level.filter((kind == "STRING") & (c("key").isNull() | c("key").isin(*keys)))
        out.append(text.select("path", "place", F.variant_get("value", "$", "string").alias("fragment")))
        inner = level.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY")).select("path", c("place").alias("above"), c("value").alias("whole"))
        opened = inner.lateralJoin(level.sparkSession.tvf.variant_explode(c("whole").outer()))
        level = checkpointed(opened.select("path", F.concat("above", F.array("pos")).alias("place"), "key", "value"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def evidence_scalars(rows: DataFrame, id_column: str, json_column: str, keys: tuple[str, ...] = EVIDENCE_KEYS, most: int = MOST) -> DataFrame:
    """(id, strings): the different scalars under the keys of a JSON text, also in lists there, in the order of the text, the first ``most``.

    The order of keys counts, which VARIANT does not keep, so each text is walked by itself. What is no JSON has none.
    """
    kind = rows.schema[id_column].dataType.simpleString()

    def scalars(text: str | None) -> list[str]:
        try:
            open_ones = [("", json.loads(text))] if text else []
        except ValueError:
            return []
        found: dict[str, None] = {}
        while open_ones:
            key, node = open_ones.pop()
            if isinstance(node, dict):
                open_ones += reversed(node.items())
            elif isinstance(node, list):
                open_ones += ((key, x) for x in reversed(node))
            elif key in keys and node is not None and (value := str(node).strip()):
                found[value] = None
        return list(found)[:most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scalars(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["id", "strings"])

    return rows.select(F.col(id_column).alias("id"), F.col(json_column).alias("json")).mapInArrow(run, f"id {kind}, strings array<string>").withColumnRenamed("id", id_column)


_FILES = r"""SELECT 'f' || CAST(doc_id AS STRING) || CASE doc_id % 4 WHEN 0 THEN '.md' ELSE '.JSON' END AS path, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '{"title": "' || source || '", "skip": "title", "n": 3, "items": [{"summary": "a\"' || lang || '"}, {"deep": {"title": ["x", ["' || lang || '"]], "other": "\"title\": \"no\""}}, "free"]}'
    WHEN 2 THEN '[["' || source || '", 1, null, true], {"heading_path": {"q": {"title": "deep"}}}]' ELSE '{"title": ' || lang END AS text FROM documents_table"""


@query(
    f"""WITH f AS ({_FILES.replace('documents_table', 'documents')}), d AS (SELECT doc_id, source, lang, 'f' || doc_id || '.JSON' AS p FROM documents) SELECT path, '' AS place, text AS fragment FROM f WHERE path LIKE '%.md' OR text LIKE '{{"title": __'
    UNION ALL SELECT p, unnest(['3', '0.0.0', '0.1.0.1.0', '0.1.0.1.1.0', '0.2']), unnest([source, 'a"' || lang, 'x', lang, 'free']) FROM d WHERE doc_id % 4 = 1 UNION ALL SELECT p, unnest(['0.0', '1.0.0.0']), unnest([source, 'deep']) FROM d WHERE doc_id % 4 = 2"""
)
def text_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings of Markdown and JSON files."""
    docs = shaped(spark, sf_dir, "SELECT doc_id, text, source, lang FROM {documents}")
    files = docs.select(*(F.expr(part).alias(name) for name, part in _file_parts().items()))
    return fragments(files).withColumn("place", F.array_join(F.col("place").cast("array<string>"), "."))


def _file_parts() -> dict[str, str]:
    """The columns of these files as expressions; Spark reads a backslash in a literal as the start of an escape."""
    body = _FILES.removeprefix("SELECT ").removesuffix(" FROM documents_table")
    path, text = body.split(" AS path, ")
    return {"path": path, "text": text.removesuffix(" AS text").replace("\\", "\\\\")}


@query("SELECT event_id, event_type || '|r' || user_id || '|' || user_id % 7 AS strings FROM events")
def evidence_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars under chosen keys of nested JSON."""
    rows = shaped(spark, sf_dir, "SELECT event_id, event_type, user_id FROM {events}")
    j = F.concat(F.lit('{"title": "'), "event_type", F.lit('", "items": [{"reason": ["r'), F.col("user_id").cast("string"), F.lit('", "'), "event_type", F.lit('"], "skip": "\\"title\\": \\"no\\""}, {"deep": {"zz": 1, "title": null, "file_name": '), (F.col("user_id") % 7).cast("string"), F.lit('}}], "other": "title"}'))
    return evidence_scalars(rows.withColumn("j", j), "event_id", "j").withColumn("strings", F.array_join("strings", "|"))
