"""An index of parsed documents that batches write and replays leave as it is.

A batch goes into folders of its own: first the chunks of its documents, then the list of these documents with their
versions. A document's chunks are those of its highest version (of equal ones the later batch's), so a newer version takes
the place of an older one as if that were deleted, and a late older one changes nothing. A batch that died between the two
writes has chunks that no list names, which nobody sees; written again, it replaces its own folders and nothing else.

Every write is as large as its batch. ``compacted`` copies what counts into a new folder, so that reading stays as large as the index.
Nulls: documents without an id are left out; a null version counts as 0, a null text has no chunks; of a document that occurs more
than once in a batch the highest version counts, of equal ones the greatest text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import chunks as C
from ..operators import chunking
from ..registry import query, shaped
from ..sources.shared import shared_folder

Parser = Callable[[DataFrame], DataFrame]


def parsed(docs: DataFrame) -> DataFrame:
    """The chunks of documents (doc_id, text) that may be indexed: those that the ingestion rules find nothing wrong with."""
    found = chunking.chunked(docs.select("doc_id", "text"))
    reasons = C.ingestion_reasons(F.col("content"), F.col("chunk_type"), F.col("chunk_index"), F.coalesce("heading_path", F.lit("")))
    return found.filter(F.size(reasons) == 0)


def newest(batch: DataFrame) -> DataFrame:
    """One row per document of a batch (doc_id, version, text, deleted)."""
    rows = batch.filter("doc_id is not null").withColumns({"version": F.coalesce(F.col("version").cast("long"), F.lit(0)), "deleted": F.coalesce("deleted", F.lit(False))})
    best = Window.partitionBy("doc_id").orderBy(F.desc("version"), F.desc("deleted"), F.desc("text"))
    return rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def write_batch(batch: DataFrame, batch_id: int, folder: str, parse: Parser = parsed) -> None:
    """Put a batch into the index, or put it there again."""
    docs = newest(batch)
    parse(docs.filter("not deleted")).write.mode("overwrite").parquet(f"{folder}/chunks/batch={batch_id}")
    docs.select("doc_id", "version", "deleted").write.mode("overwrite").parquet(f"{folder}/documents/batch={batch_id}")


def index_stream(stream: DataFrame, folder: str, parse: Parser = parsed) -> DataStreamWriter:
    """A writer for a stream of (doc_id, version, text, deleted); its checkpoint numbers the batches, so a restart repeats the last one."""
    return stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, folder, parse)).option("checkpointLocation", f"{folder}/progress")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, version, batch) of the documents in the index."""
    docs = spark.read.option("basePath", f"{folder}/documents").parquet(f"{folder}/documents")
    last = docs.groupBy("doc_id").agg(F.max(F.struct("version", F.col("batch").cast("long").alias("batch"), "deleted")).alias("l"))
    return last.filter("not l.deleted").select("doc_id", "l.version", "l.batch")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of the index, with version."""
    chunks = spark.read.option("basePath", f"{folder}/chunks").parquet(f"{folder}/chunks").withColumn("batch", F.col("batch").cast("long"))
    return chunks.join(listed(spark, folder), ["doc_id", "batch"]).drop("batch")


def compacted(spark: SparkSession, folder: str, target: str) -> None:
    """Copy the index as one batch before all others into a new folder; batches that come later are written there."""
    current(spark, folder).drop("version").write.mode("overwrite").parquet(f"{target}/chunks/batch=-1")
    listed(spark, folder).select("doc_id", "version", F.lit(False).alias("deleted")).write.mode("overwrite").parquet(f"{target}/documents/batch=-1")


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))


@query(
    r"""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM documents WHERE doc_id % 7 <> 1), c AS (SELECT doc_id, version, unnest(string_split(CASE WHEN version = 2 THEN text || chr(10) || 'more' ELSE text END, chr(10))) AS line FROM d)
    SELECT doc_id, version, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM c GROUP BY 1, 2"""
)
def index_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after all documents, newer versions of some, the same batch once more, late old versions and deletions."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    rows = lambda version, text, test, deleted="false": shaped(spark, sf_dir, f"SELECT doc_id, CAST({version} AS BIGINT) AS version, {text} AS text, {deleted} AS deleted FROM {{documents}} WHERE {test}")
    newer = rows(2, "text || chr(10) || 'more'", "doc_id % 3 = 0")
    for number, batch in enumerate((rows(1, "text", "true"), newer, rows(1, "'late'", "doc_id % 15 = 0"), rows(3, "text", "doc_id % 7 = 1", "true"))):
        write_batch(batch, number, folder, _lines)
    write_batch(newer, 1, folder, _lines)
    return current(spark, folder).groupBy("doc_id", "version").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
