"""Readers of the library's JSON artifacts, with explicit schemas; a missing path reads as an empty table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTLINE = T.StructType([T.StructField(n, T.StringType()) for n in ("sample_id", "file_name", "file_format", "source", "library_track", "profile", "document_title", "semantic_retrieval_text")] + [T.StructField("heading_count", T.IntegerType()), T.StructField("top_level_titles", T.ArrayType(T.StringType()))])
BLOCK = T.StructType([T.StructField(n, T.StringType()) for n in ("sample_id", "file_name", "source", "chunk_type", "heading_path", "section_path", "section_type", "equipment_type", "content_form", "content")] + [T.StructField(n, T.IntegerType()) for n in ("chunk_index", "subchunk_index", "token_count")])
SNAPSHOT = T.StructType([T.StructField("generated_at", T.TimestampType()), T.StructField("project", T.StructType([T.StructField("id", T.StringType())])), T.StructField("summary", T.MapType(T.StringType(), T.StringType()))])


def entries(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The ``entries`` of library files, with missing text as the empty text."""
    outer = T.StructType([T.StructField("entries", T.ArrayType(schema))])
    try:
        read = spark.read.schema(outer).option("multiLine", True).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        read = spark.createDataFrame([], outer)
    found = read.select(F.inline("entries"))
    return found.select(*(F.coalesce(f.name, F.lit("")).alias(f.name) if f.dataType == T.StringType() else F.col(f.name) for f in schema))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A row for each snapshot file, in order of time."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).orderBy("generated_at")
