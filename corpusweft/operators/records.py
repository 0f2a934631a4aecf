"""Records of projects, chunks and libraries: filters, order of versions, precedence of sources, budgets of material.

All functions take tables or columns of one's own; the queries below put test tables into their shape. Nulls: a filter that is
null does not filter; a null version is the lowest, as is a null time within a version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import plain, query, shaped

#: How many chunks of a document are looked at for keywords, how many are taken; how many assets count in a budget.
LOOKED_AT, TAKEN, ASSETS = 24, 4, 3
UPLOADED = "uploaded_document"


def matching_chunks(chunks: DataFrame, documents: DataFrame, project: str | None = None, industry: str | None = None, year_from: int | None = None, chunk_types: list[str] | None = None, doc_type: str | None = None, file_names: list[str] | None = None) -> DataFrame:
    """The chunks (document_id, chunk_type, meta) of documents (document_id, project_id, doc_type, filename) that meet all filters given; meta is a JSON text."""
    meta = lambda path: F.get_json_object("meta", f"$.{path}")
    of_chunks = [(meta("industry") == industry) if industry else None, (meta("year").try_cast("int") >= year_from) if year_from else None, F.col("chunk_type").isin(chunk_types) if chunk_types else None]
    of_documents = [(F.col("project_id") == project) if project else None, (F.col("doc_type") == doc_type) if doc_type else None, F.col("filename").isin(file_names) if file_names else None]
    met = lambda df, tests: reduce(DataFrame.filter, (t for t in tests if t is not None), df)
    return met(chunks, of_chunks).join(met(documents, of_documents).select("document_id"), "document_id")


def chunk_retrieval_text(semantic: Column, *parts: Column) -> Column:
    """The semantic text of a chunk where it has one, else its non-empty parts, a line each."""
    return F.coalesce(F.nullif(F.trim(semantic), F.lit("")), T.joined_parts(*parts))


def latest_contents(files: DataFrame) -> DataFrame:
    """(content_sha256, document_id, n): of the files (document_id, content, created_at) with equal content the latest, of equal times the greatest id."""
    hashed = files.select("document_id", "created_at", F.sha2("content", 256).alias("content_sha256"))
    return hashed.groupBy("content_sha256").agg(F.max_by("document_id", F.struct("created_at", "document_id")).alias("document_id"), F.count("*").alias("n"))


def preferred_entries(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One entry (place, source, ...) of each key: the first that was uploaded, else the first; in the place where the key came first."""
    others = [n for n in entries.columns if n not in (*keys, "place")]
    order = F.struct((F.coalesce(F.trim("source"), F.lit("")) != UPLOADED).alias("baseline"), "place")
    return entries.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_e"), F.min("place").alias("place")).select(*keys, "_e.*", "place")


def version_order(version: Column, created_at: Column) -> Column:
    """What versions are ordered by: the version, then the time."""
    return F.struct(F.coalesce(version, F.lit(0)).alias("version"), created_at.alias("at"))


def bound_bundles(outlines: DataFrame, bundles: DataFrame) -> DataFrame:
    """(outline_id, bundle_id, was_rebound): the bundle that each outline (outline_id, project_id, bundle_id) uses: its project's latest, where that is later than its own.

    bundles: (bundle_id, project_id, version, created_at). A bundle of another project is no bundle of an outline.
    """
    keyed = bundles.withColumn("_order", version_order(F.col("version"), F.col("created_at")))
    latest = keyed.groupBy("project_id").agg(F.max_by("bundle_id", F.struct("_order", "bundle_id")).alias("_latest"), F.max("_order").alias("_best"))
    own = keyed.select(F.col("bundle_id"), F.col("project_id"), F.col("_order").alias("_own"))
    rows = outlines.join(own, ["bundle_id", "project_id"], "left").join(latest, "project_id", "left")
    later = F.col("_own").isNull() | (F.col("_best") > F.col("_own"))
    chosen = F.when(F.col("_latest").isNotNull() & later, F.col("_latest")).when(F.col("_own").isNotNull(), F.col("bundle_id"))
    return rows.select("outline_id", chosen.alias("bundle_id"), (chosen.isNotNull() & ~chosen.eqNullSafe(F.col("bundle_id"))).alias("was_rebound"))


def next_versions(projects: DataFrame, drafts: DataFrame) -> DataFrame:
    """(project_id, next_version): one more than the project's current version and all of its drafts'; 1 where there is none."""
    most = drafts.groupBy("project_id").agg(F.max("version").alias("_v"))
    return projects.join(most, "project_id", "left").select("project_id", (F.greatest(F.coalesce("current_version", F.lit(0)), F.coalesce("_v", F.lit(0))) + 1).alias("next_version"))


def draft_versions(drafts: DataFrame) -> DataFrame:
    """The drafts (project_id, section_id, place, version) with ``next_version`` as it stood when each was written: one more than the running maximum.

    Of drafts at one place the lower version counts as written first, so that the result does not hang on the order of the rows.
    """
    so_far = Window.partitionBy("project_id", "section_id").orderBy("place", "version").rowsBetween(Window.unboundedPreceding, 0)
    return drafts.withColumn("next_version", F.coalesce(F.max("version").over(so_far), F.lit(0)) + 1)


def material_budget(blocks: DataFrame, assets: DataFrame, most: int) -> DataFrame:
    """(section_id, block_tokens, asset_tokens, within_budget) of a section's blocks (section_id, text) and the first assets (section_id, place, title, caption, heading, preview)."""
    of_blocks = blocks.groupBy("section_id").agg(F.sum(T.chunk_tokens(F.coalesce("text", F.lit("")))).alias("block_tokens"))
    text = F.concat_ws(" ", *(F.nullif(n, F.lit("")) for n in ("title", "caption", "heading", "preview")))
    first = assets.withColumn("_n", F.row_number().over(Window.partitionBy("section_id").orderBy("place"))).filter(F.col("_n") <= ASSETS)
    of_assets = first.groupBy("section_id").agg(F.sum(T.chunk_tokens(text)).alias("asset_tokens"))
    rows = of_blocks.join(of_assets, "section_id", "full")
    zero = lambda n: F.coalesce(n, F.lit(0))
    return rows.select("section_id", zero("block_tokens").alias("block_tokens"), zero("asset_tokens").alias("asset_tokens"), (zero("block_tokens") <= most).alias("within_budget"))


def clamped_similarity(a: Column, b: Column) -> Column:
    """The dot product of two vectors of length one, within 0 and 1; 0 for a missing or empty one."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))).otherwise(F.lit(0.0))


def keyword_context(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(document_id, chunk_index, hits, place): of each document's first chunks those with most of its keywords, or the very first where none has any.

    chunks: (document_id, chunk_index, heading, content); asked: (document_id, keywords). Occurrences count, overlaps do not.
    """
    first = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index"))).filter(F.col("_n") <= LOOKED_AT)
    hay = F.lower(F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))))
    words = F.filter(F.transform("keywords", lambda w: F.lower(w)), lambda w: w != "")
    hits = F.aggregate(F.transform(words, lambda w: ((F.length("_hay") - F.length(F.replace(F.col("_hay"), w, F.lit("")))) / F.length(w)).cast("long")), F.lit(0).cast("long"), lambda s, n: s + n)
    rows = first.withColumn("_hay", hay).join(asked, "document_id").withColumn("hits", hits)
    of = Window.partitionBy("document_id")
    some = rows.withColumn("_any", F.max("hits").over(of)).filter((F.col("hits") > 0) | (F.col("_any") == 0))
    ranked = some.withColumn("place", F.row_number().over(of.orderBy(F.desc("hits"), "chunk_index")))
    return ranked.filter(F.col("place") <= TAKEN).select("document_id", "chunk_index", "hits", "place")


_META = """SELECT doc_id, doc_id % 50 AS document_id, CASE doc_id % 3 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'IMAGE' ELSE 'PLAIN' END AS chunk_type, '{"industry": "' || lang || '", "year": ' || CASE WHEN doc_id % 7 = 0 THEN '"x"' ELSE CAST(2000 + doc_id % 30 AS STRING) END || '}' AS meta FROM {documents}"""
_OWNERS = "SELECT DISTINCT doc_id % 50 AS document_id, CAST(doc_id % 50 % 2 AS STRING) AS project_id, CASE doc_id % 50 % 3 WHEN 0 THEN 'historical' ELSE 'own' END AS doc_type, 'f' || CAST(doc_id % 50 % 5 AS STRING) AS filename FROM {documents}"


def _spark_json(sql: str) -> str:
    return sql.replace('{"industry"', "' || chr(123) || '\"industry\"").replace("|| '}' AS meta", "|| chr(125) AS meta")


@query(
    f"""SELECT doc_id FROM ({plain(_META)}) JOIN ({plain(_OWNERS)}) USING (document_id) WHERE project_id = '0' AND json_extract_string(meta, '$.industry') = 'en' AND TRY_CAST(json_extract_string(meta, '$.year') AS INT) >= 2010 AND chunk_type IN ('TABLE', 'PLAIN') AND doc_type = 'own' AND filename IN ('f1', 'f2', 'f4')"""
)
def relational_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by project, industry, year, type of chunk and document, and file."""
    return matching_chunks(shaped(spark, sf_dir, _spark_json(_META)), shaped(spark, sf_dir, _OWNERS), "0", "en", 2010, ["TABLE", "PLAIN"], "own", ["f1", "f2", "f4"]).select("doc_id")


@query("SELECT doc_id, CASE WHEN trim(CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN ' ' END, ' ') <> '' THEN source ELSE array_to_string(list_filter([lang, CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, substr(text, 1, 20)], lambda x: x <> ''), chr(10)) END AS t FROM documents")
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text by which each chunk is found."""
    rows = shaped(spark, sf_dir, "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN ' ' END AS semantic, lang, CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS a, substr(text, 1, 20) AS b FROM {documents}")
    return rows.select("doc_id", chunk_retrieval_text(F.col("semantic"), F.col("lang"), F.col("a"), F.col("b")).alias("t"))


@query("SELECT sha256(text) AS content_sha256, arg_max(doc_id, (doc_id % 5, doc_id)) AS document_id, count(*) AS n FROM documents GROUP BY 1")
def latest_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest document of each content."""
    return latest_contents(shaped(spark, sf_dir, "SELECT doc_id AS document_id, text AS content, doc_id % 5 AS created_at FROM {documents}"))


_ENTRIES = "SELECT o_custkey AS k, o_orderpriority AS p, o_orderkey AS place, o_orderkey AS entry, CASE o_orderstatus WHEN 'O' THEN 'uploaded_document' WHEN 'P' THEN NULL ELSE 'baseline' END AS source FROM {orders}"


@query(f"WITH e AS ({plain(_ENTRIES)}) SELECT k, p, arg_min(entry, (CASE WHEN source = 'uploaded_document' THEN 0 ELSE 1 END, place)) AS entry, min(place) AS place FROM e GROUP BY 1, 2")
def library_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one key, uploaded ones before others, where the key came first."""
    return preferred_entries(shaped(spark, sf_dir, _ENTRIES), ["k", "p"]).select("k", "p", "entry", "place")


_BUNDLES = "SELECT o_orderkey AS bundle_id, o_custkey AS project_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS version, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS created_at FROM {orders}"
_OUTLINES = "SELECT c_custkey AS outline_id, c_custkey AS project_id, b.bundle_id FROM {customer} LEFT JOIN (SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN max(o_orderkey) ELSE min(o_orderkey) + o_custkey % 2 END AS bundle_id FROM {orders} GROUP BY o_custkey) b ON o_custkey = c_custkey"


@query(
    f"""WITH b AS (SELECT *, coalesce(version, 0) AS v, coalesce(created_at, TIMESTAMP '0001-01-01') AS a FROM ({plain(_BUNDLES)})), l AS (SELECT project_id, arg_max(bundle_id, (v, a, bundle_id)) AS latest, max((v, a)) AS best FROM b GROUP BY 1),
    j AS (SELECT o.*, own.bundle_id IS NOT NULL AS has, (own.v, own.a) AS mine, latest, best FROM ({plain(_OUTLINES)}) o LEFT JOIN b own ON own.bundle_id = o.bundle_id AND own.project_id = o.project_id LEFT JOIN l ON l.project_id = o.project_id),
    c AS (SELECT outline_id, bundle_id AS was, CASE WHEN latest IS NOT NULL AND (NOT has OR best > mine) THEN latest WHEN has THEN bundle_id END AS bundle_id FROM j) SELECT outline_id, bundle_id, bundle_id IS NOT NULL AND bundle_id IS DISTINCT FROM was AS was_rebound FROM c"""
)
def bundle_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bundle each outline uses."""
    return bound_bundles(shaped(spark, sf_dir, _OUTLINES), shaped(spark, sf_dir, _BUNDLES))


@query("SELECT l_orderkey AS project_id, l_returnflag AS section_id, l_linenumber * 1000000 + l_partkey AS place, coalesce(max(CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_partkey % 9 AS INT) END) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber * 1000000 + l_partkey ROWS UNBOUNDED PRECEDING), 0) + 1 AS next_version FROM lineitem")
def section_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that each draft's successor gets."""
    rows = shaped(spark, sf_dir, "SELECT l_orderkey AS project_id, l_returnflag AS section_id, l_linenumber * 1000000 + l_partkey AS place, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_partkey % 9 AS INT) END AS version FROM {lineitem}")
    return draft_versions(rows).drop("version")


@query("SELECT c_custkey AS project_id, greatest(c_custkey % 6, coalesce(v, 0)) + 1 AS next_version FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey % 11) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def project_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next version of each project."""
    return next_versions(shaped(spark, sf_dir, "SELECT c_custkey AS project_id, c_custkey % 6 AS current_version FROM {customer}"), shaped(spark, sf_dir, "SELECT o_custkey AS project_id, o_orderkey % 11 AS version FROM {orders}"))


@query(
    """WITH b AS (SELECT doc_id % 90 AS section_id, sum(greatest(1, length(text) // 4))::BIGINT AS t FROM documents GROUP BY 1), a AS (SELECT p_partkey % 110 AS section_id, p_partkey AS place, concat_ws(' ', nullif(p_name, ''), CASE WHEN p_partkey % 2 = 0 THEN p_type END, nullif(p_brand, '')) AS x FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY place) AS n FROM a), c AS (SELECT section_id, sum(greatest(1, length(x) // 4))::BIGINT AS t FROM r WHERE n <= 3 GROUP BY 1)
    SELECT section_id, coalesce(b.t, 0) AS block_tokens, coalesce(c.t, 0) AS asset_tokens, coalesce(b.t, 0) <= 7000 AS within_budget FROM b FULL JOIN c USING (section_id)"""
)
def material_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the material of each section costs, its first three assets included."""
    blocks = shaped(spark, sf_dir, "SELECT doc_id % 90 AS section_id, text FROM {documents}")
    assets = shaped(spark, sf_dir, "SELECT p_partkey % 110 AS section_id, p_partkey AS place, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS caption, '' AS heading, p_brand AS preview FROM {part}")
    return material_budget(blocks, assets, 7000)


@query("SELECT a.vec_id, round(greatest(0.0, least(1.0, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 3)), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped similarity of neighbouring vectors, one of them three times as long."""
    rows = shaped(spark, sf_dir, "SELECT a.vec_id, transform(a.embedding, x -> CAST(x AS DOUBLE) * 3) AS x, b.embedding AS y FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1")
    return rows.select("vec_id", F.round(clamped_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query(
    """WITH c AS (SELECT doc_id AS document_id, lang, source, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM documents), h AS (SELECT *, lower(CASE WHEN chunk_index % 2 = 0 THEN lang ELSE '' END || chr(10) || content) AS hay FROM c WHERE chunk_index < 24),
    s AS (SELECT document_id, chunk_index, (len(hay) - len(replace(hay, 'tion', ''))) // 4 + (len(hay) - len(replace(hay, lang, ''))) // 2 AS hits FROM h), m AS (SELECT *, max(hits) OVER (PARTITION BY document_id) AS most FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY hits DESC, chunk_index) AS place FROM m WHERE hits > 0 OR most = 0)
    SELECT document_id, chunk_index::INT AS chunk_index, hits::BIGINT AS hits, place::INT AS place FROM r WHERE place <= 4"""
)
def keyword_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each document that hold most of its keywords."""
    docs = shaped(spark, sf_dir, "SELECT doc_id, text, lang FROM {documents}")
    chunks = docs.select(F.col("doc_id").alias("document_id"), "lang", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content")).withColumn("heading", F.when(F.col("chunk_index") % 2 == 0, F.col("lang"))).drop("lang")
    return keyword_context(chunks, docs.select(F.col("doc_id").alias("document_id"), F.array(F.lit("TION"), "lang", F.lit("")).alias("keywords")))
