"""Lookups that join records of an index: chunks of hits, assets of requests, rows of a cache, samples by file names, summaries of runs.

Nulls: a join key that is null finds nothing; a filter that is null or empty does not filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import plain, query, shaped

TRACK = "pilot_main"
#: Parts into which requests that meet all global assets are dealt out.
PARTS = 256


def chunks_of_hits(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The hits (query_id, project_id, chunk_id, score) with their chunk (chunk_id, document_id, ...) and document (document_id, project_id, ...).

    A vector index may lag behind, so hits without a chunk drop out, as do those of another project where a query names one.
    """
    owners = documents.withColumnRenamed("project_id", "_project")
    joined = hits.join(chunks, "chunk_id").join(owners, "document_id")
    return joined.filter(F.col("project_id").isNull() | (F.col("project_id") == F.col("_project"))).drop("_project")


def assets_of_requests(requests: DataFrame, assets: DataFrame, raws: DataFrame) -> DataFrame:
    """The assets that each request may use, with ``anchored``: of its own project or of all projects, of its types, and of its documents if any of those has one.

    requests: (request_id, project_id, with_global, asset_types, doc_types, names); assets: (asset_id, raw_id, asset_type,
    usable); raws: (raw_id, project_id, scope, doc_type, name). Whether the named documents have any is told by the kinds of
    assets, of which there are few, so what is found, the product of requests and global assets, is neither shuffled nor sorted.
    """
    c = F.col
    own = assets.filter("usable").join(raws.withColumnRenamed("project_id", "_project"), "raw_id")
    asked = requests.select("request_id", "project_id", F.coalesce("with_global", F.lit(False)).alias("with_global"), *(F.filter(F.coalesce(n, F.array().cast("array<string>")), lambda x: F.trim(x) != "").alias(n) for n in ("asset_types", "doc_types", "names")))
    named, free = asked.filter(F.size("names") > 0), asked.filter(F.size("names") == 0)
    by_name = named.withColumn("asked_name", F.explode(F.array_distinct("names")))
    fits = ((F.size("asset_types") == 0) | F.array_contains("asset_types", c("asset_type"))) & ((F.size("doc_types") == 0) | F.array_contains("doc_types", c("doc_type")))
    everywhere = own.filter("scope = 'global'")

    def found(requests: DataFrame, *same: Column) -> DataFrame:
        """Two equi-joins in place of one with "or": by project, and for all that is global."""
        local = requests.join(own, [c("project_id") == c("_project"), *same]).filter(fits)
        # every asking request meets all global assets of its kinds: the requests are dealt out, the assets go to each part
        kinds = everywhere.select(c("asset_type").alias("_type"), c("doc_type").alias("_doc")).distinct()
        wanted = ((F.size("asset_types") == 0) | F.array_contains("asset_types", c("_type"))) & ((F.size("doc_types") == 0) | F.array_contains("doc_types", c("_doc")))
        asking = requests.filter("with_global").join(F.broadcast(kinds), wanted).withColumn("_to", F.pmod(F.xxhash64("request_id"), F.lit(PARTS)))
        copies = everywhere.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        world = asking.hint("merge").join(copies, [c("_to") == c("_part"), c("_type").eqNullSafe(c("asset_type")), c("_doc").eqNullSafe(c("doc_type")), *same])
        return local.select("request_id", "asset_id", "raw_id").unionAll(world.filter(~F.coalesce(c("_project") == c("project_id"), F.lit(False))).select("request_id", "asset_id", "raw_id"))

    def finding(requests: DataFrame, *same: Column) -> DataFrame:
        """The ids of the requests that find anything, by kinds of assets."""
        local = requests.join(own.select("_project", "asset_type", "doc_type", "name").distinct(), [c("project_id") == c("_project"), *same])
        world = requests.filter("with_global").join(F.broadcast(everywhere.select("asset_type", "doc_type", "name").distinct()), [fits, *same])
        return local.filter(fits).select("request_id").unionAll(world.select("request_id"))

    same_name = c("asked_name") == c("name")
    again = free.join(named.select(c("request_id").alias("_r")), c("request_id").eqNullSafe(c("_r")), "left_semi")  # an id may ask with names and without
    some = finding(by_name, same_name).unionAll(finding(again)).select(c("request_id").alias("_r")).distinct()
    rest = named.join(some, c("request_id").eqNullSafe(c("_r")), "left_anti")
    parts = (found(by_name, same_name), True), (found(free), True), (found(rest), False)
    return reduce(DataFrame.unionAll, (rows.withColumn("anchored", F.lit(anchored)) for rows, anchored in parts))


def cache_rows(assets: DataFrame, raws: DataFrame, include: Column, project: str | None = None, asset_types: list[str] | None = None, doc_type: str | None = None, status: str | None = "done", limit: int = 0) -> DataFrame:
    """Assets (asset_id, raw_id, asset_type, created_at, ...) with their raw documents (raw_id, project_id, doc_type, parse_status, ...), the first ``limit`` in the order of time; only then are those left out that are not to be included."""
    c = F.col
    tests = [(c("project_id") == project) if project else None, c("asset_type").isin(asset_types) if asset_types else None, (c("doc_type") == doc_type) if doc_type else None, (c("parse_status") == status) if status else None]
    rows = reduce(DataFrame.filter, (t for t in tests if t is not None), assets.join(raws, "raw_id"))
    return (rows.orderBy("created_at", "asset_id").limit(limit) if limit > 0 else rows).filter(include)


def samples_of_names(entries: DataFrame, names: DataFrame, tracks: list[str] | None = None) -> DataFrame:
    """(sample_id): of the entries (sample_id, file_name, track) whose file is among the names (file_name), whatever the case and white space."""
    key = lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\s+", "")
    wanted = names.select(key(F.col("file_name")).alias("_key")).filter("_key <> ''")
    own = entries.filter(F.coalesce(F.nullif("track", F.lit("")), F.lit(TRACK)).isin(tracks)) if tracks else entries
    return own.filter(F.trim("sample_id") != "").withColumn("_key", key(F.col("file_name"))).join(wanted, "_key", "left_semi").select(F.trim("sample_id").alias("sample_id")).distinct()


def run_summaries(metrics: DataFrame) -> DataFrame:
    """Of each job's sections (job_id, path, refinement, gate, error, prior_blocks, prior_boost): counts by value as arrays of value=count, rates and sums."""
    c = F.col
    named = {"path": "unknown", "refinement": "not_applicable", "gate": "skipped"}
    rows = metrics.withColumns({n: F.coalesce(F.nullif(n, F.lit("")), F.lit(v)) for n, v in named.items()})
    parts = [rows.groupBy("job_id", c(n).alias("value")).agg(F.count("*").alias("n")).withColumn("of", F.lit(n)) for n in named]
    values = reduce(DataFrame.unionByName, parts).groupBy("job_id").pivot("of", list(named)).agg(F.array_sort(F.collect_list(F.concat("value", F.lit("="), c("n").cast("string")))))  # values are statuses, a few each
    sums = rows.groupBy("job_id").agg(
        F.count("*").alias("total"), F.round(F.count_if(c("refinement").startswith("fallback_")) / F.count("*"), 4).alias("fallback_rate"), F.count_if(F.trim(F.coalesce("error", F.lit(""))) != "").alias("errors"),
        F.count_if(c("prior_blocks") > 0).alias("prior_sections"), F.coalesce(F.sum("prior_blocks"), F.lit(0)).alias("prior_blocks"), F.round(F.coalesce(F.sum("prior_boost"), F.lit(0.0)), 4).alias("prior_boost"),
    )
    return sums.join(values, "job_id")


def queue_counts(jobs: DataFrame) -> DataFrame:
    """(queue, queued, running) of jobs (queue, status)."""
    return jobs.groupBy("queue").agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"))


_HIT = "SELECT l_orderkey * 10 + l_linenumber AS query_id, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey % 5 AS STRING) END AS project_id, l_partkey AS chunk_id, l_discount AS score FROM {lineitem}"
_CHUNK = "SELECT p_partkey AS chunk_id, p_size AS document_id, p_type AS heading FROM {part} WHERE p_partkey % 7 > 0"
_DOCUMENT = "SELECT DISTINCT p_size AS document_id, CAST(p_size % 5 AS STRING) AS project_id FROM {part} WHERE p_size % 11 > 0"


@query(f"SELECT query_id, chunk_id, document_id, heading, score::DOUBLE AS score FROM ({plain(_HIT)}) h JOIN ({plain(_CHUNK)}) USING (chunk_id) JOIN (SELECT document_id, project_id AS owner FROM ({plain(_DOCUMENT)})) USING (document_id) WHERE project_id IS NULL OR project_id = owner")
def hit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks and documents of hits, checked against their project."""
    found = chunks_of_hits(shaped(spark, sf_dir, _HIT), shaped(spark, sf_dir, _CHUNK), shaped(spark, sf_dir, _DOCUMENT))
    return found.select("query_id", "chunk_id", "document_id", "heading", F.col("score").cast("double").alias("score"))


_ASSET = "SELECT p_partkey AS asset_id, CAST(floor(p_partkey / 6) AS BIGINT) AS raw_id, CASE p_partkey % 3 WHEN 0 THEN 'table' ELSE 'figure' END AS asset_type, p_size % 7 > 0 AS usable, p_partkey * 37 % 1009 AS created_at, p_size AS size FROM {part}"
_RAW = "SELECT DISTINCT CAST(floor(p_partkey / 6) AS BIGINT) AS raw_id, CAST(CAST(floor(p_partkey / 60) AS BIGINT) AS STRING) AS project_id, CASE WHEN floor(p_partkey / 6) % 50 = 3 THEN 'global' ELSE 'project' END AS scope, CASE WHEN floor(p_partkey / 6) % 3 = 0 THEN 'own' ELSE 'historical' END AS doc_type, CASE WHEN floor(p_partkey / 6) % 4 = 0 THEN 'queued' ELSE 'done' END AS parse_status, 'd' || CAST(CAST(floor(p_partkey / 6) % 9 AS INT) AS STRING) AS name FROM {part}"
_NEED = "SELECT c_custkey AS request_id, CAST(CAST(floor(c_custkey / 30) AS BIGINT) AS STRING) AS project_id, c_custkey % 20 = 0 AS with_global, CASE c_custkey % 3 WHEN 0 THEN 'table' ELSE '' END AS asset_types, CASE c_custkey % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'own,historical' ELSE '' END AS doc_types, CASE c_custkey % 5 WHEN 0 THEN 'd1,d2' WHEN 1 THEN 'none' ELSE '' END AS names FROM {customer}"


@query(
    f"""WITH q AS (SELECT * REPLACE ({', '.join(f"list_filter(string_split({n}, ','), lambda x: x <> '') AS {n}" for n in ('asset_types', 'doc_types', 'names'))}) FROM ({plain(_NEED)})), j AS (SELECT request_id, asset_id, a.raw_id, len(names) = 0 OR list_contains(names, name) AS anchored FROM ({plain(_ASSET)}) a JOIN ({plain(_RAW)}) r USING (raw_id) JOIN q ON r.project_id = q.project_id OR (q.with_global AND r.scope = 'global')
    WHERE usable AND (len(asset_types) = 0 OR list_contains(asset_types, asset_type)) AND (len(doc_types) = 0 OR list_contains(doc_types, doc_type))), s AS (SELECT *, bool_or(anchored) OVER (PARTITION BY request_id) AS hit_any FROM j) SELECT request_id, asset_id, raw_id, anchored FROM s WHERE anchored OR NOT hit_any"""
)
def request_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assets that each request may use."""
    requests = shaped(spark, sf_dir, _NEED).withColumns({n: F.split(n, ",") for n in ("asset_types", "doc_types", "names")})
    return assets_of_requests(requests, shaped(spark, sf_dir, _ASSET), shaped(spark, sf_dir, _RAW))


@query(f"SELECT asset_id, raw_id FROM (SELECT a.*, r.raw_id AS r FROM ({plain(_ASSET)}) a JOIN ({plain(_RAW)}) r USING (raw_id) WHERE doc_type = 'historical' AND parse_status = 'done' AND asset_type IN ('figure', 'chart') ORDER BY created_at, asset_id LIMIT 150) WHERE size > 20")
def cache_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 150 assets of parsed historical documents, without small ones."""
    return cache_rows(shaped(spark, sf_dir, _ASSET), shaped(spark, sf_dir, _RAW), F.col("size") > 20, asset_types=["figure", "chart"], doc_type="historical", limit=150).select("asset_id", "raw_id")


_NAMED = "SELECT ' s' || CAST(doc_id % 300 AS STRING) AS sample_id, CASE doc_id % 5 WHEN 0 THEN 'File ' || CAST(doc_id % 70 AS STRING) || '.DOCX' ELSE source END AS file_name, CASE doc_id % 3 WHEN 0 THEN 'side' WHEN 1 THEN NULL ELSE 'pilot_main' END AS track FROM {documents}"
_WANTED = "SELECT 'file' || CAST(p_size AS STRING) || ' .docx' AS file_name FROM {part} WHERE p_partkey % 3 = 0"


@query(f"SELECT DISTINCT trim(sample_id) AS sample_id FROM ({plain(_NAMED)}) WHERE coalesce(track, 'pilot_main') = 'pilot_main' AND regexp_replace(lower(trim(file_name)), '\\s+', '', 'g') IN (SELECT regexp_replace(lower(trim(file_name)), '\\s+', '', 'g') FROM ({plain(_WANTED)}))")
def named_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of files by their names."""
    return samples_of_names(shaped(spark, sf_dir, _NAMED), shaped(spark, sf_dir, _WANTED), ["pilot_main"])


_RUNS = "SELECT l_orderkey AS job_id, CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'full' ELSE 'pack' END AS path, CASE l_suppkey % 3 WHEN 0 THEN 'fallback_x' WHEN 1 THEN 'done' END AS refinement, l_returnflag AS gate, CASE l_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'broken' END AS error, CAST(l_linenumber % 3 AS INT) AS prior_blocks, CAST(l_quantity AS DOUBLE) / 100 AS prior_boost FROM {lineitem}"


@query(
    f"""WITH r AS (SELECT * REPLACE (coalesce(nullif(path, ''), 'unknown') AS path, coalesce(nullif(refinement, ''), 'not_applicable') AS refinement) FROM ({plain(_RUNS)})), v AS (SELECT job_id, 'path' AS k, path || '=' || count(*) AS x FROM r GROUP BY job_id, path UNION ALL SELECT job_id, 'refinement', refinement || '=' || count(*) FROM r GROUP BY job_id, refinement UNION ALL SELECT job_id, 'gate', gate || '=' || count(*) FROM r GROUP BY job_id, gate),
    w AS (SELECT job_id, string_agg(x, ',' ORDER BY x) FILTER (WHERE k = 'path') AS path, string_agg(x, ',' ORDER BY x) FILTER (WHERE k = 'refinement') AS refinement, string_agg(x, ',' ORDER BY x) FILTER (WHERE k = 'gate') AS gate FROM v GROUP BY 1)
    SELECT job_id, count(*) AS total, round(count(*) FILTER (WHERE starts_with(r.refinement, 'fallback_')) / count(*), 4) AS fallback_rate, count(*) FILTER (WHERE trim(coalesce(error, '')) <> '') AS errors, count(*) FILTER (WHERE prior_blocks > 0) AS prior_sections, sum(prior_blocks)::BIGINT AS prior_blocks, round(sum(prior_boost), 4) AS prior_boost, any_value(w.path) AS path, any_value(w.refinement) AS refinement, any_value(w.gate) AS gate FROM r JOIN w USING (job_id) GROUP BY 1"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each job's sections."""
    return run_summaries(shaped(spark, sf_dir, _RUNS)).withColumns({n: F.array_join(n, ",") for n in ("path", "refinement", "gate")})


@query("SELECT o_orderpriority AS queue, count(*) FILTER (WHERE o_orderstatus = 'O') AS queued, count(*) FILTER (WHERE o_orderstatus = 'P') AS running FROM orders GROUP BY 1")
def queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs of each queue wait and run."""
    return queue_counts(shaped(spark, sf_dir, "SELECT o_orderpriority AS queue, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status FROM {orders}"))
