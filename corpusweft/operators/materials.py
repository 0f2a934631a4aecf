"""Material rows of a library: status, flags, summaries, lists; changes to stored points; drafts in order; snapshots compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import plain, query, shaped, table

#: Order of reused blocks by kind, and the drop of a score that counts as a regression.
BLOCK_ORDER, REGRESSION = ("opening", "overview", "detail", "table", "figure"), 0.05
READY = ("main_indexed", "pilot")


def material_rows(entries: DataFrame, documents: DataFrame, chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """Each entry (sample_id, route, n_images) with its latest document (sample_id, document_id, created_at, parse_status), numbers of chunks (document_id, indexed) and assets (document_id, fallback), and flags."""
    latest = documents.groupBy("sample_id").agg(F.max_by(F.struct("document_id", "parse_status"), F.struct("created_at", "document_id")).alias("d")).select("sample_id", "d.*")
    of_chunks = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count_if("indexed").alias("n_indexed"))
    of_assets = assets.groupBy("document_id").agg(F.count("*").alias("n_assets"), F.count_if("fallback").alias("n_fallback"))
    joined = entries.join(latest, "sample_id", "left").join(of_chunks, "document_id", "left").join(of_assets, "document_id", "left").fillna(0, ["n_chunks", "n_indexed", "n_assets", "n_fallback"])
    c = F.col
    flags = F.array(
        F.when(c("document_id").isNull() & ~c("route").isin("conversion_required", "excluded"), F.lit("not_ingested")),
        F.when(c("document_id").isNotNull() & (c("parse_status") != "done"), F.when(c("parse_status") == "failed", F.lit("parse_failed")).otherwise(F.concat(F.lit("parse_status:"), "parse_status"))),
        F.when((c("n_images") > 0) & (c("n_assets") == 0), F.lit("expected_images_but_no_figure_assets")),
        F.when((c("n_assets") > 0) & (c("n_assets") == c("n_fallback")), F.lit("all_assets_are_storage_fallback")),
        F.when(c("route") == "conversion_required", F.lit("conversion_required")),
    )
    return joined.select("sample_id", "route", "document_id", "parse_status", "n_chunks", "n_indexed", "n_assets", "n_fallback", F.array_compact(flags).alias("flags"))


def material_summary(rows: DataFrame) -> DataFrame:
    """Totals of material rows, and how many have each route."""
    routes = rows.groupBy(F.coalesce("route", F.lit("unknown")).alias("route")).agg(F.count("*").alias("total"), F.count("document_id").alias("n_ingested"), F.sum("n_assets").alias("n_assets"), F.sum("n_indexed").alias("n_indexed"))
    whole = routes.agg(*(F.sum(c).alias(c) for c in ("total", "n_ingested", "n_assets", "n_indexed"))).select(F.lit("*").alias("route"), "*")
    return routes.unionByName(whole)


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n): how often each value of each column occurs, by one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def without_points(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The points whose id is not listed."""
    return points.join(ids.select("id").distinct(), "id", "left_anti")


def patched(points: DataFrame, patches: DataFrame) -> DataFrame:
    """Points (id, payload map) with the keys of patches (id, payload map) put over their own."""
    own, new = F.col("payload"), F.col("_patch")
    kept = F.map_filter(own, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    joined = points.join(patches.select("id", F.col("payload").alias("_patch")), "id", "left")
    return joined.select("id", F.when(new.isNull(), own).otherwise(F.map_concat(kept, new)).alias("payload"))


def with_defaults(base: Column, more: Column) -> Column:
    """A map with the entries of another for keys that it lacks."""
    return F.map_concat(base, F.map_filter(more, lambda k, v: ~F.map_contains_key(base, k)))


def channel_tables(vectors: DataFrame) -> DataFrame:
    """Vectors (id, channel, vector) that have the dimension of their channel's first one (by id)."""
    first = vectors.groupBy("channel").agg(F.min_by(F.size("vector"), "id").alias("dimension"))
    return vectors.join(first, "channel").filter(F.size("vector") == F.col("dimension"))


def write_channels(vectors: DataFrame, folder: str) -> None:
    """A part of a table for each channel, replacing what was there."""
    channel_tables(vectors).write.mode("overwrite").partitionBy("channel").parquet(folder)


def assembled(blocks: DataFrame) -> DataFrame:
    """Blocks (section_id, id, kind, score) in the order in which a section takes them: by kind, then the best first."""
    place = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(BLOCK_ORDER)), F.lit(len(BLOCK_ORDER)))
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("section_id").orderBy(place, F.desc("score"), "id")))


def natural_key(section_id: Column) -> Column:
    """Numbers of an id such as 3.10.2, so that 3.9 comes before 3.10; parts that are no numbers come last."""
    return F.transform(F.split(section_id, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(2**31 - 1)))


def compared(before: DataFrame, after: DataFrame, scores: list[str]) -> DataFrame:
    """(section_id, deltas, change) of two snapshots: added and removed sections, regressions and improvements of any score."""
    a = before.select("section_id", *(F.col(s).alias(f"a_{s}") for s in scores), F.lit(True).alias("in_a"))
    b = after.select("section_id", *(F.col(s).alias(f"b_{s}") for s in scores), F.lit(True).alias("in_b"))
    joined = a.join(b, "section_id", "full_outer")
    deltas = [F.round(F.col(f"b_{s}") - F.col(f"a_{s}"), 4) for s in scores]
    worse, better = (F.coalesce(x, F.lit(False)) for x in (F.array_min(F.array(*deltas)) <= -REGRESSION, F.array_max(F.array(*deltas)) >= REGRESSION))
    change = F.when(F.col("in_a").isNull(), F.lit("added")).when(F.col("in_b").isNull(), F.lit("removed")).when(worse, F.lit("regression")).when(better, F.lit("improvement")).otherwise(F.lit("same"))
    return joined.select("section_id", *(d.alias(f"delta_{s}") for d, s in zip(deltas, scores)), change.alias("change"))


def gate_messages(metrics: dict[str, tuple[Column, float]]) -> Column:
    """Messages of the metrics that are missing or below their least value."""
    return F.array_compact(F.array(*(F.when(v.isNull(), F.lit(f"{n} is missing")).when(v < least, F.concat(F.lit(f"{n} "), T.fixed(v, 4), F.lit(f" is below {least:.4f}"))) for n, (v, least) in metrics.items())))


def overlap_share(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes (left, top, right, bottom)."""
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    shared = side("left", "right") * side("top", "bottom")
    area = lambda x: (x["right"] - x["left"]) * (x["bottom"] - x["top"])
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def document_profile(text: Column) -> Column:
    """struct of line metrics and the profile that they suggest."""
    lines = F.split(text, "\n")
    count = lambda test: F.size(F.filter(lines, test))
    n, blank = F.size(lines), count(lambda x: F.trim(x) == "")
    headings, tables, numbers = count(lambda x: x.rlike(r"^#{1,6}\s")), count(lambda x: x.contains("|")), count(lambda x: x.rlike("[0-9]"))
    ratio = tables / F.greatest(n, F.lit(1))
    name = F.when(F.length(text) < 200, F.lit("thin")).when(ratio >= 0.5, F.lit("table_heavy")).when(headings >= 3, F.lit("structured")).otherwise(F.lit("plain"))
    return F.struct(n.alias("n_lines"), blank.alias("n_blank"), headings.alias("n_headings"), tables.alias("n_table_lines"), F.round(numbers / F.greatest(n, F.lit(1)), 4).alias("numeric_ratio"), F.length(text).alias("n_chars"), name.alias("profile"))


def audit_record(direction: str, rows: DataFrame) -> DataFrame:
    """(session_id, direction, entity_count, entity_types, success) for rows (session_id, entities array, error)."""
    return rows.select("session_id", F.lit(direction).alias("direction"), F.size("entities").alias("entity_count"), F.array_join(F.array_sort(F.array_distinct("entities")), ",").alias("entity_types"), F.col("error").isNull().alias("success"))


_E = "SELECT c_custkey AS sample_id, CASE c_custkey % 7 WHEN 0 THEN 'conversion_required' WHEN 1 THEN 'excluded' WHEN 2 THEN NULL ELSE 'main_indexed' END AS route, c_custkey % 3 AS n_images FROM {customer}"
_D = "SELECT o_custkey AS sample_id, o_orderkey AS document_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'queued' END AS parse_status FROM {orders} WHERE o_orderkey % 3 > 0"
_C = "SELECT l_orderkey AS document_id, l_returnflag = 'R' AS indexed FROM {lineitem}"
_A = "SELECT l_orderkey AS document_id, l_linestatus = 'F' AS fallback FROM {lineitem} WHERE l_linenumber <= 2 AND l_partkey % 3 = 0"
_MATERIAL = f"""e AS ({plain(_E)}), d AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY created_at DESC, document_id DESC) AS k FROM ({plain(_D)})), ch AS (SELECT document_id, count(*) AS n_chunks, count(*) FILTER (WHERE indexed) AS n_indexed FROM ({plain(_C)}) GROUP BY 1), a AS (SELECT document_id, count(*) AS n_assets, count(*) FILTER (WHERE fallback) AS n_fallback FROM ({plain(_A)}) GROUP BY 1),
    m AS (SELECT e.sample_id, route, n_images, d.document_id, parse_status, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_indexed, 0) AS n_indexed, coalesce(n_assets, 0) AS n_assets, coalesce(n_fallback, 0) AS n_fallback FROM e LEFT JOIN d ON e.sample_id = d.sample_id AND k = 1 LEFT JOIN ch USING (document_id) LEFT JOIN a USING (document_id))"""


def _materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return material_rows(*(shaped(spark, sf_dir, s) for s in (_E, _D, _C, _A)))


@query(
    f"""WITH {_MATERIAL} SELECT sample_id, route, document_id, parse_status, n_chunks, n_indexed, n_assets, n_fallback, array_to_string(list_filter([CASE WHEN document_id IS NULL AND NOT coalesce(route, '') IN ('conversion_required', 'excluded') AND route IS NOT NULL THEN 'not_ingested' END, CASE WHEN document_id IS NOT NULL AND parse_status <> 'done' THEN CASE WHEN parse_status = 'failed' THEN 'parse_failed' ELSE 'parse_status:' || parse_status END END,
    CASE WHEN n_images > 0 AND n_assets = 0 THEN 'expected_images_but_no_figure_assets' END, CASE WHEN n_assets > 0 AND n_assets = n_fallback THEN 'all_assets_are_storage_fallback' END, CASE WHEN route = 'conversion_required' THEN 'conversion_required' END], lambda x: x IS NOT NULL), ',') AS flags FROM m"""
)
def material_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Material rows with their latest document, counts and flags."""
    return _materials(spark, sf_dir).withColumn("flags", F.array_join("flags", ","))


@query(f"WITH {_MATERIAL}, r AS (SELECT coalesce(route, 'unknown') AS route, count(*) AS total, count(document_id) AS n_ingested, sum(n_assets)::BIGINT AS n_assets, sum(n_indexed)::BIGINT AS n_indexed FROM m GROUP BY 1) SELECT * FROM r UNION ALL SELECT '*', sum(total)::BIGINT, sum(n_ingested)::BIGINT, sum(n_assets)::BIGINT, sum(n_indexed)::BIGINT FROM r")
def material_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of materials by route and in all."""
    return material_summary(_materials(spark, sf_dir))


@query("SELECT 'brand' AS dimension, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'name', p_name, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'size', p_size::VARCHAR, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'cheap', (p_retailprice < 950)::VARCHAR, count(*) FROM part GROUP BY 2")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of five dimensions of a manifest."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), (F.col("p_retailprice") < 950).alias("cheap"))
    return value_counts(rows, ["brand", "type", "name", "size", "cheap"])


@query("WITH c AS (SELECT c_custkey, c_name, c_mktsegment, count(*) OVER () AS total FROM customer WHERE c_mktsegment = 'BUILDING') SELECT c_custkey, c_name, total FROM c ORDER BY c_custkey DESC LIMIT 20 OFFSET 5")
def project_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of an industry's projects, the newest first, with the number of all."""
    rows = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(F.desc("c_custkey")).offset(5).limit(20).select("c_custkey", "c_name").crossJoin(F.broadcast(total))


@query("SELECT sample_id, CASE WHEN source IS DISTINCT FROM 'uploaded' THEN 'baseline' ELSE 'uploaded' END AS origin, route IN ('main_indexed', 'pilot') AS ready FROM (SELECT c_custkey AS sample_id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'uploaded' ELSE 'sample' END AS source, CASE c_custkey % 3 WHEN 0 THEN 'pilot' ELSE 'excluded' END AS route FROM customer)")
def library_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the baseline (a missing source counts as one) or uploaded, and whether they may enter the library."""
    rows = shaped(spark, sf_dir, "SELECT c_custkey AS sample_id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'uploaded' ELSE 'sample' END AS source, CASE c_custkey % 3 WHEN 0 THEN 'pilot' ELSE 'excluded' END AS route FROM {customer}")
    origin = F.when(F.col("source").eqNullSafe(F.lit("uploaded")), F.lit("uploaded")).otherwise(F.lit("baseline"))
    return rows.select("sample_id", origin.alias("origin"), F.col("route").isin(*READY).alias("ready"))


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def point_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that are left after a delete by ids."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return without_points(points, table(spark, sf_dir, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("id")))


@query(
    """WITH p AS (SELECT vec_id AS id, MAP {'label': label::VARCHAR, 'kind': 'v'} AS a FROM embeddings), n AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0) SELECT p.id, CASE WHEN n.id IS NULL THEN 'kind=v' ELSE 'kind=patched' END AS kind, 'label=' || a['label'] AS label, CASE WHEN n.id IS NULL THEN NULL ELSE 'name=' || name END AS name FROM p LEFT JOIN n USING (id)"""
)
def payload_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with the keys of a patch put over their own."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("kind"), F.lit("v")).alias("payload"))
    patches = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.create_map(F.lit("kind"), F.lit("patched"), F.lit("name"), F.col("s_name")).alias("payload"))
    entry = lambda k: F.when(F.map_contains_key("payload", k), F.concat(F.lit(f"{k}="), F.col("payload")[k])).alias(k)
    return patched(points, patches).select("id", entry("kind"), entry("label"), entry("name"))


_BLOCKS = "SELECT l_orderkey AS section_id, l_linenumber AS id, CASE l_partkey % 7 WHEN 0 THEN 'opening' WHEN 1 THEN 'overview' WHEN 2 THEN 'detail' WHEN 3 THEN 'table' WHEN 4 THEN 'figure' ELSE 'other' END AS kind, l_discount AS score FROM {lineitem}"


@query(f"SELECT section_id, id, kind, row_number() OVER (PARTITION BY section_id ORDER BY coalesce(list_position(['opening', 'overview', 'detail', 'table', 'figure'], kind), 6), score DESC, id)::INT AS place FROM ({plain(_BLOCKS)})")
def block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a section takes its blocks."""
    return assembled(shaped(spark, sf_dir, _BLOCKS)).select("section_id", "id", "kind", "place")


@query(
    """WITH a AS (SELECT o_orderkey::VARCHAR AS section_id, o_totalprice / 1e6 AS s, (o_custkey % 100) / 128.0 AS t FROM orders WHERE o_orderkey % 5 > 0), b AS (SELECT o_orderkey::VARCHAR AS section_id, (o_totalprice + (o_orderkey % 31 - 15) * 8000) / 1e6 AS s, (o_custkey % 100) / 128.0 AS t FROM orders WHERE o_orderkey % 7 > 0),
    j AS (SELECT coalesce(a.section_id, b.section_id) AS section_id, a.section_id IS NULL AS na, b.section_id IS NULL AS nb, round(b.s - a.s, 4) AS ds, round(b.t - a.t, 4) AS dt FROM a FULL JOIN b USING (section_id))
    SELECT section_id, ds AS delta_s, dt AS delta_t, CASE WHEN na THEN 'added' WHEN nb THEN 'removed' WHEN least(ds, dt) <= -0.05 THEN 'regression' WHEN greatest(ds, dt) >= 0.05 THEN 'improvement' ELSE 'same' END AS change FROM j"""
)
def snapshot_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of two snapshots with the changes of their scores."""
    orders = table(spark, sf_dir, "orders")
    rows = lambda keep, price: orders.filter(keep).select(F.col("o_orderkey").cast("string").alias("section_id"), (price / 1e6).alias("s"), ((F.col("o_custkey") % 100) / 128.0).alias("t"))
    return compared(rows("o_orderkey % 5 > 0", F.col("o_totalprice")), rows("o_orderkey % 7 > 0", F.col("o_totalprice") + (F.col("o_orderkey") % 31 - 15) * 8000), ["s", "t"])


@query(
    """WITH m AS (SELECT c_nationkey, avg(c_acctbal) / 10000 AS a, avg(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END) / 10000 AS b FROM customer GROUP BY 1) SELECT c_nationkey, array_to_string(list_filter([CASE WHEN a IS NULL THEN 'final is missing' WHEN a < 0.45 THEN 'final ' || printf('%.4f', a) || ' is below 0.4500' END, CASE WHEN b IS NULL THEN 'semantic is missing' WHEN b < 0.45 THEN 'semantic ' || printf('%.4f', b) || ' is below 0.4500' END], lambda x: x IS NOT NULL), '; ') AS failures FROM m"""
)
def snapshot_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each snapshot fails, as messages."""
    m = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") / 10000).alias("a"), (F.avg(F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal"))) / 10000).alias("b"))
    return m.select("c_nationkey", F.array_join(gate_messages({"final": (F.col("a"), 0.45), "semantic": (F.col("b"), 0.45)}), "; ").alias("failures"))


@query(
    r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents), c AS (SELECT doc_id, text, len(x) AS n, len(list_filter(x, lambda y: trim(y, ' ') = '')) AS blank, len(list_filter(x, lambda y: regexp_matches(y, '^#{1,6}\s'))) AS heads, len(list_filter(x, lambda y: contains(y, '|'))) AS tabs, len(list_filter(x, lambda y: regexp_matches(y, '[0-9]'))) AS nums FROM l)
    SELECT doc_id, n::INT AS n_lines, blank::INT AS n_blank, heads::INT AS n_headings, tabs::INT AS n_table_lines, round(nums / greatest(n, 1), 4) AS numeric_ratio, length(text)::INT AS n_chars, CASE WHEN length(text) < 200 THEN 'thin' WHEN tabs / greatest(n, 1) >= 0.5 THEN 'table_heavy' WHEN heads >= 3 THEN 'structured' ELSE 'plain' END AS profile FROM c"""
)
def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line metrics of each document and the profile that they suggest."""
    return table(spark, sf_dir, "documents").select("doc_id", document_profile(F.col("text")).alias("p")).select("doc_id", "p.*")


_BOXES = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 10 AS DOUBLE) AS b, CAST(p_size + 8 AS DOUBLE) AS c, CAST(p_partkey % 10 + 6 AS DOUBLE) AS d FROM {part}"


@query(f"WITH x AS (SELECT *, greatest(0, least(c, 30) - greatest(a, 20)) * greatest(0, least(d, 9) - greatest(b, 3)) AS s FROM ({plain(_BOXES)})) SELECT id, round(s / ((c - a) * (d - b) + 60 - s), 6) AS share FROM x")
def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap of regions with one region."""
    box = dict(zip(("left", "top", "right", "bottom"), map(F.col, "abcd")))
    one = dict(zip(("left", "top", "right", "bottom"), map(F.lit, (20.0, 3.0, 30.0, 9.0))))
    return shaped(spark, sf_dir, _BOXES).select("id", F.round(overlap_share(box, one), 6).alias("share"))


@query("WITH c AS (SELECT l_orderkey, p.p_name, p.p_brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE s_nationkey = 3 AND p_brand IN (SELECT 'Brand#' || n_nationkey FROM nation WHERE n_regionkey = 1)) SELECT l_orderkey, count(*) AS n, min(p_name) AS name FROM c GROUP BY 1")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks joined with their documents and projects, within a set of names."""
    names = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("p_brand"))
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").join(names, "p_brand", "left_semi")
    own = table(spark, sf_dir, "supplier").filter("s_nationkey = 3")
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(own, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("p_name").alias("name"))


@query("SELECT c_nationkey, count(*) AS n_sections, count(*) FILTER (WHERE c_acctbal < 0) AS n_failed, round(count(*) FILTER (WHERE c_mktsegment = 'BUILDING') / count(*), 6) AS fallback_rate, sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 0 END)::BIGINT AS prior_hits FROM customer GROUP BY 1")
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each job: how many, how many failed, the rate of fallbacks, and hits of priors."""
    n = F.count("*")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(n.alias("n_sections"), F.count_if(F.col("c_acctbal") < 0).alias("n_failed"), F.round(F.count_if(F.col("c_mktsegment") == "BUILDING") / n, 6).alias("fallback_rate"), F.sum(F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(2)).otherwise(F.lit(0)).cast("long")).alias("prior_hits"))


@query("SELECT event_type AS queue, CASE WHEN value > 20 THEN 'running' ELSE 'queued' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued and running tasks of each queue."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("queue"), F.when(F.col("value") > 20, F.lit("running")).otherwise(F.lit("queued")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS session_id, 'mask' AS direction, len(list(event_type))::INT AS entity_count, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS entity_types, max(value) <= 90 AS success FROM events GROUP BY 1")
def masking_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each masking session."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.collect_list("event_type").alias("entities"), F.when(F.max("value") > 90, F.lit("too large")).alias("error"))
    return audit_record("mask", rows)
