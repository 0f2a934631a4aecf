"""Evaluation: ranking quality, project snapshots, gates, durations and state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import plain, query, shaped, table
from . import ranking

#: Metric, least value, and from how many cases on a gate is judged at all.
GATES = [("top1", 0.5, 5), ("top3", 0.8, 5), ("mean_first_rank", 0.0, 100_000)]


def judged_ranking(ranked: DataFrame, matches: Column) -> DataFrame:
    """(query_id, top1, top3, first_rank) of ranked rows (query_id, rank, ...)."""
    first = F.min(F.when(matches, F.col("rank")))
    return ranked.groupBy("query_id").agg(F.coalesce(first == 1, F.lit(False)).alias("top1"), F.coalesce(first <= 3, F.lit(False)).alias("top3"), first.alias("first_rank"))


_RANKED = """p AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT q.id AS query_id, p.id, q.label = p.label AS same, list_cosine_similarity(q.v, p.v) AS score FROM p q, p WHERE q.id % 50 = 0 AND p.id <> q.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
    j AS (SELECT query_id, coalesce(min(rank) FILTER (WHERE same AND rank <= 10) = 1, false) AS top1, coalesce(min(rank) FILTER (WHERE same AND rank <= 10) <= 3, false) AS top3, min(rank) FILTER (WHERE same AND rank <= 10)::INT AS first_rank FROM r GROUP BY 1)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, queries = ranking._points(spark, sf_dir)
    found = ranking.dense_top_k(points, queries, 11).filter("id <> query_id")
    ranks = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("rank <= 10")
    label = points.select("id", "label")
    joined = ranks.join(label, "id").join(label.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return judged_ranking(joined, F.col("label") == F.col("wanted"))


@query(f"WITH {_RANKED} SELECT * FROM j")
def ranking_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first, or one of the first three, of each query's neighbours has its label, and the first rank that has."""
    return _judged(spark, sf_dir)


@query(
    f"""WITH {_RANKED}, m AS (SELECT avg(top1::INT) AS top1, avg(top3::INT) AS top3, avg(first_rank) AS mean_first_rank, count(*) AS n FROM j), g AS (SELECT 'top1' AS metric, top1 AS value, 0.5 AS least, 5 AS cases, n FROM m UNION ALL SELECT 'top3', top3, 0.8, 5, n FROM m UNION ALL SELECT 'mean_first_rank', mean_first_rank, 0.0, 100000, n FROM m)
    SELECT metric, round(value, 6) AS value, CASE WHEN n < cases THEN 'skipped' WHEN value >= least THEN 'passed' ELSE 'failed' END AS status FROM g"""
)
def evaluation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric of the ranking evaluation against its gate."""
    judged = _judged(spark, sf_dir)
    metrics = judged.agg(F.avg(F.col("top1").cast("int")).alias("top1"), F.avg(F.col("top3").cast("int")).alias("top3"), F.avg("first_rank").alias("mean_first_rank"), F.count("*").alias("n"))
    gates = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(least).alias("least"), F.lit(cases).alias("cases")) for m, least, cases in GATES))
    status = F.when(F.col("n") < F.col("cases"), F.lit("skipped")).when(F.col("value") >= F.col("least"), F.lit("passed")).otherwise(F.lit("failed"))
    return metrics.select("n", F.inline(gates)).select("metric", F.round("value", 6).alias("value"), status.alias("status"))


@query(
    """SELECT c_nationkey, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high,
    CASE WHEN bool_and(o_totalprice > 1000) AND count(*) FILTER (WHERE o_orderstatus = 'P') = 0 THEN 'healthy' WHEN count(*) FILTER (WHERE o_orderstatus = 'P') * 10 > count(*) THEN 'bad' ELSE 'degraded' END AS health FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"""
)
def project_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status, scores and a health flag."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    price, bad = F.col("o_totalprice"), F.count_if(F.col("o_orderstatus") == "P")
    health = F.when(F.bool_and(price > 1000) & (bad == 0), F.lit("healthy")).when(bad * 10 > F.count("*"), F.lit("bad")).otherwise(F.lit("degraded"))
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.round(F.avg(price), 4).alias("mean"), F.min(price).alias("low"), F.max(price).alias("high"), health.alias("health"))


@query("SELECT user_id, round(greatest(0, epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS latest FROM events GROUP BY 1")
def session_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between first and last event, and the last as text."""
    span = F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.greatest(F.lit(0), span) / 1e6, 3).alias("seconds"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("latest"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN c_custkey IS NULL THEN 'failed' WHEN o_totalprice > 300000 THEN 'migrated' ELSE 'queued' END AS state,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS place FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0"""
)
def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of unfinished jobs: queued again, moved to another queue, or failed where their document is gone."""
    alive = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    joined = table(spark, sf_dir, "orders").join(alive, F.col("o_custkey") == F.col("c_custkey"), "left")
    state = F.when(F.col("o_orderstatus") == "F", F.lit("done")).when(F.col("c_custkey").isNull(), F.lit("failed")).when(F.col("o_totalprice") > 300000, F.lit("migrated")).otherwise(F.lit("queued"))
    return joined.select("o_orderkey", state.alias("state"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("place"))


@query(
    """WITH r AS (SELECT p_brand, p_partkey, p_size >= 45 AS preferred, row_number() OVER (PARTITION BY p_brand, p_size >= 45 ORDER BY p_retailprice DESC, p_partkey) AS n, count(*) FILTER (WHERE p_size >= 45) OVER (PARTITION BY p_brand) AS n_preferred FROM part)
    SELECT p_brand, p_partkey, preferred, (CASE WHEN preferred THEN n ELSE n + n_preferred END)::INT AS place FROM r WHERE CASE WHEN preferred THEN n ELSE n + n_preferred END <= 8"""
)
def preferred_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight cards of each group: preferred ones, and others only where those are too few."""
    preferred = F.col("p_size") >= 45
    own, group = Window.partitionBy("p_brand", "preferred").orderBy(F.desc("p_retailprice"), "p_partkey"), Window.partitionBy("p_brand")
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", preferred.alias("preferred"))
    ranked = rows.select("p_brand", "p_partkey", "preferred", F.row_number().over(own).alias("n"), F.count_if("preferred").over(group).alias("many"))
    place = F.when(F.col("preferred"), F.col("n")).otherwise(F.col("n") + F.col("many")).cast("int")
    return ranked.select("p_brand", "p_partkey", "preferred", place.alias("place")).filter("place <= 8")


#: Section types that are no test of a search; those that are less of one; what a leaf, a type, an equipment, text and depth are worth.
SKIPPED, BROAD_TYPES, NO_EQUIPMENT = ("unknown", "company_profile"), ("overall_solution", "project_overview"), ("generic", "unknown", "")
LEAF, TYPED, EQUIPPED, TEXT_CHARS, PER_LEVEL, LEVELS_MOST, LEAST_TEXT = 2.0, 1.5, 1.0, 180.0, 0.15, 0.45, 8


def holdout_sections(sections: DataFrame, limit: int = 8) -> DataFrame:
    """(document_id, section_id, points, place): sections of each document that test a search, of as many types as there are.

    sections: (document_id, section_id, path, title, section_type, equipment_type, level, is_leaf, text). In order of points the first of each
    type is taken, then a second of each, then any, no path twice: three passes over one sorted list of a document's sections,
    as a fold that carries what it has taken. A path that is empty is the title; what has neither, or little text, is left out.
    """
    c = F.col
    blank = lambda name, default: F.lower(F.trim(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(default))))
    rows = sections.withColumns({"text": F.trim(F.coalesce("text", F.lit(""))), "title": F.trim(F.coalesce("title", F.lit(""))), "section_type": blank("section_type", "unknown"), "equipment_type": blank("equipment_type", "generic"), "level": F.coalesce("level", F.lit(0))})
    rows = rows.withColumn("path", F.coalesce(F.nullif(F.trim("path"), F.lit("")), c("title"))).filter((c("title") != "") & ~c("section_type").isin(*SKIPPED) & (F.length("text") >= LEAST_TEXT))
    some = lambda test, points: F.when(test, F.lit(points)).otherwise(F.lit(0.0))
    points = some(F.coalesce("is_leaf", F.lit(False)), LEAF) + some(~c("section_type").isin(*BROAD_TYPES), TYPED) + some(~c("equipment_type").isin(*NO_EQUIPMENT), EQUIPPED) + F.least(F.length("text") / TEXT_CHARS, F.lit(1.0)) + F.least(c("level") * PER_LEVEL, F.lit(LEVELS_MOST))
    item = F.struct((-points).alias("down"), (-c("level")).alias("shallow"), (-F.length("text")).alias("short"), c("path"), c("section_type").alias("kind"), c("section_id"))
    # paths fall where all else ties, so they are turned round: the list is sorted by the first three and then each tie by path
    listed = rows.groupBy("document_id").agg(F.collect_list(item).alias("all"))  # one document's sections
    before = lambda a, b: F.when(F.struct(a["down"], a["shallow"], a["short"]) < F.struct(b["down"], b["shallow"], b["short"]), F.lit(-1)).when(F.struct(a["down"], a["shallow"], a["short"]) > F.struct(b["down"], b["shallow"], b["short"]), F.lit(1)).when(a["path"] > b["path"], F.lit(-1)).when(a["path"] < b["path"], F.lit(1)).when(a["section_id"] < b["section_id"], F.lit(-1)).otherwise(F.lit(1))
    ranked = F.array_sort("all", before)
    tries = F.flatten(F.transform(F.array(*map(F.lit, (1, 2, limit))), lambda most: F.transform("ranked", lambda x: F.struct(most.alias("most"), x.alias("x")))))
    taken = lambda s, t: (F.size(s) < limit) & ~F.exists(s, lambda y: y["path"] == t["x"]["path"]) & (F.size(F.filter(s, lambda y: y["kind"] == t["x"]["kind"])) < t["most"])
    chosen = F.aggregate(tries, F.slice("ranked", 1, 0), lambda s, t: F.when(taken(s, t), F.concat(s, F.array(t["x"]))).otherwise(s))
    found = listed.withColumn("ranked", ranked).select("document_id", F.posexplode(chosen).alias("n", "x"))
    return found.select("document_id", "x.section_id", F.round(-c("x.down"), 6).alias("points"), (c("n") + 1).alias("place"))


_HELD = """SELECT CAST(floor(doc_id / 25) AS BIGINT) AS document_id, doc_id AS section_id, CASE doc_id % 7 WHEN 0 THEN 'A > ' || lang WHEN 1 THEN '' ELSE 'p' || CAST(doc_id % 40 AS STRING) END AS path, CASE doc_id % 9 WHEN 0 THEN '' ELSE source END AS title, CASE doc_id % 5 WHEN 0 THEN 'overall_solution' WHEN 1 THEN 'Unknown' WHEN 2 THEN lang ELSE source END AS section_type,
    CASE doc_id % 3 WHEN 0 THEN 'generic' ELSE 'lci' END AS equipment_type, CAST(doc_id % 5 AS INT) AS level, doc_id % 2 = 0 AS is_leaf, substr(text, 1, 40 * CAST(doc_id % 7 AS INT)) AS text FROM {documents}"""


@query(
    f"""WITH RECURSIVE r AS (SELECT document_id, section_id, trim(text, ' ') AS text, title, lower(section_type) AS kind, level, CASE WHEN path = '' THEN title ELSE path END AS path, round((CASE WHEN is_leaf THEN 2.0 ELSE 0 END::DOUBLE + CASE WHEN lower(section_type) NOT IN ('overall_solution', 'project_overview') THEN 1.5 ELSE 0 END::DOUBLE + CASE WHEN equipment_type <> 'generic' THEN 1.0 ELSE 0 END::DOUBLE + least(length(trim(text, ' ')) / 180.0::DOUBLE, 1.0::DOUBLE) + least(level * 0.15::DOUBLE, 0.45::DOUBLE)), 9) AS points
      FROM ({plain(_HELD)}) WHERE title <> '' AND lower(section_type) NOT IN ('unknown', 'company_profile') AND length(trim(text, ' ')) >= 8),
    o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY points DESC, level DESC, length(text) DESC, path DESC, section_id) AS k, count(*) OVER (PARTITION BY document_id) AS n FROM r), t AS (SELECT document_id, section_id, kind, path, points, most, (pass - 1) * n + k AS step FROM o, (VALUES (1, 1), (2, 2), (3, 8)) p(pass, most)),
    w AS (SELECT DISTINCT document_id, 0::BIGINT AS step, []::VARCHAR[] AS paths, []::VARCHAR[] AS kinds, 0::BIGINT AS section_id, 0::DOUBLE AS points, FALSE AS taken FROM t
      UNION ALL SELECT document_id, step, CASE WHEN ok THEN list_append(paths, path) ELSE paths END, CASE WHEN ok THEN list_append(kinds, kind) ELSE kinds END, section_id, points, ok FROM (SELECT w.document_id, t.step, w.paths, w.kinds, t.path, t.kind, t.section_id, t.points, len(w.paths) < 8 AND NOT list_contains(w.paths, t.path) AND len(list_filter(w.kinds, lambda x: x = t.kind)) < t.most AS ok FROM w JOIN t ON t.document_id = w.document_id AND t.step = w.step + 1))
    SELECT document_id, section_id, round(points, 6) AS points, len(paths)::INT AS place FROM w WHERE taken"""
)
def holdout_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each document on which a search is tested, of as many types as there are."""
    return holdout_sections(shaped(spark, sf_dir, _HELD))
