"""Joins: outer merges, comparisons, hierarchy and neighbour joins, latest versions, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table


def merged_hits(dense: DataFrame, sparse: DataFrame, key: str) -> DataFrame:
    """Full outer merge of two hit lists; shared columns come from the first that has the row."""
    a = dense.select(*(F.col(c).alias(f"a_{c}") for c in dense.columns), F.lit(True).alias("in_a"))
    b = sparse.select(*(F.col(c).alias(f"b_{c}") for c in sparse.columns), F.lit(True).alias("in_b"))
    joined = a.join(b, F.col(f"a_{key}") == F.col(f"b_{key}"), "full_outer")
    common = [F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in dense.columns if c in sparse.columns]
    return joined.select(*common, F.coalesce("in_a", F.lit(False)).alias("dense_hit"), F.coalesce("in_b", F.lit(False)).alias("sparse_hit"))


def ancestors(path: Column) -> Column:
    """All strict prefixes of a path array."""
    return F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda n: F.slice(path, 1, n))).otherwise(F.array().cast("array<array<string>>"))


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, path) pairs of nested paths, as an equi-join on exploded ancestor paths rather than a comparison of all pairs."""
    above = paths.select(F.col("path"), F.explode(ancestors(F.col("path"))).alias("ancestor"))
    return above.join(paths.select(F.col("path").alias("ancestor")).distinct(), "ancestor", "left_semi")


def diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, changed): added, removed or changed rows and the names of the fields that differ; nulls equal nulls."""
    a = before.select(F.col(key).alias("a_key"), *(F.col(f).alias(f"a_{f}") for f in fields))
    b = after.select(F.col(key).alias("b_key"), *(F.col(f).alias(f"b_{f}") for f in fields))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields)))
    kind = F.when(F.col("a_key").isNull(), F.lit("added")).when(F.col("b_key").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    joined = a.join(b, F.col("a_key") == F.col("b_key"), "full_outer").select(F.coalesce("a_key", "b_key").alias(key), kind.alias("change"), changed.alias("fields"))
    return joined.filter((F.col("change") != "changed") | (F.size("fields") > 0)).select(key, "change", F.when(F.col("change") == "changed", F.concat_ws(",", "fields")).otherwise(F.lit("")).alias("changed"))


def upserted(current: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Current rows replaced by the latest new row of their key, and rows of new keys."""
    latest = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    return current.join(latest.select(key), key, "left_anti").unionByName(latest.select(*current.columns))


def neighbours(rows: DataFrame, seeds: DataFrame, group: str, place: str, width: int) -> DataFrame:
    """Rows within ``width`` places of a seed of their group, seeds left out, with the distance to the nearest."""
    reach = seeds.select(F.col(group).alias("_g"), F.col(place).alias("_seed"), F.explode(F.sequence(F.col(place) - width, F.col(place) + width)).alias("_at"))
    near = rows.join(reach, (F.col(group) == F.col("_g")) & (F.col(place) == F.col("_at")))
    nearest = near.groupBy(group, place).agg(F.min(F.abs(F.col(place) - F.col("_seed"))).alias("distance"))
    return nearest.filter("distance > 0")


@query(
    """SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.score, b.score) AS score, a.o_custkey IS NOT NULL AS dense_hit, b.o_custkey IS NOT NULL AS sparse_hit
    FROM (SELECT o_custkey, max(o_totalprice) AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey, min(o_totalprice) AS score FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.o_custkey = b.o_custkey"""
)
def outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hit lists merged: the first wins, and flags say which lists hold a row."""
    orders = table(spark, sf_dir, "orders")
    hits = lambda status, best: orders.filter(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(best("o_totalprice").alias("score"))
    return merged_hits(hits("F", F.max), hits("O", F.min), "o_custkey")


_PATHS = """p AS (SELECT [r_name] AS path FROM region UNION ALL SELECT [r_name, n_name] FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT [r_name, n_name, c_mktsegment] FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""WITH {_PATHS} SELECT array_to_string(a.path, ' > ') AS ancestor, count(*) AS n_descendants FROM p a JOIN p b ON len(b.path) > len(a.path) AND list_slice(b.path, 1, len(a.path)) = a.path GROUP BY 1""")
def hierarchy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sections lie below each section of a hierarchy."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    segments = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct().join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    paths = region.select(F.array("r_name").alias("path")).union(places.select(F.array("r_name", "n_name"))).union(segments.select(F.array("r_name", "n_name", "c_mktsegment")))
    return descendants(paths).groupBy(F.concat_ws(" > ", "ancestor").alias("ancestor")).agg(F.count("*").alias("n_descendants"))


@query(
    """SELECT l.l_orderkey, l.l_linenumber, min(abs(l.l_linenumber - s.l_linenumber))::INT AS distance FROM lineitem l JOIN lineitem s ON l.l_orderkey = s.l_orderkey AND abs(l.l_linenumber - s.l_linenumber) <= 2
    WHERE s.l_returnflag = 'R' GROUP BY 1, 2 HAVING min(abs(l.l_linenumber - s.l_linenumber)) > 0"""
)
def neighbour_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within two places of a returned line of their order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return neighbours(lines.select("l_orderkey", "l_linenumber"), lines.filter("l_returnflag = 'R'"), "l_orderkey", "l_linenumber", 2)


@query(
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderpriority) AS p, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderpriority) AS p, max(o_orderstatus) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' GROUP BY 1),
    j AS (SELECT coalesce(a.k, b.k) AS item_id, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change,
    array_to_string(list_filter([CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END, CASE WHEN a.p IS DISTINCT FROM b.p THEN 'p' END, CASE WHEN a.s IS DISTINCT FROM b.s THEN 's' END], lambda x: x IS NOT NULL), ',') AS f FROM a FULL JOIN b ON a.k = b.k)
    SELECT item_id, change, CASE WHEN change = 'changed' THEN f ELSE '' END AS changed FROM j WHERE change <> 'changed' OR f <> ''"""
)
def layer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was added, removed or changed between two layers of items."""
    orders = table(spark, sf_dir, "orders")
    layer = lambda rows: rows.groupBy(F.col("o_custkey").alias("item_id")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("p"), F.max("o_orderstatus").alias("s"))
    return diff(layer(orders.filter("o_orderdate < timestamp '1996-01-01'")), layer(orders.filter("o_orderdate >= timestamp '1995-06-01'")), "item_id", ["n", "p", "s"])


@query(
    """SELECT c_custkey, o_orderkey AS latest_order, n_versions + 1 AS next_version FROM customer JOIN (SELECT o_custkey, count(*) AS n_versions, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey
    UNION ALL SELECT c_custkey, NULL, 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def latest_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest artifact of each project and its next version number."""
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_order"))
    joined = table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "latest_order", (F.coalesce("n", F.lit(0)) + 1).alias("next_version"))


@query(
    """WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase'), o AS (SELECT user_id, min(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT user_id, value FROM n WHERE r = 1 UNION ALL SELECT user_id, value FROM o WHERE user_id NOT IN (SELECT user_id FROM n)"""
)
def point_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of points after new ones came in: the latest of each key wins."""
    events = table(spark, sf_dir, "events")
    current = events.filter("event_type = 'view'").groupBy("user_id").agg(F.min("value").alias("value"))
    return upserted(current, events.filter("event_type = 'purchase'").withColumn("_order", F.struct("ts", "event_id")), "user_id", "_order")


@query(
    """SELECT user_id, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta, a.n IS NULL OR coalesce(b.n, 0) > a.n AS improved FROM (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1) b USING (user_id)"""
)
def snapshot_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between two snapshots, also for keys that one of them lacks."""
    events = table(spark, sf_dir, "events")
    count = lambda condition, name: events.filter(condition).groupBy("user_id").agg(F.count("*").alias(name))
    both = count("ts < timestamp '2024-01-15'", "a").join(count("ts >= timestamp '2024-01-15'", "b"), "user_id", "full_outer")
    return both.select("user_id", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta"), (F.col("a").isNull() | (F.coalesce("b", F.lit(0)) > F.col("a"))).alias("improved"))
