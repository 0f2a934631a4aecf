"""Set operations: ordered distinct, content hashes, dedupe by precedence, merges and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..registry import plain, query, shaped, table


def distinct_in_order(values: Column) -> Column:
    """First occurrences, with case and outer spaces ignored."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(F.trim(v))), lambda v: v != ""))


def best_in_first_place(rows: DataFrame, keys: list[str], score: str, place: str) -> DataFrame:
    """One row for each key: the values of the best score, in the place where the key came first."""
    others = [c for c in rows.columns if c not in {*keys, place}]
    best = F.max_by(F.struct(*others), F.struct(F.col(score), -F.col(place))).alias("_best")
    return rows.groupBy(*keys).agg(best, F.min(place).alias(place)).select(*keys, "_best.*", place)


@query(
    """SELECT sha256(text) AS content_sha256, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1"""
)
def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each content, the one of the least id, and how many there are."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return hashed.groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(
    """SELECT p_brand, p_size, arg_max(p_name, (p_retailprice, -p_partkey)) AS p_name, max(p_retailprice) AS p_retailprice, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2"""
)
def block_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of one key: the best score stays, in the first one's place."""
    return best_in_first_place(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_name", "p_retailprice", "p_partkey"), ["p_brand", "p_size"], "p_retailprice", "p_partkey")


@query(
    """WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: lower(trim(x, ' '))), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, len(list_distinct(w))::BIGINT AS n_distinct, w[1] AS first_word FROM w"""
)
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words in the order in which they come first."""
    words = distinct_in_order(F.split("text", " "))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_distinct"), F.get("w", F.lit(0)).alias("first_word"))


@query(
    """WITH c AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS a FROM customer GROUP BY 1), s AS (SELECT s_nationkey, list_sort(list(DISTINCT CASE WHEN s_acctbal > 5000 THEN 'BUILDING' WHEN s_acctbal > 0 THEN 'MACHINERY' ELSE 'other' END)) AS b FROM supplier GROUP BY 1)
    SELECT c_nationkey, list_sort(list_distinct(list_concat(a, coalesce(b, [])))) AS merged, round(CASE WHEN len(list_distinct(list_concat(a, coalesce(b, [])))) > 0 THEN len(list_intersect(a, coalesce(b, []))) / len(list_distinct(list_concat(a, coalesce(b, [])))) ELSE 0 END, 6) AS jaccard FROM c LEFT JOIN s ON c_nationkey = s_nationkey"""
)
def item_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two items' value sets united, and how much they overlap."""
    a = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("a"))
    kind = F.when(F.col("s_acctbal") > 5000, F.lit("BUILDING")).when(F.col("s_acctbal") > 0, F.lit("MACHINERY")).otherwise(F.lit("other"))
    b = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_set(kind).alias("b"))
    joined = a.join(b, F.col("c_nationkey") == F.col("s_nationkey"), "left").withColumn("b", F.coalesce("b", F.array().cast("array<string>")))
    return joined.select("c_nationkey", F.sort_array(F.array_union("a", "b")).alias("merged"), F.round(S.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(
    """SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderkey) AS n FROM orders) WHERE n = 1"""
)
def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one key: uploaded ones come before baseline ones, then the first."""
    rank = F.struct((F.col("o_orderstatus") != "O").alias("baseline"), "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min_by("o_orderkey", rank).alias("o_orderkey"))


#: Fixed value: the flag of an item into which others were merged.
MERGED = "human_merged"
SETS = ("aliases", "documents", "evidence")


def merged_items(items: DataFrame, merges: DataFrame) -> DataFrame:
    """The items (item_id, item_type, aliases, documents, evidence, flags) with what was merged into them, and ``merged_into`` of those that went into another.

    merges: (target_id, source_id, place). The sets of a target come first, then those of its sources by place, each value once.
    Only other items of the same type are merged; other rows of merges change nothing, nor do sources that are not there.
    """
    c = F.col
    none = F.array().cast("array<string>")
    rows = items.withColumns({n: F.coalesce(n, none) for n in (*SETS, "flags")})
    target, source = rows.select(c("item_id").alias("target_id"), c("item_type").alias("_type")), rows.select(c("item_id").alias("source_id"), c("item_type").alias("_own"), *SETS)
    valid = merges.join(target, "target_id").join(source, "source_id").filter((c("target_id") != c("source_id")) & (c("_type") == c("_own")))
    gained = valid.groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("place", "source_id", *SETS))).alias("_g"))  # what an editor merged by hand
    gone = valid.groupBy(c("source_id").alias("item_id")).agg(F.min("target_id").alias("merged_into"))
    joined = rows.join(gained.withColumnRenamed("target_id", "item_id"), "item_id", "left").join(gone, "item_id", "left")
    union = {n: F.array_distinct(F.concat(c(n), F.coalesce(F.flatten(c(f"_g.{n}")), none))) for n in SETS}
    return joined.withColumns(union | {"flags": F.when(c("_g").isNotNull(), F.array_distinct(F.concat("flags", F.array(F.lit(MERGED))))).otherwise(c("flags"))}).drop("_g")


_WIKI = "SELECT p_partkey AS item_id, 't' || CAST(p_size % 3 AS STRING) AS item_type, p_type || ',' || p_brand AS aliases, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'd' || CAST(p_size AS STRING) || ',d' || CAST(p_size % 7 AS STRING) END AS documents, 'e' || CAST(p_partkey % 11 AS STRING) AS evidence, CASE p_partkey % 4 WHEN 0 THEN 'human_merged' ELSE 'x' END AS flags FROM {part}"
_MERGES = "SELECT CAST(floor(l_partkey / 4) * 4 AS BIGINT) AS target_id, l_partkey AS source_id, min(l_orderkey) AS place FROM {lineitem} WHERE l_quantity > 30 GROUP BY l_partkey"


@query(
    f"""WITH i AS (SELECT item_id, item_type, {', '.join(f"coalesce(string_split({n}, ','), []) AS {n}" for n in (*SETS, 'flags'))} FROM ({plain(_WIKI)})), v AS (SELECT m.target_id, m.source_id, m.place, s.aliases, s.documents, s.evidence FROM ({plain(_MERGES)}) m JOIN i t ON t.item_id = m.target_id JOIN i s ON s.item_id = m.source_id WHERE m.target_id <> m.source_id AND s.item_type = t.item_type),
    g AS (SELECT target_id AS item_id, {', '.join(f"flatten(list({n} ORDER BY place, source_id)) AS g_{n}" for n in SETS)} FROM v GROUP BY 1), j AS (SELECT i.*, {', '.join(f"{n} || coalesce(g_{n}, []) AS all_{n}" for n in SETS)}, g.item_id IS NOT NULL AS hit, (SELECT min(target_id) FROM v WHERE v.source_id = i.item_id) AS merged_into FROM i LEFT JOIN g USING (item_id))
    SELECT item_id, {', '.join(f"array_to_string(list_filter(all_{n}, lambda x, k: NOT list_contains(list_slice(all_{n}, 1, k - 1), x)), ',') AS {n}" for n in SETS)}, array_to_string(CASE WHEN hit AND NOT list_contains(flags, 'human_merged') THEN list_append(flags, 'human_merged') ELSE flags END, ',') AS flags, merged_into FROM j"""
)
def wiki_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items after others were merged into them."""
    items = shaped(spark, sf_dir, _WIKI).withColumns({n: F.split(n, ",") for n in (*SETS, "flags")})
    found = merged_items(items, shaped(spark, sf_dir, _MERGES))
    return found.select("item_id", *(F.array_join(n, ",").alias(n) for n in (*SETS, "flags")), "merged_into")
