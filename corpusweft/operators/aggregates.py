"""Aggregations: quantiles, thresholds, summaries, conflicts, mined terms, budgets and rollups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query, table
from ..sources.shared import checkpointed

_WORD = re.compile(r"\w{2,}")
#: A threshold is this quantile of healthy snapshots less the margin, from so many snapshots on.
THRESHOLD_QUANTILE, THRESHOLD_MARGIN, LEAST_SNAPSHOTS = 0.2, 0.02, 3


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, n, q0, q1, ...): exact quantiles, interpolated at (n - 1) * share.

    Equal values are counted before the shuffle, and only counts of distinct values are put in order; no task holds the values
    of a key at once, since a key is spread over ranges of values and each range knows how many lie below it.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    spread = counted.withColumn("_part", F.floor(F.log2(F.abs(F.col("_v")) + 1e-12) * 8) * F.when(F.col("_v") < 0, F.lit(-1)).otherwise(F.lit(1)) + F.when(F.col("_v") < 0, F.lit(-100_000)).otherwise(F.lit(0)))
    parts = spread.groupBy(*keys, "_part").agg(F.sum("_c").alias("_own"))
    below = parts.withColumn("_below", F.sum("_own").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_own")).withColumn("_n", F.sum("_own").over(Window.partitionBy(*keys)))
    placed = spread.join(below.drop("_own"), [*keys, "_part"])
    upto = placed.withColumn("_to", F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v")))
    out = []
    for i, q in enumerate(shares):
        at = (F.col("_n") - 1) * F.lit(q)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda place: (F.col("_to") > place) & (F.col("_to") - F.col("_c") <= place)
        x, y = F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(high), F.col("_v")))
        share = F.max(at) - F.max(low)
        out.append((x + (y - x) * share).alias(f"q{i}"))
    return upto.groupBy(*keys).agg(F.max("_n").alias("n"), *out)


def recommended_threshold(quantile: Column, n_healthy: Column) -> Column:
    """From the THRESHOLD_QUANTILE of healthy snapshots, once there are enough of them."""
    return F.when(n_healthy >= LEAST_SNAPSHOTS, F.round(F.greatest(F.lit(0.0), quantile - THRESHOLD_MARGIN), 4))


@query(
    """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.2), 6) AS q20, round(quantile_cont(value, 0.5), 6) AS q50,
    CASE WHEN count(*) FILTER (WHERE value > 1) >= 3 THEN round(greatest(0.0, quantile_cont(value, 0.2) FILTER (WHERE value > 1) - 0.02), 4) END AS threshold FROM events GROUP BY 1"""
)
def replay_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated quantiles and the thresholds that they suggest."""
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    every = quantiles(rows, ["event_type"], "value", [0.2, 0.5])
    healthy = quantiles(rows.filter("value > 1"), ["event_type"], "value", [THRESHOLD_QUANTILE]).select("event_type", F.col("n").alias("n_healthy"), F.col("q0").alias("healthy"))
    return every.join(healthy, "event_type", "left").select("event_type", "n", F.round("q0", 6).alias("q20"), F.round("q1", 6).alias("q50"), recommended_threshold(F.col("healthy"), F.col("n_healthy")).alias("threshold"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language, by source, by both and in all."""
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


#: So many words are counted together before their counts leave a task.
COUNTED_WORDS = 1 << 22


def counted(codes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, how often they occur, in how many texts) of codes in the order of their texts, ``of`` being the texts' numbers."""
    by = np.argsort(codes, kind="stable")  # texts stay in order among equal codes
    codes, of = codes[by], of[by]
    new = np.r_[True, (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])][: len(codes)]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    return codes[first], np.diff(np.append(first, len(codes))), np.add.reduceat(new, first, dtype=np.int64) if len(first) else first


def mined_terms(docs: DataFrame, group: str, known: list[str], least: int, most: int, example: str, examples: int = 3) -> DataFrame:
    """(group, term, n, n_docs, examples, rank): the most frequent new words and pairs of neighbouring words, with the first places that hold them.

    Words are counted first. A pair occurs no more often than either of its words, so one among the first ``most`` of a group
    consists of words as frequent as the group's last listed word, and only such pairs are counted; where words are fewer than
    ``most``, of words that reach ``least``. A task counts COUNTED_WORDS together, so about one row for each different
    one goes on. Places are looked for afterwards, and only those of the terms that are listed.
    """
    kinds = [docs.schema[c].dataType.simpleString() for c in (group, example)]

    def rows_of(of: object, kind: pa.DataType, terms: list[str], n: np.ndarray, n_docs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([of] * len(terms), kind), pa.array(terms, pa.string()), pa.array(n), pa.array(n_docs)], names=["group", "term", "n", "n_docs"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, tuple[dict[str, int], list[np.ndarray]]] = {}
        size, kind = 0, None

        def rows() -> Iterator[pa.RecordBatch]:
            for of, (number, texts) in held.items():
                codes, n, n_docs = counted(np.concatenate(texts), np.repeat(np.arange(len(texts)), list(map(len, texts))))
                yield rows_of(of, kind, list(number), n, n_docs)  # numbers without gaps, in order

        for batch in batches:
            kind = batch.schema.field(0).type
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                number, texts = held.setdefault(of, ({}, []))
                own = _WORD.findall((text or "").lower())
                texts.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int32, len(own)))
                size += len(own)
                if size >= COUNTED_WORDS:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[object, tuple[list[str], dict[str, int], list[np.ndarray]]] = {}
            for of, terms, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if of not in held:
                    own = terms.as_py()
                    held[of] = own, {w: i for i, w in enumerate(own)}, []
                own, number, texts = held[of]
                ids = np.array([number.get(w, -1) for w in _WORD.findall((text or "").lower())], np.int64)
                texts.append((ids[:-1] * len(own) + ids[1:])[(ids[:-1] >= 0) & (ids[1:] >= 0)])
            for of, (own, _, texts) in held.items():
                codes, n, n_docs = counted(np.concatenate(texts), np.repeat(np.arange(len(texts)), list(map(len, texts))))
                yield rows_of(of, batch.schema.field(0).type, [f"{own[c // len(own)]} {own[c % len(own)]}" for c in codes.tolist()], n, n_docs)

    summed = lambda found: found.groupBy(F.col("group").alias(group), "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")).filter(F.col("n") >= least)
    first = lambda terms: terms.filter(~F.col("term").isin(*known)).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "term"))).filter(F.col("rank") <= most)
    schema = f"group {kinds[0]}, term string, n long, n_docs long"
    single = checkpointed(summed(docs.select(group, "text").mapInArrow(words, schema)))
    listed = checkpointed(first(single))
    bound = listed.filter(F.col("rank") == most).select(F.col(group).alias("_g"), F.col("n").alias("_n"))
    often = single.join(F.broadcast(bound), F.col(group).eqNullSafe(F.col("_g")), "left").filter(F.col("n") >= F.coalesce("_n", F.lit(least)))
    often = often.groupBy(group).agg(F.collect_list("term").alias("often"))  # ``most`` words a group, those as frequent as the last, and known ones
    texts = docs.select(F.col(group).alias("_g"), "text").join(F.broadcast(often), F.col("_g").eqNullSafe(F.col(group))).select("_g", "often", "text")
    ranked = first(listed.drop("rank").unionByName(summed(texts.mapInArrow(pairs, schema))))
    ranked = checkpointed(ranked)
    wanted = ranked.groupBy(group).agg(F.collect_list("term").alias("wanted"))  # ``most`` terms a group

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            open_terms: dict[tuple, set[str]] = {}  # what a place of a group has not shown yet
            held = []
            for of, place, terms, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if (of, place) not in open_terms:
                    open_terms[of, place] = set(terms.as_py())
                if not (wanted_here := open_terms[of, place]):
                    continue
                words = f" {' '.join(_WORD.findall((text.as_py() or '').lower()))} "
                seen_here = {t for t in wanted_here if f" {t} " in words}
                wanted_here -= seen_here
                held += ((of, t, place) for t in seen_here)
            columns = [*zip(*held)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], batch.schema.field(1).type)], names=["group", "term", "example"])

    texts = docs.select(F.col(group).alias("_g"), F.col(example).alias("_e"), "text").join(F.broadcast(wanted), F.col("_g").eqNullSafe(F.col(group))).select("_g", "_e", "wanted", "text")  # a row a group
    seen = texts.mapInArrow(places, f"group {kinds[0]}, term string, example {kinds[1]}").distinct()
    held = seen.withColumn("k", F.row_number().over(Window.partitionBy("group", "term").orderBy("example"))).filter(F.col("k") <= examples)
    shown = held.groupBy(F.col("group").alias("_g"), F.col("term").alias("_t")).agg(F.array_sort(F.collect_list("example")).alias("examples"))
    return ranked.join(shown, F.col(group).eqNullSafe(F.col("_g")) & (F.col("term") == F.col("_t"))).select(group, "term", "n", "n_docs", "examples", "rank")


@query(
    r"""WITH w AS (SELECT lang, source, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents), t AS (SELECT lang, source, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w),
    c AS (SELECT lang, term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t WHERE term NOT IN ('the', 'de', 'der') GROUP BY 1, 2 HAVING count(*) >= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM c), e AS (SELECT lang, term, list_slice(list_sort(list(DISTINCT source)), 1, 3) AS examples FROM t GROUP BY 1, 2)
    SELECT lang, term, n, n_docs, array_to_string(examples, ',') AS examples, rank::INT AS rank FROM r JOIN e USING (lang, term) WHERE rank <= 20"""
)
def term_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent new words and pairs of words of each language, without those already known, with the files that hold them."""
    found = mined_terms(table(spark, sf_dir, "documents"), "lang", ["the", "de", "der"], 3, 20, "source")
    return found.withColumn("examples", F.concat_ws(",", "examples"))


@query("SELECT p_brand, p_type, count(DISTINCT p_size) AS n_values FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) > 1")
def value_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys for which more than one value is stated."""
    distinct = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size").distinct()
    return distinct.groupBy("p_brand", "p_type").agg(F.count("*").alias("n_values")).filter("n_values > 1")


@query("SELECT source, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, sum(greatest(1, length(text) // 4)) <= 60000 AS within_budget FROM documents GROUP BY 1")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of each source against a budget."""
    total = F.sum(T.chunk_tokens(F.col("text")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(total.alias("tokens"), (total <= 60000).alias("within_budget"))


@query(
    """SELECT o_custkey AS parent, count(*) AS n_jobs, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS n_terminal, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_done,
    CASE WHEN count(*) > count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) THEN 'running' WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'failed' ELSE 'completed' END AS status FROM orders GROUP BY 1"""
)
def parent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent jobs from their children: counts, and a status once all children have ended."""
    ended = F.col("o_orderstatus").isin("F", "P")
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("parent")).agg(F.count("*").alias("n_jobs"), F.count_if(ended).alias("n_terminal"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.count_if(F.col("o_orderstatus") == "P").alias("n_failed"))
    status = F.when(F.col("n_jobs") > F.col("n_terminal"), F.lit("running")).when(F.col("n_failed") > 0, F.lit("failed")).otherwise(F.lit("completed"))
    return counted.select("parent", "n_jobs", "n_terminal", "n_done", status.alias("status"))


@query(
    """WITH s AS (SELECT p_brand, p_type, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM s)
    SELECT p_brand, sum(n)::BIGINT AS n_blocks, list(p_type ORDER BY n DESC, p_type) FILTER (WHERE k <= 5) AS top_types FROM r GROUP BY 1"""
)
def knowledge_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each group with its most frequent members in order."""
    counted = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type")))
    top = F.sort_array(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "p_type"))))  # five at most
    return ranked.groupBy("p_brand").agg(F.sum("n").alias("n_blocks"), F.transform(top, lambda x: x["p_type"]).alias("top_types"))


@query(
    """WITH r AS (SELECT o_custkey, o_totalprice / 600000 AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
    SELECT o_custkey, CAST(avg(least(1.0, greatest(0.0, s))) AS DECIMAL(5, 4)) AS quality, count(*) AS n FROM r WHERE k <= 3 GROUP BY 1"""
)
def bundle_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each bundle's three best scores."""
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") / 600000).alias("s"), F.row_number().over(best).alias("k")).filter("k <= 3")
    return top.groupBy("o_custkey").agg(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "s"))).cast("decimal(5,4)").alias("quality"), F.count("*").alias("n"))
