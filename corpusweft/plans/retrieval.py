"""Compositions: hybrid retrieval from documents and vectors of one's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import ranking

#: How many more hits than asked for each side fetches: a multiple, and for the sparse side at least so many more.
DENSE_FETCH, SPARSE_FETCH, SPARSE_MORE = 8, 12, 12


def hybrid(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, dense_hit, sparse_hit, dense_score, sparse_score, final_score, rank) for docs (id, text, vector) and queries (query_id, text, vector).

    Both sides fetch more than k, the two hit lists are merged, scores normalised within a query, blended and ranked.
    """
    dense = ranking.dense_top_k(docs.select("id", "vector"), queries.select("query_id", "vector"), k * DENSE_FETCH)
    sparse = ranking.sparse_top_k(docs.select("id", "text"), queries.select("query_id", "text"), max(k * SPARSE_FETCH, k + SPARSE_MORE))
    a = dense.select("query_id", "id", F.col("score").alias("dense"), F.lit(True).alias("dense_hit"))
    b = sparse.select("query_id", "id", F.col("score").alias("sparse"), F.lit(True).alias("sparse_hit"))
    both = a.join(b, ["query_id", "id"], "full_outer").fillna(0.0, ["dense", "sparse"]).fillna(False, ["dense_hit", "sparse_hit"])
    own = Window.partitionBy("query_id")
    scored = both.select("query_id", "id", "dense_hit", "sparse_hit", S.min_max(F.col("dense"), own).alias("d"), S.min_max(F.col("sparse"), own).alias("s"))
    final = F.round(S.blend(dense=F.col("d"), sparse=F.col("s")), 6)
    rounded = scored.select("query_id", "id", "dense_hit", "sparse_hit", F.round("d", 6).alias("dense_score"), F.round("s", 6).alias("sparse_score"), final.alias("final_score"))
    order = own.orderBy(F.desc("final_score"), F.desc("sparse_score"), F.desc("dense_score"), "id")
    return rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
