"""Connected components of an edge list.

Up to ``LOCAL_EDGES`` edges (16 bytes each) one task unites them; more are contracted by alternating stars (Kiveris et al.,
2014) until nothing changes. Both ways give the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import checkpointed

#: Edges that one task may unite.
LOCAL_EDGES = 1_000_000


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each node's larger (or other) neighbours to the least node around it; minima are summed up before the shuffle."""
    if larger:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("least"))
    joined = both.join(least, F.col("a") == F.col("of"))
    if larger:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select(F.col("of").alias("a"), F.col("least").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches): hooking and pointer jumping over whole arrays."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while True:
        low, high = np.minimum(top[x], top[y]), np.maximum(top[x], top[y])
        if (low == high).all():
            return nodes, nodes[top]
        np.minimum.at(top, high, low)
        while (top[top] != top).any():
            top = top[top]


def _united(edges: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, of = [], None
        for batch in batches:
            of = batch.schema.field(0).type
            parts.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
        if sum(len(a) for a, _ in parts):
            nodes, least = least_reachable(*(np.concatenate(side) for side in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, of), pa.array(least, of)], names=["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _summary(edges: DataFrame) -> tuple:
    """The number of edges first; equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b): the least node that it can reach."""
    kind = edges.schema["a"].dataType.simpleString()
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    now, before = _summary(edges), None
    if now[0] <= LOCAL_EDGES:
        return _united(edges, kind)
    while now != before:
        edges = checkpointed(_stars(_stars(edges, larger=True), larger=False))
        before, now = now, _summary(edges)
    tops = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops.select("node", F.col("node").alias("component")))
