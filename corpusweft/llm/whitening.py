"""Whitening of embeddings from an exact covariance.

Entries become integers, so a covariance can be exact: with n distinct vectors x and their sums S, the centred vectors
n*x - S are integers too. Each partition of the distinct vectors reduces them modulo several primes and multiplies each
residue matrix with itself in floating point, in blocks so short that no product sum leaves the exact range of a double.
Residues add up over partitions, and Chinese remaindering turns the sums into the exact scatter, from whose double
eigendecomposition the components come. The primes are as many as the largest possible entry, measured first, asks for.

Contract
--------
``fit(vectors)`` learns from the distinct usable vectors, ``transform(vectors, model)`` gives rows (id, component, n,
deviation, whitened, explained, identity_error). A vector that is null, empty, or holds a null, NaN or infinite entry is
dropped, as is one with an entry of 2**62 / 64 or more in size, which no long can hold. Where vectors differ in length,
the most frequent length among distinct vectors counts (the longest of ties) and others are dropped. Components whose
eigenvalue is zero to double precision cannot be scaled and have no rows, so one distinct vector alone gives no rows,
like an empty table. Null ids are ids like any other; repeated rows give repeated rows. A deviation beyond a long is
null. Only the id and the vector are read, so clashing names do no harm. What reaches the driver is bounded by the
square of a vector's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import bounded_batches, checkpointed

#: x = floor(STEPS * entry) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Residues modulo primes below this lie within half of it around zero.
PRIME_BITS = 21
#: Rows of one exact product: BLOCK * (2**(PRIME_BITS - 1))**2 < 2**53.
BLOCK = 1 << 12
COMPONENTS = 16


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns; components (columns of ``vectors``) by falling eigenvalue."""

    n: int
    sums: list[int]
    reach: int  # the largest |n * x - S|
    scatter: list[list[int]]  # of n * x - S, exact
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def projection(self) -> np.ndarray:
        """Takes x - S/n to whitened components."""
        return self.vectors / np.sqrt(self.values)


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, x) of the usable vectors."""
    scaled = F.transform(F.col(vector_column), lambda c: c.cast("double") * STEPS)
    usable = F.forall("scaled", lambda c: F.coalesce(F.abs(c) < 2.0**62, F.lit(False)) & ~F.isnan(c))
    rows = vectors.select(F.col(id_column).alias("id"), scaled.alias("scaled")).filter(F.col("scaled").isNotNull() & (F.size("scaled") > 0) & usable)
    return rows.select("id", F.transform("scaled", lambda c: F.floor(c).cast("long") + SHIFT).alias("x"))


def matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """The arrays of a column, all equally long, as one matrix."""
    rows = batch.column(column)
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(rows), -1)


def totals(distinct: DataFrame) -> list:
    """By length of vectors and place: number of vectors, sum in two halves, least and largest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                x = rows.filter(pa.array(sizes == size)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
                columns = (np.full(size, size), np.arange(size), np.full(size, len(x)), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), x.min(0), x.max(0))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["size", "place", "n", "high", "low", "least", "most"])

    parts = distinct.mapInArrow(run, "size long, place long, n long, high long, low long, least long, most long")
    wide = (F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))
    return parts.groupBy("size", "place").agg(F.sum("n").alias("n"), *wide, F.min("least").alias("least"), F.max("most").alias("most")).collect()


def primes(bound: int) -> list[int]:
    """The largest primes below 2**PRIME_BITS, until their product exceeds twice the bound."""
    found, product, candidate = [], 1, (1 << PRIME_BITS) - 1
    while product <= 2 * bound + 1:
        if all(candidate % k for k in range(3, int(candidate**0.5) + 1, 2)):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def residues(x: np.ndarray, n: int, sums: list[int], prime: int) -> np.ndarray:
    """n * x - S modulo a prime, around zero, as doubles."""
    own = np.array([s % prime for s in sums], np.int64)
    y = ((x % prime) * (n % prime) - own) % prime
    return np.where(y > prime // 2, y - prime, y).astype(np.float64)


def scatter(distinct: DataFrame, n: int, sums: list[int], reach: int) -> list[list[int]]:
    """Sum over the distinct vectors of (n*x - S)(n*x - S)', exact."""
    chosen, size = primes(n * reach * reach), len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(chosen), size, size), np.int64)
        for batch in batches:
            x = matrix(batch, 0)
            for at in range(0, len(x), BLOCK):
                for k, prime in enumerate(chosen):
                    y = residues(x[at : at + BLOCK], n, sums, prime)
                    total[k] = (total[k] + (y.T @ y).astype(np.int64)) % prime
        for k in range(len(chosen)):
            for i in range(size):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size - i, v, np.int64)) for v in (k, i)] + [pa.array(np.arange(i, size)), pa.array(total[k, i, i:])], names=["k", "i", "j", "r"])

    summed = distinct.mapInArrow(run, "k long, i long, j long, r long").groupBy("k", "i", "j").agg(F.sum("r").alias("r")).collect()
    whole = 1
    for prime in chosen:
        whole *= prime
    weight = [whole // p * pow(whole // p, -1, p) for p in chosen]
    out = [[0] * size for _ in range(size)]
    for row in summed:
        out[row.i][row.j] += int(row.r) * weight[row.k]
    for i in range(size):
        for j in range(i, size):
            value = out[i][j] % whole
            out[i][j] = out[j][i] = value - whole if 2 * value > whole else value
    return out


def fit(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[Whitening | None, DataFrame]:
    """(the model, or None without usable vectors; the distinct vectors as a checkpointed list)."""
    bounded_batches(vectors.sparkSession)
    distinct = checkpointed(quantised(vectors, id_column, vector_column).select("x").distinct())
    found = totals(distinct)
    if not found:
        return None, distinct
    n, size = max((row.n, row.size) for row in found)
    places = sorted((row for row in found if row.size == size), key=lambda row: row.place)
    sums = [(int(row.high) << 32) + int(row.low) for row in places]
    reach = max(abs(n * x - s) for row, s in zip(places, sums) for x in (row.least, row.most))
    distinct = distinct.filter(F.size("x") == size)
    exact = scatter(distinct, n, sums, reach)
    covariance = np.array([[v / n**3 for v in row] for row in exact])
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1], columns[:, ::-1]
    rank = int((values > max(values[0], 0) * size * np.finfo(float).eps).sum())
    return Whitening(n, sums, reach, exact, values[:rank], columns[:, :rank], sum(exact[i][i] for i in range(size)) / n**3), distinct


def centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exact: 64-bit arithmetic wraps round, so only the result has to fit."""
    if model.reach < 1 << 62:
        return x * np.int64(model.n) - np.array(model.sums, object).astype(np.int64)
    return x.astype(object) * model.n - np.array(model.sums, object)


def identity_error(distinct: DataFrame, model: Whitening, most: int = COMPONENTS) -> float:
    """Largest absolute entry of the covariance of the whitened distinct vectors minus the identity, measured on them all."""
    projection = model.projection[:, :most]
    size = projection.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            w = (centred(matrix(batch, 0), model) / model.n).astype(np.float64) @ projection  # centred on the exact mean
            total += w.T @ w
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["i", "j", "v"])

    covariance = np.zeros((size, size))
    for row in distinct.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        covariance[row.i, row.j] = row.v / model.n
    return float(np.abs(covariance - np.eye(size)).max(initial=0))


def deviations(y: np.ndarray, reach: int) -> pa.Array:
    """Sums of squares, exact; null where a long cannot hold them."""
    if y.shape[1] * reach * reach < 1 << 63:
        return pa.array((y * y).sum(1))
    return pa.array([int(v) if v < 1 << 63 else None for v in (y.astype(object) ** 2).sum(1)], pa.int64())


def transform(vectors: DataFrame, model: Whitening | None, error: float, most: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row for each usable vector and component up to ``most`` (see the module's contract)."""
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = quantised(vectors, id_column, vector_column)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    projection = model.projection[:, :most]
    count = projection.shape[1]
    share = model.values[:count] / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = centred(matrix(batch, 1), model)
            each = pa.array(np.repeat(np.arange(len(y)), count))
            whitened = (y / model.n).astype(np.float64) @ projection
            columns = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(y))), pa.array(np.full(len(each), model.n)), deviations(y, model.reach).take(each)]
            columns += [pa.array(whitened.ravel()), pa.array(np.tile(share, len(y))), pa.array(np.full(len(each), error))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(F.size("x") == len(model.sums)).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def whitened(vectors: DataFrame, most: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Fit on the distinct vectors and transform all rows."""
    model, distinct = fit(vectors, id_column, vector_column)
    error = identity_error(distinct, model, most) if model is not None and len(model.values) else 0.0
    return transform(vectors, model, error, most, id_column, vector_column)
