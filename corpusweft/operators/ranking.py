"""Search: dense and sparse scores, their normalisation, fusion and top-k."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import scores as S
from ..functions import text as T
from ..registry import query, table
from ..sources.shared import checkpointed

#: Fixed values of the sparse score: its two parameters, and what a whole query inside a text adds.
K1, B, PHRASE = 1.2, 0.75, 0.8
#: Fixed values of rank fusion: how far down each list it looks, its constant, the largest boost, and the least scores that are ranked.
RRF_WINDOW, RRF_K, RRF_MAX, LEAST_SPARSE, LEAST_SEMANTIC = 32, 10, 0.12, 0.12, 0.2
#: Fixed values of the rerank boost: how far down it looks, its constant, the largest boost and the least score.
RERANK_WINDOW, RERANK_K, RERANK_MAX, LEAST_RERANK = 16, 4, 0.05, 0.18
#: Weights of the sparse and the rerank score in a search by keywords alone.
KEYWORD_SPARSE, KEYWORD_RERANK = 0.72, 0.28
#: Queries that meet the rows at once, as a matrix of scores.
QUERY_BLOCK = 256
#: First characters of a phrase by which it is looked for, a power of two, and the bits of their hash that a table holds.
PROBE, PROBE_BITS, PROBE_STEP = 16, 20, 0x9E3779B97F4A7C15
#: Rows of a batch that meet the queries at once.
ROW_BLOCK = 1024


def query_blocks(queries: DataFrame, size: int) -> Iterator[pa.Table]:
    """A stated query set in blocks of about ``size`` rows; the driver holds one at a time."""
    blocks = max(1, -(-queries.count() // size))
    for b in range(blocks):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow() if blocks > 1 else queries.toArrow()
        if some.num_rows:
            yield some


def _best(score: np.ndarray, order: np.ndarray, k: int, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores of each row, equal scores by ``order`` of the columns."""
    at = np.lexsort((np.broadcast_to(order, score.shape), -score), axis=1)[:, :k]
    rows = np.repeat(np.arange(len(score)), at.shape[1])
    at = at.ravel()
    keep = slice(None) if least is None else score[rows, at] > least
    return rows[keep], at[keep]


def _ordered(ids: pa.Array) -> np.ndarray:
    """Ranks of ids of any type that has an order."""
    return np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]


class Best:
    """The k best scores of each of n queries that a task has met so far, equal ones by id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least, self.held, self.size = k, np.full(n, -np.inf), [], 0

    def add(self, row: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        good = np.flatnonzero(score >= self.least[row])
        if len(good):
            self.held.append((row[good], ids.take(pa.array(good)), score[good]))
            self.size += len(good)
        if self.size > max(4 * self.k * len(self.least), 1 << 16):
            self.all()

    def all(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        row, score = (np.concatenate([h[i] for h in self.held]) for i in (0, 2))
        ids = pa.concat_arrays([h[1] for h in self.held])
        by = np.lexsort((_ordered(ids), -score, row))
        first = np.r_[True, row[by][1:] != row[by][:-1]]
        place = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        by, last = by[place < self.k], by[place == self.k - 1]
        self.least[row[last]] = score[last]
        self.held, self.size = [(row[by], ids.take(pa.array(by)), score[by])], len(by)
        return self.held[0]


def _probes(text: str) -> np.ndarray:
    """A hash of each PROBE characters of a text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < PROBE:
        return codes[:0]
    size = 1
    while size < PROBE:
        codes = codes[:-size] * np.uint64(pow(PROBE_STEP, size, 1 << 64)) + codes[size:]
        size *= 2
    codes ^= codes >> np.uint64(29)
    return codes * np.uint64(PROBE_STEP)


class Phrases:
    """Which of some phrases lie in which texts; a text is read once for all phrases of PROBE characters or more."""

    def __init__(self, phrases: list[str]) -> None:
        self.phrases = phrases
        self.short = [i for i, p in enumerate(phrases) if 0 < len(p) < PROBE]
        self.of: dict[int, list[int]] = {}
        for i, p in enumerate(phrases):
            if len(p) >= PROBE:
                self.of.setdefault(int(_probes(p[:PROBE])[0]), []).append(i)
        self.table = np.zeros(1 << PROBE_BITS, bool)
        self.table[[h >> (64 - PROBE_BITS) for h in self.of]] = True

    def inside(self, texts: list[str]) -> set[tuple[int, int]]:
        """(phrase, text) of the phrases, empty ones left out, that lie in a text."""
        found = {(i, j) for i in self.short for j, t in enumerate(texts) if self.phrases[i] in t}
        if not self.of:
            return found
        hashes = _probes("".join(texts))
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - PROBE_BITS)])
        ends = np.cumsum([len(t) for t in texts])
        owner = np.searchsorted(ends, at, side="right")
        for h, j, start in zip(hashes[at].tolist(), owner.tolist(), at.tolist()):
            for i in self.of.get(h, ()):
                if texts[j].startswith(self.phrases[i], start - int(ends[j]) + len(texts[j])):
                    found.add((i, j))
        return found


def _hits(rows: DataFrame, queries: DataFrame, columns: list[str], run) -> DataFrame:
    kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    return rows.select(*columns).mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def dense_top_k(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best points (id, vector) by cosine for each query (query_id, vector).

    Queries are a stated set and go out in blocks; one scan of the points meets all of them, QUERY_BLOCK queries and
    ROW_BLOCK points at once, and each task keeps its best k of each query, so that only those are shuffled. Equal scores rank by id. Null vectors are left out; vectors of unequal
    length are compared over the shorter length, and a vector of zeros has the score 0.
    """
    spark = points.sparkSession
    sent = []
    for some in query_blocks(queries.filter(F.col("vector").isNotNull()).select("query_id", "vector"), 16 * QUERY_BLOCK):
        vectors = [np.array(v, np.float64) for v in some["vector"].to_pylist()]
        for size in sorted({len(v) for v in vectors}):
            own = [i for i, v in enumerate(vectors) if len(v) == size]
            sent.append(spark.sparkContext.broadcast((some["query_id"].combine_chunks().take(pa.array(own)), np.array([vectors[i] for i in own]).reshape(len(own), size))))

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Best] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROW_BLOCK):
                some = batch.slice(start, ROW_BLOCK)
                vectors = some.column(1)
                sizes = np.array(pa.compute.list_value_length(vectors).to_pylist(), np.int64)
                for size in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == size)
                    ids = some.column(0).take(pa.array(rows))
                    x = np.array(vectors.take(pa.array(rows)).to_pylist(), np.float64).reshape(len(rows), size)
                    order = _ordered(ids)
                    for number, block in enumerate(sent):
                        of, q = block.value
                        n = min(size, q.shape[1])
                        best = kept.setdefault(number, Best(len(q), k))
                        own = unit(x[:, :n]).T
                        for low in range(0, len(q), QUERY_BLOCK):
                            score = unit(q[low : low + QUERY_BLOCK, :n]) @ own
                            row, at = _best(score, order, k)
                            best.add(low + row, ids.take(pa.array(at)), score[row, at])
        for number, best in kept.items():
            row, ids, score = best.all()
            yield pa.RecordBatch.from_arrays([sent[number].value[0].take(pa.array(row)), ids, pa.array(score)], names=["query_id", "id", "score"])

    return _ranked(_hits(points.filter(F.col("vector").isNotNull()), queries, ["id", "vector"], run), k)


def term_statistics(docs: DataFrame, terms: list[str]) -> tuple[int, float, np.ndarray]:
    """(number of documents, their mean number of tokens, how many hold each of the terms), in one scan."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found, n, total = sent.value, Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = T.python_tokens(text or "")
                n, total = n + 1, total + len(own)
                found.update(number.keys() & set(own))
        rows = [(-2, n), (-1, total), *((number[t], c) for t, c in found.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], names=["term", "n"])

    counts = dict(docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # a row for each term of the query set
    n = counts.get(-2, 0)
    return n, counts.get(-1, 0) / max(n, 1), np.array([counts.get(i, 0) for i in range(len(terms))], np.float64)


def sparse_top_k(docs: DataFrame, queries: DataFrame, k: int, phrase: float = PHRASE, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k best documents (id, text) by BM25 for each query (query_id, text), whole texts.

    A repeated query term counts twice, and a text that holds the whole query (both in their plain form) gains ``phrase``. Only
    scores above 0 are ranked, equal ones by id. One scan gathers the statistics of the queries' terms, a second one scores:
    queries are a stated set and go out in blocks, as the weights of their terms; a text meets those of its own terms alone, and
    each task keeps its best k of each query, so that only those are shuffled.
    """
    spark = docs.sparkSession
    plain = lambda c: F.coalesce(H.compact(F.col(c)), F.lit(""))
    blocks = [b.to_pylist() for b in query_blocks(queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"), plain("text").alias("plain")), QUERY_BLOCK)]
    asked = [[Counter(T.python_tokens(r["text"])) for r in block] for block in blocks]
    terms = sorted({t for block in asked for own in block for t in own})
    n_docs, mean, df = term_statistics(docs, terms)
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    kind = queries.select("query_id").limit(0).toArrow().schema.field(0).type
    number = {t: i for i, t in enumerate(terms)}
    sent = []
    for block, own in zip(blocks, asked):
        used = sorted({number[t] for c in own for t in c})
        at = {t: i for i, t in enumerate(used)}
        weights = np.zeros((len(used), len(block)))
        for i, c in enumerate(own):
            for t, times in c.items():
                weights[at[number[t]], i] = times * idf[number[t]]
        sent.append(spark.sparkContext.broadcast((pa.array([r["query_id"] for r in block], kind), Phrases([r["plain"] for r in block]), {terms[t]: i for t, i in at.items()}, weights)))
    scale = 10.0**digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Best] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                ids, plains = some.column(0), some.column(2).to_pylist()
                counted = [Counter(T.python_tokens(t or "")) for t in some.column(1).to_pylist()]
                sizes = [sum(c.values()) for c in counted]
                for n, block in enumerate(sent):
                    of, phrases, place, weights = block.value
                    score = np.zeros((len(of), len(counted)))
                    for j, (c, size) in enumerate(zip(counted, sizes)):
                        own = sorted((place[t], c[t]) for t in place.keys() & c.keys())
                        if own:
                            at, times = np.array(own).T
                            score[:, j] = (times * (K1 + 1) / (times + K1 * (1 - B + B * size / max(mean, 1.0)))) @ weights[at]
                    for i, j in phrases.inside(plains) if phrase else ():
                        score[i, j] += phrase * (sizes[j] > 0)
                    score = np.floor(score * scale + 0.5) / scale
                    row, at = _best(score, _ordered(ids), k, 0.0)
                    kept.setdefault(n, Best(len(of), k)).add(row, ids.take(pa.array(at)), score[row, at])
        for n, best in kept.items():
            if best.held:
                row, ids, score = best.all()
                yield pa.RecordBatch.from_arrays([sent[n].value[0].take(pa.array(row)), ids, pa.array(score)], names=["query_id", "id", "score"])

    return _ranked(_hits(docs.select("id", "text", plain("text").alias("plain")), queries, ["id", "text", "plain"], run), k)


def fused(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Boosts for rows that both ranked lists (keys, rank) hold within RRF_WINDOW: RRF_MAX for the best possible ranks."""
    a = first.filter(F.col("rank") <= RRF_WINDOW).withColumnRenamed("rank", "rank_a")
    b = second.filter(F.col("rank") <= RRF_WINDOW).withColumnRenamed("rank", "rank_b")
    rrf = 1 / (RRF_K + F.col("rank_a")) + 1 / (RRF_K + F.col("rank_b"))
    return a.join(b, keys).withColumn("boost", F.round(RRF_MAX * rrf / (2 / (RRF_K + 1)), 6))


def fusion_boosts(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The candidates (keys, sparse, semantic, ...) with ``boost``: of those within the window by ``order``, the ones whose sparse and semantic scores both reach their least values gain by their ranks in both lists."""
    of = Window.partitionBy(*keys)
    inside = candidates.withColumn("_place", F.row_number().over(of.orderBy(*order)))
    strong = {"sparse": F.col("sparse") >= LEAST_SPARSE, "semantic": F.col("semantic") >= LEAST_SEMANTIC}
    rank = {c: F.sum(F.when((F.col("_place") <= RRF_WINDOW) & ok, 1).otherwise(0)).over(of.orderBy(F.desc(c), *order).rowsBetween(Window.unboundedPreceding, 0)) for c, ok in strong.items()}
    rrf = 1 / (RRF_K + rank["sparse"]) + 1 / (RRF_K + rank["semantic"])
    boost = F.when((F.col("_place") <= RRF_WINDOW) & strong["sparse"] & strong["semantic"], RRF_MAX * rrf / (2 / (RRF_K + 1))).otherwise(F.lit(0.0))
    return inside.withColumn("boost", F.round(boost, 6)).drop("_place")


def rerank_boosts(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The candidates (keys, rerank, ...) with ``boost``: within the window, by rank among rerank scores of LEAST_RERANK or more, times the score."""
    of = Window.partitionBy(*keys)
    inside = candidates.withColumn("_place", F.row_number().over(of.orderBy(*order)))
    able = (F.col("_place") <= RERANK_WINDOW) & (F.col("rerank") >= LEAST_RERANK)
    rank = F.sum(F.when(able, 1).otherwise(0)).over(of.orderBy(F.desc("rerank"), *order).rowsBetween(Window.unboundedPreceding, 0))
    boost = F.when(able, F.least(F.lit(RERANK_MAX), RERANK_MAX * (RERANK_K + 1) / (RERANK_K + rank) * F.col("rerank"))).otherwise(F.lit(0.0))
    return inside.withColumn("boost", F.round(boost, 6)).drop("_place")


def asked_parts(asked: Column) -> Column:
    """What a rerank score needs of a query, worked out once a query."""
    return F.struct(F.array_distinct(T.tokens(asked, 160)).alias("q"), H.compact(asked).alias("close"))


def text_parts(text: Column) -> Column:
    """What it needs of a text, worked out once a text, however many queries ask for it."""
    lead = F.array_join(F.slice(F.split(text, "\n"), 1, 3), "\n")
    return F.struct(F.array_distinct(T.tokens(text, 320)).alias("t"), F.array_distinct(T.tokens(lead, 96)).alias("lead"), H.compact(text).alias("whole"))


def overlap_score(x: Column, y: Column) -> Column:
    """Of the parts of a query and a text: half for the whole query inside the text, 0.3 for the share of its words there, 0.2 for those in the first three lines, less up to 0.12 for many more words than asked for."""
    share = lambda other: F.size(F.array_intersect(x["q"], other)) / F.greatest(F.size(x["q"]), F.lit(1))
    inside = ((x["close"] != "") & y["whole"].contains(x["close"])).cast("int")
    longer = F.least(F.lit(0.12), F.greatest(F.lit(0.0), (F.size(y["t"]) - 6 * F.size(x["q"])) * 0.002))
    score = S.clamp(0.5 * inside + 0.3 * share(y["t"]) + 0.2 * share(y["lead"]) - longer)
    return F.when((F.size(x["q"]) == 0) | (F.size(y["t"]) == 0), F.lit(0.0)).otherwise(score)


def reranked(found: DataFrame, asked: DataFrame, docs: DataFrame) -> DataFrame:
    """found (query_id, id, ...) with ``rerank``: each text that was found is taken apart once, and so is each query."""
    found = checkpointed(found)
    texts = docs.join(found.select("id").distinct(), "id", "left_semi").select("id", text_parts(F.col("text")).alias("_y"))
    queries = asked.select("query_id", asked_parts(F.col("text")).alias("_x"))
    return found.join(checkpointed(texts), "id").join(checkpointed(queries), "query_id").withColumn("rerank", overlap_score(F.col("_x"), F.col("_y"))).drop("_x", "_y")


_VECTORS = "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return points, points.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")  # the stated query set


@query(
    f"""WITH p AS ({_VECTORS}), s AS (SELECT q.id AS query_id, p.id, list_cosine_similarity(q.v, p.v) AS score FROM p q, p WHERE q.id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10"""
)
def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each query vector."""
    points, queries = _points(spark, sf_dir)
    return dense_top_k(points, queries, 10).withColumn("score", F.round("score", 6))


@query(
    f"""WITH p AS (SELECT e.vec_id AS id, e.label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings e), s AS (SELECT q.id AS query_id, p.id, list_cosine_similarity(q.v, p.v) AS score FROM p q, p WHERE q.id % 50 = 0 AND p.label IN (1, 3, 5)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5"""
)
def filtered_dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search under a payload filter, which is applied before scoring."""
    points, queries = _points(spark, sf_dir)
    return dense_top_k(points.filter(F.col("label").isin(1, 3, 5)), queries, 5).withColumn("score", F.round("score", 6))


def _sql_compact(t: str) -> str:
    title = "CASE " + " ".join(f"WHEN regexp_matches({t}, '{f}') THEN regexp_extract({t}, '{f}', 2)" for f in H.FORMS) + f" ELSE {t} END"
    spaced = f"regexp_replace(regexp_replace(regexp_replace({title}, '{H.FILLER}', ' ', 'g'), '{H.PUNCTUATION}', ' ', 'g'), '\\s+', '', 'g')"
    return f"replace({spaced}, ' ', '')"


_STRIPPED = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_BM25 = rf"""d AS (SELECT doc_id AS id, {T.sql_tokens("text")} AS t, {_sql_compact(_STRIPPED.format("text"))} AS p FROM documents),
    b AS (SELECT item_id AS query_id, {T.sql_tokens("text")} AS t, {_sql_compact(_STRIPPED.format("text"))} AS p FROM benchmark),
    q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(t) AS term FROM b) GROUP BY ALL),
    g AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_size FROM d),
    h AS (SELECT id, size, term, count(*) AS tf FROM (SELECT id, len(t) AS size, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
    w AS (SELECT id, term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / greatest(mean_size, 1))) AS part FROM h JOIN f USING (term), g),
    e AS (SELECT query_id, id, sum(part * times) AS score FROM w JOIN q USING (term) GROUP BY ALL UNION ALL SELECT query_id, id, 0.8 FROM b JOIN d ON b.p <> '' AND len(d.t) > 0 AND contains(d.p, b.p)),
    s AS (SELECT query_id, id, floor(sum(score) * 1e6 + 0.5) / 1e6 AS score FROM e GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0)"""


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_BM25} SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 5")
def sparse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents by BM25 for each benchmark text."""
    return sparse_top_k(*_corpus(spark, sf_dir), 5)


@query(
    f"""WITH {_BM25}, x AS (SELECT doc_id AS id, {T.sql_fallback_vector("text")} AS v FROM documents), y AS (SELECT item_id AS query_id, {T.sql_fallback_vector("text")} AS v FROM benchmark),
    k AS (SELECT query_id, id, list_cosine_similarity(x.v, y.v) AS dense FROM x, y), l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, id) AS rank FROM k),
    c AS (SELECT coalesce(a.query_id, z.query_id) AS query_id, coalesce(a.id, z.id) AS id, coalesce(a.dense, 0.0) AS dense, coalesce(z.score, 0.0) AS sparse, a.id IS NOT NULL AS dense_hit, z.id IS NOT NULL AS sparse_hit FROM (SELECT * FROM l WHERE rank <= 80) a FULL JOIN (SELECT * FROM r WHERE rank <= 120) z ON a.query_id = z.query_id AND a.id = z.id),
    m AS (SELECT *, greatest(sparse, 0) AS sp, greatest(dense, 0) AS de FROM c),
    n AS (SELECT *, min(sp) OVER w AS ls, max(sp) OVER w AS hs, min(de) OVER w AS ld, max(de) OVER w AS hd FROM m WINDOW w AS (PARTITION BY query_id)),
    o AS (SELECT query_id, id, dense_hit, sparse_hit, CASE WHEN hs <= 0 THEN 0.0 WHEN hs = ls THEN least(1.0, sp / hs) ELSE (sp - ls) / (hs - ls) END AS sparse_score, CASE WHEN hd <= 0 THEN 0.0 WHEN hd = ld THEN least(1.0, de / hd) ELSE (de - ld) / (hd - ld) END AS dense_score FROM n),
    u AS (SELECT query_id, id, dense_hit, sparse_hit, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score, round(greatest(0.0, least(1.0, dense_score * (0.48 / (0.48 + 0.27)) + sparse_score * (0.27 / (0.48 + 0.27)))), 6) AS final_score FROM o),
    z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, sparse_score DESC, dense_score DESC, id) AS rank FROM u)
    SELECT query_id, id, dense_hit, sparse_hit, dense_score, sparse_score, final_score, rank::INT AS rank FROM z WHERE rank <= 10"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of both lists: dense hits by vectors and sparse hits by BM25, merged, normalised, blended and ranked."""
    from ..plans.retrieval import hybrid

    with_vectors = lambda rows: rows.withColumn("vector", T.fallback_vector(F.col("text")))
    return hybrid(*map(with_vectors, _corpus(spark, sf_dir)), 10).select("query_id", "id", "dense_hit", "sparse_hit", "dense_score", "sparse_score", "final_score", "rank")


_PAIRS = f"""WITH {_BM25}, j AS (SELECT query_id, r.id, r.score, r.rank, x.text, b.text AS asked FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents x ON x.doc_id = r.id WHERE rank <= 40),
    v AS (SELECT *, list_distinct({T.sql_tokens("asked", 160)}) AS q, list_distinct({T.sql_tokens("text", 320)}) AS t, list_distinct({T.sql_tokens("array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10))", 96)}) AS lead, {_sql_compact(_STRIPPED.format("asked"))} AS p, {_sql_compact(_STRIPPED.format("text"))} AS pt FROM j),
    o AS (SELECT query_id, id, score, rank, CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.5 * (p <> '' AND contains(pt, p))::INT + 0.3 * len(list_intersect(q, t)) / greatest(len(q), 1) + 0.2 * len(list_intersect(q, lead)) / greatest(len(q), 1) - least(0.12, greatest(0.0, (len(t) - 6 * len(q)) * 0.002)))) END AS rerank FROM v)"""


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _corpus(spark, sf_dir)
    found = sparse_top_k(docs, asked, 40)
    return reranked(found, asked, docs).select("query_id", "id", "score", "rank", "rerank")


@query(f"{_PAIRS} SELECT query_id, id, round(rerank, 6) AS rerank_score FROM o")
def overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates scored again by containment, shared words, shared leading words and length."""
    return _reranked(spark, sf_dir).select("query_id", "id", F.round("rerank", 6).alias("rerank_score"))


@query(
    f"""{_PAIRS}, able AS (SELECT *, rank <= 16 AND rerank >= 0.18 AS able FROM (SELECT query_id, id, score, rank, round(rerank, 6) AS rerank FROM o)), y AS (SELECT *, sum(able::INT) OVER (PARTITION BY query_id ORDER BY rerank DESC, rank) AS k FROM able)
    SELECT query_id, id, rerank, CASE WHEN able THEN round(least(0.05, 0.05 * 5 / (4 + k) * rerank), 6) ELSE 0.0 END AS boost FROM y"""
)
def rerank_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rerank score of each query's first candidates adds to them."""
    found = _reranked(spark, sf_dir).withColumn("rerank", F.round("rerank", 6))
    return rerank_boosts(found, ["query_id"], [F.col("rank")]).select("query_id", "id", "rerank", "boost")


@query(
    f"""{_PAIRS}, n AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS sparse, rerank AS semantic, rank FROM o), a AS (SELECT query_id, id, round(sparse, 6) AS sparse, round(semantic, 6) AS semantic, rank FROM n),
    k AS (SELECT *, sum((rank <= 32 AND sparse >= 0.12)::INT) OVER (PARTITION BY query_id ORDER BY sparse DESC, rank) AS x, sum((rank <= 32 AND semantic >= 0.2)::INT) OVER (PARTITION BY query_id ORDER BY semantic DESC, rank) AS y FROM a)
    SELECT query_id, id, CASE WHEN rank <= 32 AND sparse >= 0.12 AND semantic >= 0.2 THEN round(0.12 * (1.0 / (10 + x) + 1.0 / (10 + y)) / (2.0 / 11), 6) ELSE 0.0 END::DOUBLE AS boost FROM k"""
)
def fusion_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion with least scores in both lists."""
    found = _reranked(spark, sf_dir)
    best = Window.partitionBy("query_id")
    scored = found.select("query_id", "id", "rank", F.round(F.col("score") / F.max("score").over(best), 6).alias("sparse"), F.round("rerank", 6).alias("semantic"))
    return fusion_boosts(scored, ["query_id"], [F.col("rank")]).select("query_id", "id", "boost")


@query(
    f"""{_PAIRS}, n AS (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS sparse, CASE WHEN max(rerank) OVER w <= 0 THEN 0.0 WHEN max(rerank) OVER w = min(rerank) OVER w THEN least(1.0, 1.0) ELSE (rerank - min(rerank) OVER w) / (max(rerank) OVER w - min(rerank) OVER w) END AS rr FROM o WINDOW w AS (PARTITION BY query_id)),
    fin AS (SELECT query_id, id, round(sparse, 6) AS sparse, round(greatest(0.0, least(1.0, 0.72 * sparse + 0.28 * rr)), 6) AS final_score FROM n), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, sparse DESC, id) AS rank FROM fin)
    SELECT query_id, id, final_score, printf('sparse_match=%.3f; final_score=%.3f', sparse, final_score) AS reason, rank::INT AS rank FROM z WHERE rank <= 5"""
)
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by keywords alone: the sparse and the rerank score, normalised and blended, with a trace of both."""
    own = Window.partitionBy("query_id")
    found = _reranked(spark, sf_dir).select("query_id", "id", S.min_max(F.col("score"), own).alias("sparse"), S.min_max(F.col("rerank"), own).alias("rr"))
    final = F.round(S.clamp(KEYWORD_SPARSE * F.col("sparse") + KEYWORD_RERANK * F.col("rr")), 6)
    ranked = found.select("query_id", "id", F.round("sparse", 6).alias("sparse"), final.alias("final_score"))
    ranked = ranked.withColumn("rank", F.row_number().over(own.orderBy(F.desc("final_score"), F.desc("sparse"), "id"))).filter("rank <= 5")
    return ranked.select("query_id", "id", "final_score", F.concat(F.lit("sparse_match="), T.fixed(F.col("sparse"), 3), F.lit("; final_score="), T.fixed(F.col("final_score"), 3)).alias("reason"), "rank")


@query(
    """WITH c AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank_a, n FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey),
    d AS (SELECT s_nationkey, s_suppkey, rank_a, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, s_suppkey) AS rank_b FROM c)
    SELECT s_nationkey, s_suppkey, rank_a::INT AS rank_a, rank_b::INT AS rank_b, round(0.12 * (1.0 / (10 + rank_a) + 1.0 / (10 + rank_b)) / (2.0 / 11), 6) AS boost FROM d WHERE rank_a <= 32 AND rank_b <= 32"""
)
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of two rankings within each nation."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "supplier").join(sizes, F.col("s_suppkey") == F.col("l_suppkey"))
    ranked = lambda by: rows.select("s_nationkey", "s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc(by), "s_suppkey")).alias("rank"))
    return fused(ranked("s_acctbal"), ranked("n"), ["s_nationkey", "s_suppkey"])


def claimed(claims: DataFrame, asset: str, score: str, rank: str, index: str) -> DataFrame:
    """The claims with ``owner``: of an asset's claims the best score, then the lower rank, then the lower index.

    Owners come from an aggregation, so however many claim one asset, they are summed up before they meet.
    """
    best = claims.groupBy(asset).agg(F.max(F.struct(F.col(score), -F.col(rank), -F.col(index))).alias("_b"))
    mine = F.struct(F.col(score), -F.col(rank), -F.col(index)) == F.col("_b")
    return claims.join(best, asset).select(*claims.columns, mine.alias("owner"))


#: Fixed values of a claim's score: for the asset's own section, for shared words (each and at most), and what a rank takes off.
CLAIM_SECTION, CLAIM_WORD, CLAIM_WORDS, CLAIM_RANK = 1.0, 0.05, 0.35, 0.02


def claim_score(score: Column, same_section: Column, shared_words: Column, rank: Column) -> Column:
    return score + F.when(same_section, F.lit(CLAIM_SECTION)).otherwise(F.lit(0.0)) + F.least(F.lit(CLAIM_WORDS), shared_words * CLAIM_WORD) - rank * CLAIM_RANK


@query(
    """WITH s AS (SELECT p_partkey, p_type, p_size, round(p_retailprice / 2000 + CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE 0.0 END + least(0.35, (p_partkey % 9) * 0.05) - p_size * 0.02, 6) AS score FROM part), c AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_size, p_partkey) AS claim FROM s)
    SELECT p_partkey, p_type, score, claim = 1 AS owner FROM c"""
)
def claim_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One owner for what several claim, by the score of their claims."""
    score = F.round(claim_score(F.col("p_retailprice") / 2000, F.col("p_size") % 5 == 0, F.col("p_partkey") % 9, F.col("p_size")), 6)
    claims = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", score.alias("score"))
    return claimed(claims, "p_type", "score", "p_size", "p_partkey").select("p_partkey", "p_type", "score", "owner")


@query(
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS again FROM orders)
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey)::INT AS place FROM f WHERE again = 1"""
)
def priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs without repeated keys, in order of priority, time and number, in each queue."""
    first = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    jobs = table(spark, sf_dir, "orders").withColumn("again", F.row_number().over(first)).filter("again = 1")
    return jobs.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")).alias("place"))


@query(
    """WITH f AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    s AS (SELECT source, doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3 + (length(text) - length(replace(text, 'que', ''))) // 3)::BIGINT AS score FROM f WHERE n <= 24),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM s) SELECT source, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 4"""
)
def keyword_retriever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first 24 chunks of each file the four with most keywords."""
    first = table(spark, sf_dir, "documents").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("n <= 24")
    scored = first.select("source", "doc_id", (T.occurrences(F.col("text"), "the") + T.occurrences(F.col("text"), "que")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))).filter("rank <= 4")
