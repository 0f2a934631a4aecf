"""Retrieval of blocks and sections: scores, penalties that rows of one sample impose on each other, filters and scopes.

Candidates have ``query_id``, ``sample_id``, ``id``, ``path`` (titles joined by `` > ``), ``heading``, ``score``, ``tokens``, ``form`` and
``reasons``, an array of strings such as ``name`` or ``name=value``. Each pass is a window or an equi-join within a query's sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T
from ..functions.chunks import once
from ..registry import plain, query, shaped, table
from ..sources.shared import checkpointed
from . import ranking

#: Reasons that make a row a direct hit, a primary one, noise, a signal, or a weak ancestor.
INTENT = ("query_intent_heading_overlap", "leaf_query_intent_match")
PRIMARY = (*INTENT, "section_anchor_title_match")
DESCENDANT = (*INTENT, "heading_detail_overlap", "leaf_heading_detail_match", "section_anchor_title_match")
NOISE = ("non_requested_figure_section_penalty", "non_requested_support_section_penalty", "strict_query_intent_mismatch", "section_title_without_query_intent_penalty")
SIGNAL = ("query_intent_heading_overlap", "query_intent_overlap", "heading_detail_overlap", "leaf_heading_detail_match", "section_anchor_title_match")
WEAK = ("contextual_anchor_only_penalty", "broad_heading_without_heading_intent_penalty", "broad_heading_query_intent_context_penalty", "section_title_without_query_intent_penalty")
TITLE = ("section_anchor_title_match", "section_title_match")
#: Words of headings that stand for a whole solution, and forms of blocks that are details.
BROAD = ("系统方案", "systemsolution", "总体方案", "整体方案", "方案概述", "项目概述", "总体设计", "技术方案")
DETAIL_FORMS = ("formula", "parameter_table", "certificate")
#: A case's score: a query term (each and at most), a term in a title, many headings, and the share of a semantic score.
CASE_TERM, CASE_TERMS, CASE_TITLE, CASE_HEADINGS, CASE_SEMANTIC = 0.14, 0.7, 0.18, 0.05, 0.28
#: A neighbour's score: what it starts from, what a place of distance costs, and points by type, form and risk.
NEIGHBOUR, PER_PLACE = 0.38, 0.04
#: How near to the best a scope has to be, with and without direct support, and how many scopes there are.
SCOPE_NEAR, SCOPE_WIDE, SCOPES = 0.08, 0.10, 3
#: Queries that meet the cases at once, and parts in which a query's cases are ranked first.
QUERY_BLOCK, PARTS = 32, 64


def has(reasons: Column, *names: str) -> Column:
    """Whether some reason is one of the names, alone or with a value."""
    return F.exists(reasons, lambda r: F.substring_index(r, "=", 1).isin(*names))


def names_of(reasons: Column) -> Column:
    """The reasons without their values."""
    return F.transform(reasons, lambda r: F.substring_index(r, "=", 1))


def named(names: Column, *wanted: str) -> Column:
    """The same test as ``has`` on names that were taken out before."""
    return F.array_contains(names, wanted[0]) if len(wanted) == 1 else F.arrays_overlap(names, F.array(*map(F.lit, wanted)))


def segments(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, " > "), lambda x: F.trim(x)), lambda s: s != "")


def is_below(child: Column, parent: Column) -> Column:
    """Whether a path lies strictly below another, by whole titles."""
    return begins_with(segments(child), segments(parent))


def begins_with(b: Column, a: Column) -> Column:
    """Whether the segments b are those of a and more."""
    return (F.size(a) > 0) & (F.size(b) > F.size(a)) & (F.slice(b, F.lit(1), F.greatest(F.size(a), F.lit(1))) == a)


def is_broad(heading: Column, words: tuple[str, ...] = BROAD) -> Column:
    return F.lower(H.compact(heading)).rlike("|".join(rf"\Q{w}\E" for w in words)) if words else F.lit(False)


def case_score(terms: Column, text: Column, titles: Column, n_headings: Column, semantic: Column) -> Column:
    """Of a case by the query's terms in its text and titles, the number of its headings and a semantic score."""
    hits = once(F.lower(text), lambda low: F.size(F.filter(terms, lambda t: low.contains(F.lower(t)))))
    titled = F.exists(titles, lambda x: F.exists(terms, lambda t: F.lower(x).contains(F.lower(t))))
    return F.least(F.lit(CASE_TERMS), hits * CASE_TERM) + F.when(titled, F.lit(CASE_TITLE)).otherwise(F.lit(0.0)) + F.when(n_headings >= 20, F.lit(CASE_HEADINGS)).otherwise(F.lit(0.0)) + F.coalesce(semantic, F.lit(0.0)) * CASE_SEMANTIC


def neighbour_score(distance: Column, front: Column, low_risk: Column, same_type: Column, related: Column, unknown: Column, form_points: Column) -> Column:
    """Of a block near a hit: nearer is better, and so are its section type and form."""
    by_type = F.when(same_type, F.lit(0.22)).when(related, F.lit(0.1)).when(unknown, F.lit(-0.04)).otherwise(F.lit(-0.08))
    return F.greatest(F.lit(0.0), NEIGHBOUR - distance * PER_PLACE) - F.when(front, F.lit(0.18)).otherwise(F.lit(0.0)) + F.when(low_risk, F.lit(0.05)).otherwise(F.lit(0.0)) + by_type + form_points


def _primary(candidates: DataFrame) -> DataFrame:
    """Each candidate with ``best``: the best primary hit of its query and sample, null where there is none."""
    c = F.col
    one = F.when(has(c("reasons"), *PRIMARY) & ~has(c("reasons"), *NOISE), F.struct(c("score"), F.size(segments(c("path"))).alias("depth"), c("tokens"), (-c("id")).alias("order"), c("path"), c("reasons")))
    best = F.max(one).over(Window.partitionBy("query_id", "sample_id"))
    return candidates.withColumn("best", F.when(F.trim(c("sample_id")) != "", best))


def specific_hit_penalties(candidates: DataFrame) -> DataFrame:
    """Rows beside a sample's best primary hit lose by their kind of noise, more where that hit is a direct one."""
    rows, c = _primary(candidates), F.col
    r = c("reasons")
    other = c("best").isNotNull() & (c("id") != -c("best.order"))
    direct = has(c("best.reasons"), *INTENT)
    related = is_below(c("best.path"), c("path")) | is_below(c("path"), c("best.path"))
    far = direct & ~related
    points = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    figure, strict, untitled = has(r, NOISE[0]), has(r, NOISE[2]), has(r, NOISE[3])
    wrong_leaf = far & has(r, *TITLE) & untitled
    sidecar = far & has(r, "query_intent_mismatch_penalty") & c("form").isin(*DETAIL_FORMS)
    total = (
        points(figure, 0.18) + points(figure & direct, 0.04) + points(has(r, NOISE[1]), 0.18) + points(strict, 0.14) + points(strict & direct, 0.08)
        + points(untitled, 0.06) + points(untitled & has(r, *TITLE), 0.06) + points(wrong_leaf, 0.2) + points(sidecar, 0.18)
    )
    more = points(direct, 0.04) + points(c("score") + 0.02 >= c("best.score"), 0.02)
    penalty = F.when(other & (total > 0), F.least(F.lit(0.6), total + more)).otherwise(F.lit(0.0))
    added = F.array_compact(F.array(F.when(wrong_leaf, F.lit("title_aligned_wrong_leaf_penalty")), F.when(sidecar, F.lit("technical_detail_sidecar_penalty")), F.lit("specific_hit_tail_noise_penalty")))
    return rows.select(*(c(n) for n in candidates.columns if n not in ("score", "reasons")), F.round(c("score") - penalty, 6).alias("score"), F.when(penalty > 0, F.concat(r, added)).otherwise(r).alias("reasons"))


def ancestors_of(rows: DataFrame) -> DataFrame:
    """The rows once for each strict ancestor path: an equi-join takes the place of comparing all pairs of a sample."""
    s = segments(F.col("path"))
    above = F.when(F.size(s) > 1, F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda n: F.array_join(F.slice(s, F.lit(1), n), " > ")))
    return rows.withColumn("above", F.explode(above))


def broad_parent_penalties(candidates: DataFrame) -> DataFrame:
    """A broad heading above the best primary hit loses 0.14 where it has another clean, specific, signalled descendant that scores nearly as much."""
    rows, c = _primary(candidates.withColumn("_wide", is_broad(F.col("heading")))), F.col  # told once, before the windows
    r = c("reasons")
    below = ancestors_of(rows.filter(c("best").isNotNull() & (c("id") != -c("best.order")) & ~c("_wide") & ~has(r, *NOISE) & has(r, *SIGNAL)))
    most = below.groupBy("query_id", "sample_id", "above").agg(F.max("score").alias("most"))
    own_path = F.array_join(segments(c("path")), " > ")
    joined = rows.withColumn("above", own_path).join(most, ["query_id", "sample_id", "above"], "left")
    joined = joined.withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    hit = (c("_n") >= 3) & c("best").isNotNull() & c("_wide") & is_below(c("best.path"), c("path")) & (c("most") + 0.04 >= c("score"))
    hit = F.coalesce(hit, F.lit(False))
    return joined.select(*(c(n) for n in candidates.columns if n not in ("score", "reasons")), F.round(c("score") - F.when(hit, F.lit(0.14)).otherwise(F.lit(0.0)), 6).alias("score"), F.when(hit, F.concat(r, F.array(F.lit("broad_parent_secondary_context_penalty")))).otherwise(r).alias("reasons"))


def ancestor_penalties(candidates: DataFrame) -> DataFrame:
    """A broad or weak ancestor loses up to 0.42 where a descendant that matches directly scores nearly as much.

    Lower rows come first: a row that has lost may still count as a descendant of a higher one, with what it has left. One
    pass for each depth of paths, from the deepest up, each from a checkpoint, as it reads its rows twice.
    """
    c = F.col
    rows = checkpointed(candidates.withColumn("_depth", F.size(segments(c("path")))).withColumn("_own", F.array_join(segments(c("path")), " > ")).withColumn("_wide", is_broad(c("heading"))))
    deepest = rows.agg(F.max("_depth")).first()[0] or 0
    for depth in range(deepest - 1, 0, -1):
        r = c("reasons")
        below = ancestors_of(rows.filter((c("_depth") > depth) & has(r, *DESCENDANT))).filter(F.size(segments(c("above"))) == depth)
        best = below.groupBy("query_id", "sample_id", "above").agg(F.max(F.struct("score", "_depth", "tokens", (-c("id")).alias("order"), "reasons")).alias("b"))
        joined = rows.join(best.withColumnRenamed("above", "_own"), ["query_id", "sample_id", "_own"], "left")
        broad, leaf = c("_wide"), has(c("b.reasons"), *INTENT)
        hit = F.coalesce((c("_depth") == depth) & (broad | has(r, *WEAK)) & (c("b.score") + 0.06 >= c("score")), F.lit(False))
        redundant = broad & leaf & ~has(r, *INTENT, "heading_detail_overlap", "section_anchor_title_match")
        points = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
        penalty = 0.22 + points(leaf, 0.04) + points(c("b.score") >= c("score"), 0.02) + points(has(r, *WEAK[:2]), 0.02) + points(redundant, 0.12)
        added = F.array_compact(F.array(F.when(redundant, F.lit("broad_parent_direct_leaf_redundancy_penalty")), F.lit("ancestor_specific_hit_penalty")))
        score = F.round(c("score") - F.when(hit, F.least(F.lit(0.42), penalty)).otherwise(F.lit(0.0)), 6)
        rows = checkpointed(joined.select(*(c(n) for n in rows.columns if n not in ("score", "reasons")), score.alias("score"), F.when(hit, F.concat(r, added)).otherwise(r).alias("reasons")))
    return rows.select(*candidates.columns)


def without_tail(candidates: DataFrame) -> DataFrame:
    """Candidates without rows of little score that only penalties have left in the list."""
    r, s = F.col("reasons"), F.col("score")
    noise = has(r, "specific_hit_tail_noise_penalty") & ((s < 0.02) | ((s < 0.12) & has(r, NOISE[1], "technical_detail_sidecar_penalty")))
    low = (s >= 0.02) & (s < 0.12)
    broad = has(r, "broad_parent_competitive_specificity_penalty", "broad_parent_competitive_score_cap") & has(r, WEAK[0])
    figure = has(r, "specific_hit_tail_noise_penalty") & has(r, NOISE[0]) & has(r, "query_intent_mismatch_penalty") & ~has(r, "title_aligned_wrong_leaf_penalty", *TITLE, "title_overlap")
    return candidates.filter((s > 0) & ~noise & ~(low & (broad | figure)))


def in_scope(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks whose path begins with one of their query's scope paths (query_id, scope); queries without scopes keep all."""
    scopes = paths.groupBy("query_id").agg(F.collect_set("scope").alias("scopes"))  # a few a query
    joined = blocks.join(scopes, "query_id", "left")
    return joined.filter(F.col("scopes").isNull() | F.exists("scopes", lambda p: F.col("path").startswith(p))).drop("scopes")


def selected_scopes(sections: DataFrame, most: int = SCOPES) -> DataFrame:
    """(query_id, path, score, place): the best sections of each query near its best score, none above or below another.

    sections: (query_id, path, level, score, direct). Rows that lie on a chosen path drop out, so the next choice is the best
    of what is left: as many passes as there are scopes.
    """
    c = F.col
    of = Window.partitionBy("query_id")
    rows = sections.filter(F.trim("path") != "")
    kind = F.when(c("direct") & (c("level") >= 2), F.lit(2)).when(c("level") >= 2, F.lit(1)).otherwise(F.lit(0))
    rows = rows.withColumn("_kind", kind).withColumn("_most", F.max("_kind").over(of)).filter("_kind = _most")
    near = F.when(c("_kind") == 2, F.lit(SCOPE_NEAR)).otherwise(F.lit(SCOPE_WIDE))
    rows = rows.withColumn("_best", F.max("score").over(of)).filter(c("score") + near >= c("_best"))
    order = F.struct(c("score"), c("level"), F.length("path").alias("n"), c("path"))
    out = None
    for place in range(1, most + 1):
        best = rows.groupBy("query_id").agg(F.max(order).alias("_b")).select("query_id", c("_b.path").alias("chosen"), c("_b.score").alias("score"))
        one = best.select("query_id", c("chosen").alias("path"), "score", F.lit(place).alias("place"))
        out = one if out is None else out.unionByName(one)
        rows = rows.join(best.select("query_id", "chosen"), "query_id").filter(~((c("path") == c("chosen")) | is_below(c("path"), c("chosen")) | is_below(c("chosen"), c("path")))).drop("chosen")
    return out


def section_blocks(blocks: DataFrame, section: DataFrame, most: int = 32) -> DataFrame:
    """Blocks of a section (sample_id, section_id, path), by its id or at or below its path, in the order of pages and chunks."""
    joined = blocks.join(section.select("sample_id", F.col("section_id").alias("_id"), F.col("path").alias("_path")), "sample_id")
    found = joined.filter((F.col("section_id") == F.col("_id")) | (F.col("path") == F.col("_path")) | is_below(F.col("path"), F.col("_path")))
    order = Window.partitionBy("sample_id", "_id").orderBy("page", "chunk", "path", "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def section_search(sections: DataFrame, k: int) -> DataFrame:
    """The k best sections of each query by score, level and length of path, each (file, section) once."""
    best = Window.partitionBy("query_id", "file_name", "section_id").orderBy(F.desc("score"), F.desc("level"), F.desc(F.length("path")), "path")
    first = sections.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("level"), F.desc(F.length("path")), "path", "file_name", "section_id")
    return first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


_CANDIDATES = """SELECT p_partkey % 5 AS query_id, CASE WHEN p_partkey % 41 = 0 THEN '' ELSE 'f' || CAST(p_size AS STRING) END AS sample_id, p_partkey AS id,
    CASE p_partkey % 7 WHEN 0 THEN '系统方案' WHEN 1 THEN '系统方案 > 控制' WHEN 2 THEN '系统方案 > 控制 > 参数' WHEN 3 THEN '供货' WHEN 4 THEN '系统方案 > 电机' WHEN 5 THEN '供货 > 项目概述 > 清单' ELSE '供货 > 项目概述' END AS path,
    CASE p_partkey % 7 WHEN 0 THEN '1 系统方案' WHEN 6 THEN '项目概述' ELSE '控制' END AS heading, round((p_retailprice % 97) / 100, 4) AS score, p_size * 3 % 17 AS tokens, CASE p_partkey % 6 WHEN 0 THEN 'formula' WHEN 1 THEN 'certificate' ELSE 'narrative' END AS form,
    concat_ws(',', CASE p_partkey % 11 WHEN 0 THEN 'query_intent_heading_overlap=a' WHEN 1 THEN 'leaf_query_intent_match' WHEN 2 THEN 'section_anchor_title_match' WHEN 3 THEN 'heading_detail_overlap' WHEN 4 THEN 'query_intent_overlap=b' WHEN 5 THEN 'contextual_anchor_only_penalty' ELSE 'x' END,
      CASE p_partkey % 13 WHEN 0 THEN 'non_requested_figure_section_penalty' WHEN 1 THEN 'strict_query_intent_mismatch=c' WHEN 2 THEN 'section_title_without_query_intent_penalty' WHEN 3 THEN 'non_requested_support_section_penalty' WHEN 4 THEN 'query_intent_mismatch_penalty' ELSE 'y' END, CASE WHEN p_size % 3 = 0 THEN 'query_intent_mismatch_penalty' ELSE 'section_title_match' END) AS reason_list FROM {part}"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, _CANDIDATES).withColumn("reasons", F.split("reason_list", ",")).drop("reason_list")


_HAS = lambda r, *names: f"len(list_filter({r}, lambda x: string_split(x, '=')[1] IN ({', '.join(repr(n) for n in names)}))) > 0"
_BELOW = lambda child, parent: f"(len({parent}) > 0 AND len({child}) > len({parent}) AND list_slice({child}, 1, len({parent})) = {parent})"
_IS_BROAD = "(contains(lower(regexp_replace(heading, '^[0-9] ', '')), '系统方案') OR contains(heading, '项目概述'))"
_SQL_BEST = f"""c AS (SELECT *, string_split(reason_list, ',') AS reasons, list_filter(string_split(path, ' > '), lambda s: s <> '') AS seg FROM ({plain(_CANDIDATES)})),
    p AS (SELECT query_id, sample_id, max({{'score': score, 'depth': len(seg), 'tokens': tokens, 'ord': -id, 'seg': seg, 'reasons': reasons}}) FILTER (WHERE {_HAS('reasons', *PRIMARY)} AND NOT ({_HAS('reasons', *NOISE)})) AS best FROM c WHERE trim(sample_id) <> '' GROUP BY 1, 2),
    j AS (SELECT c.*, p.best FROM c LEFT JOIN p ON c.query_id = p.query_id AND c.sample_id = p.sample_id AND p.best IS NOT NULL)"""
_PTS = lambda test, value: f"CASE WHEN {test} THEN {value} ELSE 0 END::DOUBLE"


@query(
    f"""WITH {_SQL_BEST}, k AS (SELECT *, coalesce(best IS NOT NULL AND id <> -best.ord, FALSE) AS other, {_HAS('best.reasons', *INTENT)} AS direct, {_BELOW('best.seg', 'seg')} OR {_BELOW('seg', 'best.seg')} AS related FROM j),
    l AS (SELECT *, direct AND NOT related AS far, {_HAS('reasons', NOISE[0])} AS fig, {_HAS('reasons', NOISE[1])} AS sup, {_HAS('reasons', NOISE[2])} AS strict, {_HAS('reasons', NOISE[3])} AS untitled, {_HAS('reasons', *TITLE)} AS titled, {_HAS('reasons', 'query_intent_mismatch_penalty')} AS mis FROM k),
    m AS (SELECT *, far AND titled AND untitled AS wrong, far AND mis AND form IN {DETAIL_FORMS!r} AS side FROM l),
    n AS (SELECT *, {_PTS('fig', 0.18)} + {_PTS('fig AND direct', 0.04)} + {_PTS('sup', 0.18)} + {_PTS('strict', 0.14)} + {_PTS('strict AND direct', 0.08)} + {_PTS('untitled', 0.06)} + {_PTS('untitled AND titled', 0.06)} + {_PTS('wrong', 0.2)} + {_PTS('side', 0.18)} AS total FROM m),
    o AS (SELECT *, CASE WHEN other AND total > 0 THEN least(0.6, total + ({_PTS('direct', 0.04)} + {_PTS('score + 0.02 >= best.score', 0.02)})) ELSE 0 END::DOUBLE AS penalty FROM n)
    SELECT id, round(score - penalty, 6) AS score, array_to_string(CASE WHEN penalty > 0 THEN reasons || list_filter([CASE WHEN wrong THEN 'title_aligned_wrong_leaf_penalty' END, CASE WHEN side THEN 'technical_detail_sidecar_penalty' END, 'specific_hit_tail_noise_penalty'], lambda x: x IS NOT NULL) ELSE reasons END, ',') AS reasons FROM o"""
)
def tail_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates after the penalties that a sample's best direct hit brings on the others."""
    return specific_hit_penalties(_candidates(spark, sf_dir)).select("id", "score", F.concat_ws(",", "reasons").alias("reasons"))


@query(
    f"""WITH {_SQL_BEST}, b AS (SELECT *, {_IS_BROAD} AS broad, count(*) OVER (PARTITION BY query_id) AS n FROM j), d AS (SELECT query_id, sample_id, seg, score FROM b WHERE best IS NOT NULL AND id <> -best.ord AND NOT broad AND NOT ({_HAS('reasons', *NOISE)}) AND {_HAS('reasons', *SIGNAL)}),
    h AS (SELECT b.*, coalesce(n >= 3 AND best IS NOT NULL AND broad AND {_BELOW('best.seg', 'seg')} AND EXISTS (SELECT 1 FROM d WHERE d.query_id = b.query_id AND d.sample_id = b.sample_id AND {_BELOW('d.seg', 'b.seg')} AND d.score + 0.04 >= b.score), FALSE) AS hit FROM b)
    SELECT id, round(score - CASE WHEN hit THEN 0.14 ELSE 0 END::DOUBLE, 6) AS score, hit FROM h"""
)
def broad_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broad headings that lose to other descendants of theirs."""
    found = broad_parent_penalties(_candidates(spark, sf_dir))
    return found.select("id", "score", has(F.col("reasons"), "broad_parent_secondary_context_penalty").alias("hit"))


_LEVEL = lambda of, depth, name: f"""{name}b AS (SELECT a.id, max({{'score': d.score, 'depth': len(d.seg), 'tokens': d.tokens, 'ord': -d.id, 'reasons': d.reasons}}) AS b FROM {of} a JOIN {of} d ON a.query_id = d.query_id AND a.sample_id = d.sample_id AND len(a.seg) = {depth} AND {_BELOW('d.seg', 'a.seg')} AND {_HAS('d.reasons', *DESCENDANT)} GROUP BY 1),
    {name}c AS (SELECT a.*, b, coalesce(len(seg) = {depth} AND (broad OR {_HAS('a.reasons', *WEAK)}) AND b.score + 0.06 >= a.score, FALSE) AS hit, {_HAS('b.reasons', *INTENT)} AS leaf FROM {of} a LEFT JOIN {name}b USING (id)),
    {name}d AS (SELECT *, broad AND leaf AND NOT ({_HAS('reasons', *INTENT, 'heading_detail_overlap', 'section_anchor_title_match')}) AS redundant FROM {name}c),
    {name} AS (SELECT query_id, sample_id, id, seg, broad, tokens, CASE WHEN hit THEN round(score - least(0.42, 0.22 + {_PTS('leaf', 0.04)} + {_PTS('b.score >= score', 0.02)} + {_PTS(_HAS('reasons', *WEAK[:2]), 0.02)} + {_PTS('redundant', 0.12)}), 6) ELSE round(score, 6) END AS score, CASE WHEN hit THEN reasons || list_filter([CASE WHEN redundant THEN 'broad_parent_direct_leaf_redundancy_penalty' END, 'ancestor_specific_hit_penalty'], lambda x: x IS NOT NULL) ELSE reasons END AS reasons FROM {name}d)"""  # noqa: E731


@query(
    f"""WITH c AS (SELECT *, string_split(reason_list, ',') AS reasons, list_filter(string_split(path, ' > '), lambda s: s <> '') AS seg, {_IS_BROAD} AS broad FROM ({plain(_CANDIDATES)})), {_LEVEL('c', 2, 'y')}, {_LEVEL('y', 1, 'z')} SELECT id, score, array_to_string(reasons, ',') AS reasons FROM z"""
)
def ancestor_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broad or weak ancestors that lose to a descendant that matches directly."""
    return ancestor_penalties(_candidates(spark, sf_dir)).select("id", "score", F.concat_ws(",", "reasons").alias("reasons"))


@query(
    f"""WITH {_SQL_BEST}, m AS (SELECT id, score - 0.5 * (id % 3 = 0)::INT AS score, CASE WHEN id % 2 = 0 THEN list_append(reasons, 'specific_hit_tail_noise_penalty') ELSE reasons END AS r FROM c), f AS (SELECT *, {_HAS('r', 'specific_hit_tail_noise_penalty')} AS tail FROM m)
    SELECT id FROM f WHERE score > 0 AND NOT (tail AND (score < 0.02 OR (score < 0.12 AND {_HAS('r', NOISE[1], 'technical_detail_sidecar_penalty')})))
      AND NOT (score >= 0.02 AND score < 0.12 AND (({_HAS('r', 'broad_parent_competitive_specificity_penalty', 'broad_parent_competitive_score_cap')} AND {_HAS('r', WEAK[0])}) OR (tail AND {_HAS('r', NOISE[0])} AND {_HAS('r', 'query_intent_mismatch_penalty')} AND NOT ({_HAS('r', 'title_aligned_wrong_leaf_penalty', *TITLE, 'title_overlap')}))))"""
)
def tail_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that the filters of low scores leave."""
    rows = _candidates(spark, sf_dir)
    lowered = rows.withColumn("score", F.col("score") - 0.5 * (F.col("id") % 3 == 0).cast("int"))
    marked = lowered.withColumn("reasons", F.when(F.col("id") % 2 == 0, F.concat("reasons", F.array(F.lit("specific_hit_tail_noise_penalty")))).otherwise(F.col("reasons")))
    return without_tail(marked).select("id")


_SCOPED = f"SELECT query_id, path || ' > ' || CAST(id % 19 AS STRING) AS path, CAST(1 + id % 3 AS INT) AS level, score, id % 4 = 0 AS direct FROM ({_CANDIDATES})"


@query(
    f"""WITH RECURSIVE s AS (SELECT *, CASE WHEN direct AND level >= 2 THEN 2 WHEN level >= 2 THEN 1 ELSE 0 END AS kind, list_filter(string_split(path, ' > '), lambda s: s <> '') AS seg FROM ({plain(_SCOPED)})), t AS (SELECT *, max(kind) OVER (PARTITION BY query_id) AS top FROM s), u AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM t WHERE kind = top),
    v AS (SELECT query_id, path, level, score, seg, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, level DESC, length(path) DESC, path DESC) AS k FROM u WHERE score + CASE kind WHEN 2 THEN 0.08 ELSE 0.10 END::DOUBLE >= best),
    w AS (SELECT query_id, 0 AS k, []::VARCHAR[][] AS chosen, ''::VARCHAR AS path, 0.0::DOUBLE AS score, FALSE AS taken FROM (SELECT DISTINCT query_id FROM v)
      UNION ALL SELECT w.query_id, v.k, CASE WHEN ok THEN list_append(chosen, v.seg) ELSE chosen END, v.path, v.score, ok FROM w JOIN (SELECT * FROM v) v ON v.query_id = w.query_id AND v.k = w.k + 1, LATERAL (SELECT len(chosen) < 3 AND len(list_filter(chosen, lambda c: c = v.seg OR {_BELOW('v.seg', 'c')} OR {_BELOW('c', 'v.seg')})) = 0 AS ok))
    SELECT query_id, path, score, len(chosen)::INT AS place FROM w WHERE taken"""
)
def scope_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three sections of each query within which blocks are looked for."""
    return selected_scopes(shaped(spark, sf_dir, _SCOPED))


@query(
    f"""WITH c AS ({plain(_CANDIDATES)}), s AS (SELECT query_id, sample_id AS file_name, path AS section_id, path, score, tokens AS level FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_name, section_id ORDER BY score DESC, level DESC, length(path) DESC, path) AS n FROM s),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, level DESC, length(path) DESC, path, file_name, section_id) AS place FROM r WHERE n = 1) SELECT query_id, file_name, path, score, place::INT AS place FROM o WHERE place <= 12"""
)
def section_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best sections of each query."""
    rows = _candidates(spark, sf_dir).select("query_id", F.col("sample_id").alias("file_name"), F.col("path").alias("section_id"), "path", "score", F.col("tokens").alias("level"))
    return section_search(rows, 12).select("query_id", "file_name", "path", "score", "place")


@query(
    f"""WITH c AS (SELECT *, list_filter(string_split(path, ' > '), lambda s: s <> '') AS seg FROM ({plain(_CANDIDATES)})), s AS (SELECT DISTINCT sample_id, '系统方案 > 控制' AS sp FROM c WHERE sample_id <> ''), f AS (SELECT c.*, row_number() OVER (PARTITION BY c.sample_id ORDER BY tokens, id % 5, path, id) AS place FROM c JOIN s USING (sample_id) WHERE path = sp OR {_BELOW('seg', "string_split(sp, ' > ')")})
    SELECT sample_id, id, place::INT AS place FROM f WHERE place <= 8"""
)
def blocks_of_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first blocks of a section in each sample, at or below its path."""
    rows = _candidates(spark, sf_dir).select("sample_id", "id", "path", F.lit("").alias("section_id"), F.col("tokens").alias("page"), (F.col("id") % 5).alias("chunk"))
    wanted = rows.filter("sample_id <> ''").select("sample_id").distinct().select("sample_id", F.lit("系统方案 > 控制").alias("path"), F.lit("s").alias("section_id"))
    return section_blocks(rows, wanted, 8).select("sample_id", "id", "place")


def case_search(cases: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, case_id, score, place): the k best cases (case_id, text, titles, n_headings) of each query (query_id, terms), equal texts once.

    Queries are a stated set. They meet the cases in blocks of QUERY_BLOCK, whose terms are part of the plan, so no side is broadcast;
    every case is scored for every query, and a query's best of each part go on to its last ranking.
    """
    c = F.col
    out = None
    for block in ranking.query_blocks(queries.select("query_id", "terms"), QUERY_BLOCK):
        kind = queries.schema["query_id"].dataType
        asked = F.array(*(F.struct(F.lit(r["query_id"]).cast(kind).alias("query_id"), F.array(*map(F.lit, r["terms"])).cast("array<string>").alias("terms")) for r in block.to_pylist()))
        pairs = cases.withColumn("_q", F.explode(asked))
        scored = pairs.select(c("_q.query_id").alias("query_id"), "case_id", F.xxhash64("text").alias("_print"), F.sha2("text", 256).alias("_text"), F.round(case_score(c("_q.terms"), c("text"), c("titles"), c("n_headings"), F.lit(0.0)), 6).alias("score")).filter("score > 0")
        part = Window.partitionBy("query_id", F.pmod("_print", F.lit(PARTS)))
        first = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_text").orderBy(F.desc("score"), "case_id"))).filter("_n = 1")
        best = first.withColumn("_n", F.row_number().over(part.orderBy(F.desc("score"), "case_id"))).filter(c("_n") <= k)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return queries.select("query_id", F.lit(None).alias("case_id"), F.lit(0.0).alias("score"), F.lit(0).alias("place")).limit(0)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "case_id"))
    return out.withColumn("place", place).filter(c("place") <= k).select("query_id", "case_id", "score", "place")


@query(
    f"""WITH d AS (SELECT doc_id, text, lower(text) AS t, list_slice(string_split(lower(text), chr(10)), 1, 3) AS titles, len(string_split(text, chr(10))) AS n FROM documents), q AS (SELECT item_id, list_distinct({T.sql_tokens("text")}) AS w FROM benchmark WHERE item_id % 50 = 0),
    s AS (SELECT item_id, doc_id, text, round(least(0.7::DOUBLE, len(list_filter(w, lambda x: contains(t, x))) * 0.14::DOUBLE) + CASE WHEN len(list_filter(titles, lambda y: len(list_filter(w, lambda x: contains(y, x))) > 0)) > 0 THEN 0.18 ELSE 0 END::DOUBLE + CASE WHEN n >= 20 THEN 0.05 ELSE 0 END::DOUBLE, 6) AS score FROM d, q),
    u AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS one FROM s WHERE score > 0) SELECT item_id, doc_id, score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM u WHERE one = 1) WHERE place <= 12"""
)
def case_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best documents as cases for each query of the stated set, by all of its terms, equal texts once."""
    asked = table(spark, sf_dir, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.array_distinct(T.tokens(F.col("text"))).alias("terms"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text", F.slice(F.split("text", "\n"), 1, 3).alias("titles"), F.size(F.split("text", "\n")).alias("n_headings"))
    return case_search(docs, asked, 12).withColumnsRenamed({"query_id": "item_id", "case_id": "doc_id"})
