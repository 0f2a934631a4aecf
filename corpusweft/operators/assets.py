"""Figures and tables of documents: how they relate to sections, what they score, which are usable."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import scores as S
from ..registry import plain, query, shaped, table
from . import ranking

#: What a keyword adds and at most; points for section and equipment types; for headings of a type's focus or noise.
WORD, WORDS_MOST = 0.06, 0.24
SAME_TYPE, RELATED_TYPE, UNKNOWN_TYPE, EQUIPMENT = 0.22, 0.12, -0.06, 0.1
FOCUS, NOISE = 0.14, -0.22
#: Points for an anchor's sample, the relation to its section, its document, and the same heading.
SAMPLE, RELATIONS, DOCUMENT, SAME_HEADING = 0.28, {"exact": 0.42, "descendant": 0.36, "ancestor": 0.22}, 0.18, 0.14
#: Bonus of a promoted asset by its relation.
PROMOTION = {"exact": 0.22, "descendant": 0.2, "ancestor": 0.12, "heading_family": 0.1}
#: Shares of textual, visual and structural scores with and without a visual one, and penalties by risk.
WITH_VISUAL, WITHOUT_VISUAL, RISK = (0.60, 0.30, 0.10), (0.90, 0.0, 0.10), {"high": 0.08, "medium": 0.03}
#: Penalties by what is wrong with an asset.
PENALTIES = {"low_information": 0.72, "summary_review_required": 0.14, "low_confidence_summary": 0.1, "audit_review_pending": 0.18, "low_quality_score": 0.16}
PARTIAL, PAGE_FURNITURE, FRAGMENT, CERTIFICATE = 0.22, 0.32, 1.0, 0.22
UNUSABLE_ROLES = ("page_furniture", "asset_fragment", "text_fragment")


def keyword_boost(asked: Column, text: Column) -> Column:
    """For each different keyword of what is asked, and for all of it, that the text holds."""
    words = F.regexp_extract_all(F.lower(asked), F.lit("[a-z0-9_+-]{2,}|[一-鿿]{2,}"), 0)
    every = F.array_distinct(F.filter(F.concat(words, F.array(F.lower(F.trim(asked)))), lambda w: w != ""))
    return F.least(F.lit(WORDS_MOST), F.size(F.filter(every, lambda w: F.lower(text).contains(w))) * WORD)


def type_boost(section: Column, equipment: Column, target_section: Column, target_equipment: Column, related: Column) -> Column:
    """By the asset's section and equipment types against those looked for; related: an array of section types."""
    a = F.when((target_section != "unknown") & (section == target_section), F.lit(SAME_TYPE)).when(F.array_contains(related, section), F.lit(RELATED_TYPE)).when(~target_section.isin("unknown", "overall_solution") & (section == "unknown"), F.lit(UNKNOWN_TYPE)).otherwise(F.lit(0.0))
    b = F.when((target_equipment != "generic") & (equipment == target_equipment), F.lit(EQUIPMENT)).when((target_equipment != "generic") & (equipment != "generic"), F.lit(-EQUIPMENT)).otherwise(F.lit(0.0))
    return a + b


def heading_focus(heading: Column, focus: list[str], noise: list[str]) -> Column:
    """Points for a heading that holds words a section type is about, less those for words it is not about."""
    close = F.regexp_replace(F.lower(heading), r"\s+", "")
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)) if words else F.array().cast("array<string>"), lambda w: F.lower(heading).contains(F.lower(w)) | close.contains(F.replace(F.lower(w), F.lit(" "), F.lit(""))))
    return F.when(any_of(focus), F.lit(FOCUS)).otherwise(F.lit(0.0)) + F.when(any_of(noise), F.lit(NOISE)).otherwise(F.lit(0.0))


def section_id(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"\s+", "")


def section_relation(candidate: Column, anchor: Column) -> Column:
    """exact, descendant or ancestor, of section ids such as 3.2.1; null for none."""
    a, b = section_id(candidate), section_id(anchor)
    under = lambda child, parent: child.startswith(parent) & F.substr(child, F.length(parent) + 1, F.lit(1)).isin(".", "-", "/", ">", "_")
    some = (a != "") & (b != "")
    return F.when(some & (a == b), F.lit("exact")).when(some & under(a, b), F.lit("descendant")).when(some & under(b, a), F.lit("ancestor"))


def _best(found: Column) -> Column:
    rank = lambda r: F.when(r == "exact", F.lit(3)).when(r == "descendant", F.lit(2)).otherwise(F.lit(1))
    named = F.transform(F.filter(found, lambda r: r.isNotNull()), lambda r: F.struct(rank(r).alias("rank"), r.alias("relation")))
    return F.array_max(named)["relation"]


def best_section_relation(candidate: Column, anchors: Column) -> Column:
    """The closest relation to any of an array of section ids."""
    return _best(F.transform(anchors, lambda a: section_relation(candidate, a)))


def heading_number(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(F.trim(heading), r"^([0-9]+(?:[.\-_/、][0-9]+)*)", 1), "[、_/]+", "."), r"^\.+|\.+$", "")


def best_heading_relation(candidate: Column, anchors: Column) -> Column:
    """The closest relation of headings by their numbers, or heading_family where only the first two numbers agree."""
    own = heading_number(candidate)
    one = lambda a: F.coalesce(section_relation(own, heading_number(a)), F.when(H.family_similarity(a, candidate) >= H.FAMILY_CLOSE, F.lit("heading_family")))
    return _best(F.transform(F.filter(anchors, lambda a: F.trim(a) != ""), one))


def anchor_boost(sample: Column, section: Column, document: Column, heading: Column, anchors: dict[str, Column]) -> Column:
    """anchors: arrays of ``samples``, ``sections``, ``documents`` and ``headings`` that evidence points to."""
    relation = best_section_relation(section, anchors["sections"])
    by_section = sum((F.when(relation == name, F.lit(points)).otherwise(F.lit(0.0)) for name, points in RELATIONS.items()), F.lit(0.0))
    families = F.coalesce(F.array_max(F.transform(anchors["headings"], lambda a: H.family_similarity(a, heading))), F.lit(0.0))
    return (
        F.when((sample != "") & F.array_contains(anchors["samples"], sample), F.lit(SAMPLE)).otherwise(F.lit(0.0))
        + by_section
        + F.when(F.array_contains(anchors["documents"], document), F.lit(DOCUMENT)).otherwise(F.lit(0.0))
        + F.when(F.trim(heading) != "", families + F.when(F.array_contains(anchors["headings"], heading), F.lit(SAME_HEADING)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
    )


def noise_penalty(flags: Column, role: Column, text: Column, certificate_words: list[str]) -> Column:
    """flags: an array of quality flags; text: titles and captions."""
    has = lambda name: F.array_contains(flags, name)
    own = sum((F.when(has(n), F.lit(p)).otherwise(F.lit(0.0)) for n, p in PENALTIES.items()), F.lit(0.0))
    partial = F.when(has("partial_fragment") & ~has("low_information"), F.lit(PARTIAL)).otherwise(F.lit(0.0))
    by_role = F.when(role == "page_furniture", F.lit(PAGE_FURNITURE)).when(role == "asset_fragment", F.lit(FRAGMENT)).otherwise(F.lit(0.0))
    close = F.regexp_replace(F.lower(text), r"\s+", "")
    papers = F.exists(F.array(*map(F.lit, certificate_words)), lambda w: F.lower(text).contains(w) | close.contains(F.replace(w, F.lit(" "), F.lit(""))))
    return own + partial + by_role + F.when(papers, F.lit(CERTIFICATE)).otherwise(F.lit(0.0))


def asset_score(textual: Column, visual: Column, structural: Column, risk: Column, penalty: Column) -> Column:
    """struct<branch, textual, visual, structural, penalty, final>; a null visual score leaves the visual branch out."""
    off = visual.isNull()
    by_risk = sum((F.when(risk == n, F.lit(p)).otherwise(F.lit(0.0)) for n, p in RISK.items()), F.lit(0.0))
    weights = [F.when(off, F.lit(b)).otherwise(F.lit(a)) for a, b in zip(WITH_VISUAL, WITHOUT_VISUAL)]
    final = textual * weights[0] + F.coalesce(visual, F.lit(0.0)) * weights[1] + structural * weights[2] - (by_risk + penalty)
    parts = {"textual": textual, "visual": F.coalesce(visual, F.lit(0.0)), "structural": structural, "penalty": by_risk + penalty, "final": final}
    return F.struct(F.when(off, F.lit("textual_only")).otherwise(F.lit("textual+visual")).alias("branch"), *((F.round(v, 4) + F.lit(0.0)).alias(n) for n, v in parts.items()))


def is_unusable(kind: Column, role: Column, audit: Column, fallback: Column, preserved: Column, has_structure: Column) -> Column:
    """Whether an asset is left out of every search: rejected, a fragment or furniture, not preserved, or a table without structure."""
    figure = (kind == "figure") & (fallback | role.isin(*UNUSABLE_ROLES) | (F.coalesce(preserved, F.lit(True)) == F.lit(False)))
    return (F.lower(F.trim(audit)) == "rejected") | figure | ((kind == "table") & fallback & ~has_structure)


def source_binding(fields: dict[str, Column]) -> Column:
    """struct<missing, tier> of sample_id, raw_document_id, source_section_id, heading_path and page_no."""
    has = {n: c.isNotNull() & (F.trim(c.cast("string")) != "") for n, c in fields.items()}
    missing = F.array_compact(F.array(*(F.when(~ok, F.lit(n)) for n, ok in has.items())))
    document = has["sample_id"] | has["raw_document_id"]
    high = document & has["source_section_id"] & has["heading_path"] & has["page_no"]
    tier = F.when(high, F.lit("high")).when(document & (has["heading_path"] | has["page_no"]), F.lit("medium")).otherwise(F.lit("low"))
    return F.struct(missing.alias("missing"), tier.alias("tier"))


def quality_gate(kind: Column, role: Column, preserved: Column, review: Column, has_bytes: Column, table_lost: Column, confidence: Column, least: float) -> Column:
    """struct<status, score, reasons>: the worst status and the least score of all that is wrong with an asset."""
    figure, is_table = kind == "figure", kind == "table"
    bad = role.isin(*UNUSABLE_ROLES)
    findings = [
        (preserved == F.lit(False), 2, 0.05, F.lit("not_preserved_for_vector_db")),
        (review, 1, 0.62, F.lit("asset_marked_for_review")),
        (figure & ~has_bytes, 2, 0.08, F.lit("figure_without_image_bytes")),
        (figure & bad, 2, 0.08, F.concat(F.lit("visual_role:"), role)),
        (figure & (role == "product_photo"), 1, 0.46, F.lit("product_photo_needs_section_specific_use")),
        (figure & (role == "layout_drawing"), 1, 0.58, F.lit("layout_drawing_needs_section_specific_use")),
        (is_table & table_lost, 2, 0.12, F.lit("table_storage_fallback_without_structure")),
        (is_table & ~table_lost, 1, 0.66, F.lit("table_requires_reconstruction_or_review")),
        (confidence.isNotNull() & (confidence > 0) & (confidence < least), 1, 0.62, F.lit("llm_asset_review_low_confidence")),
    ]
    status = F.greatest(F.lit(0), *(F.when(c, F.lit(s)).otherwise(F.lit(0)) for c, s, _, _ in findings))
    score = F.least(F.lit(0.86), *(F.when(c, F.lit(v)).otherwise(F.lit(1.0)) for c, _, v, _ in findings))
    reasons = F.array_compact(F.array(*(F.when(c, r) for c, _, _, r in findings)))
    return F.struct(F.element_at(F.array(F.lit("review_passed"), F.lit("review_pending"), F.lit("rejected")), status + 1).alias("status"), F.round(score, 4).alias("score"), reasons.alias("reasons"))


def promoted(scored: DataFrame, relation: Column) -> DataFrame:
    """The scored assets (query_id, score, ...) that stand in a relation, with their bonus, in the new order."""
    bonus = sum((F.when(relation == n, F.lit(p)).otherwise(F.lit(0.0)) for n, p in PROMOTION.items()), F.lit(0.0))
    found = scored.withColumn("relation", relation).filter(F.col("relation").isin(*PROMOTION)).withColumn("final", F.round(F.col("score") + bonus, 6))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "id")))


def best_channels(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, channel, score): the k best points of each channel, and of points found in several the best channel.

    points: (id, channel, vector); queries: (query_id, channel, vector) with the channel whose vectors they meet.
    """
    channels = [r[0] for r in queries.select("channel").distinct().collect()]  # a handful
    found = None
    for channel in sorted(channels):
        hits = ranking.dense_top_k(points.filter(F.col("channel") == channel).select("id", "vector"), queries.filter(F.col("channel") == channel).select("query_id", "vector"), k).select("query_id", "id", F.lit(channel).alias("channel"), "score")
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("query_id", "id").agg(F.max(F.struct("score", "channel")).alias("b"))
    return best.select("query_id", "id", "b.channel", "b.score")


_ASSETS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'table' ELSE 'figure' END AS kind, CASE p_size % 9 WHEN 0 THEN 'page_furniture' WHEN 1 THEN 'asset_fragment' WHEN 2 THEN 'product_photo' WHEN 3 THEN 'layout_drawing' ELSE 'engineering_figure' END AS role,
    CASE WHEN p_partkey % 23 = 0 THEN 'rejected' WHEN p_partkey % 7 = 0 THEN 'review_pending' ELSE 'passed' END AS audit, p_partkey % 11 = 0 AS fallback, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 17 > 0 END AS preserved, p_size % 2 = 0 AS structured, p_size % 5 > 0 AS has_bytes, p_partkey % 6 = 0 AS review,
    CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size / 50.0 END AS confidence, lower(p_type) AS section_type, CASE WHEN p_size % 8 = 0 THEN 'generic' ELSE lower(p_brand) END AS equipment_type, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 's' || CAST(p_size % 6 AS STRING) END AS sample,
    CAST(p_size % 5 AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN '.' || CAST(p_partkey % 4 AS STRING) ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN '.1' ELSE '' END AS section, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE CAST(p_size % 4 AS STRING) || '.' || CAST(p_partkey % 3 AS STRING) || ' ' || p_name END AS heading,
    'doc' || CAST(p_size % 12 AS STRING) AS document, p_name || ' ' || lower(p_type) AS text, CASE p_partkey % 5 WHEN 0 THEN 'low_information' WHEN 1 THEN 'partial_fragment,low_quality_score' WHEN 2 THEN 'audit_review_pending' ELSE '' END AS flags, CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk,
    CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice / 2048.0 END AS visual, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS page_no FROM {part}"""
_SECTIONS, _HEADS = ["2", "3.1", "4.2.1"], ["1.2 red bolt", "2.1 small ring", "3 x"]
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_ARRAY = lambda values: F.array(*map(F.lit, values))


def _sql_relation(a: str, b: str) -> str:
    under = lambda c, p: f"(starts_with({c}, {p}) AND substr({c}, length({p}) + 1, 1) IN ('.', '-', '/', '>', '_'))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN NULL WHEN {a} = {b} THEN 3 WHEN {under(a, b)} THEN 2 WHEN {under(b, a)} THEN 1 END"


_FAMILY_OF = r"CASE WHEN regexp_matches({0}, '^\s*[0-9]') THEN string_split(regexp_extract({0}, '^\s*([0-9]+(?:\.[0-9]+)*)', 1), '.') ELSE []::VARCHAR[] END"


def _sql_family(a: str, b: str) -> str:
    x, y = _FAMILY_OF.format(a), _FAMILY_OF.format(b)
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 AND ({x})[1] = ({y})[1] THEN CASE WHEN len({x}) >= 2 AND len({y}) >= 2 AND list_slice({x}, 1, 2) = list_slice({y}, 1, 2) THEN 0.2 ELSE 0.12 END ELSE 0.0 END"


_NUMBER_OF = r"regexp_extract({0}, '^([0-9]+(?:[.\-_/、][0-9]+)*)', 1)"
_SQL_HEADING = f"coalesce({_sql_relation(_NUMBER_OF.format('heading'), _NUMBER_OF.format('x'))}, CASE WHEN {_sql_family('x', 'heading')} >= 0.2 THEN 0 END)"


@query(
    f"""WITH a AS ({plain(_ASSETS)}) SELECT id, CASE list_max(list_transform({_LIST(_SECTIONS)}, lambda x: {_sql_relation("section", "x")})) WHEN 3 THEN 'exact' WHEN 2 THEN 'descendant' WHEN 1 THEN 'ancestor' END AS by_section,
    CASE greatest(coalesce(list_max(list_transform({_LIST(_HEADS)}, lambda x: CASE {_SQL_HEADING} WHEN 0 THEN 1 ELSE {_SQL_HEADING} END)), -1), -1) WHEN 3 THEN 'exact' WHEN 2 THEN 'descendant' WHEN 1 THEN CASE WHEN list_contains(list_transform({_LIST(_HEADS)}, lambda x: {_SQL_HEADING}), 0) THEN 'heading_family' ELSE 'ancestor' END END AS by_heading FROM a"""
)
def section_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each asset's section and heading relate to those that evidence points to."""
    rows = shaped(spark, sf_dir, _ASSETS)
    return rows.select("id", best_section_relation(F.col("section"), _ARRAY(_SECTIONS)).alias("by_section"), best_heading_relation(F.col("heading"), _ARRAY(_HEADS)).alias("by_heading"))


_WORDS = "polished small ring, bolt"
_PAPERS = ["certificate", "test report", "old bolt"]
_SQL_SCORES = f"""a AS ({plain(_ASSETS)}), b AS (SELECT *, list_filter(list_distinct(regexp_extract_all('{_WORDS}', '[a-z0-9_+-]{{2,}}|[一-鿿]{{2,}}') || ['{_WORDS}']), lambda w: contains(text, w)) AS hits, list_max(list_transform({_LIST(_SECTIONS)}, lambda x: {_sql_relation("section", "x")})) AS rel,
      list_max(list_transform({_LIST(_HEADS)}, lambda x: {_sql_family("x", "heading")})) AS fam, string_split(flags, ',') AS fl FROM a),
    c AS (SELECT *, least(0.24::DOUBLE, len(hits) * 0.06::DOUBLE) AS words,
      CASE WHEN section_type = 'promo' THEN 0.22 WHEN section_type IN ('economy', 'small') THEN 0.12 WHEN section_type = 'unknown' THEN -0.06 ELSE 0.0 END::DOUBLE + CASE WHEN equipment_type = 'brand#12' THEN 0.1 WHEN equipment_type <> 'generic' THEN -0.1 ELSE 0.0 END::DOUBLE AS types,
      CASE WHEN contains(heading, 'ring') THEN 0.14 ELSE 0.0 END::DOUBLE + CASE WHEN contains(heading, 'old') OR contains(regexp_replace(heading, '\\s+', '', 'g'), 'redbolt') THEN -0.22 ELSE 0.0 END::DOUBLE AS focus,
      CASE WHEN sample <> '' AND sample IN ('s1', 's2') THEN 0.28 ELSE 0.0 END::DOUBLE + CASE rel WHEN 3 THEN 0.42 WHEN 2 THEN 0.36 WHEN 1 THEN 0.22 ELSE 0.0 END::DOUBLE + CASE WHEN document IN ('doc3') THEN 0.18 ELSE 0.0 END::DOUBLE + CASE WHEN heading <> '' THEN fam::DOUBLE + CASE WHEN list_contains({_LIST(_HEADS)}, heading) THEN 0.14 ELSE 0.0 END::DOUBLE ELSE 0.0 END AS anchor,
      CASE WHEN list_contains(fl, 'low_information') THEN 0.72 ELSE 0.0 END::DOUBLE + CASE WHEN list_contains(fl, 'audit_review_pending') THEN 0.18 ELSE 0.0 END::DOUBLE + CASE WHEN list_contains(fl, 'low_quality_score') THEN 0.16 ELSE 0.0 END::DOUBLE + CASE WHEN list_contains(fl, 'partial_fragment') AND NOT list_contains(fl, 'low_information') THEN 0.22 ELSE 0.0 END::DOUBLE
        + CASE role WHEN 'page_furniture' THEN 0.32 WHEN 'asset_fragment' THEN 1.0 ELSE 0.0 END::DOUBLE + CASE WHEN contains(text, 'certificate') OR contains(text, 'test report') OR contains(text, 'old bolt') THEN 0.22 ELSE 0.0 END::DOUBLE + CASE risk WHEN 'high' THEN 0.08 WHEN 'medium' THEN 0.03 ELSE 0.0 END::DOUBLE AS penalty FROM b),
    d AS (SELECT *, types + focus + anchor AS structural, CASE WHEN visual IS NULL THEN words * 0.9::DOUBLE + (types + focus + anchor) * 0.1::DOUBLE ELSE words * 0.6::DOUBLE + visual * 0.3::DOUBLE + (types + focus + anchor) * 0.1::DOUBLE END - penalty AS final FROM c)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = shaped(spark, sf_dir, _ASSETS)
    anchors = {"samples": _ARRAY(["s1", "s2"]), "sections": _ARRAY(_SECTIONS), "documents": _ARRAY(["doc3"]), "headings": _ARRAY(_HEADS)}
    types = type_boost(c("section_type"), c("equipment_type"), F.lit("promo"), F.lit("brand#12"), _ARRAY(["economy", "small"]))
    structural = types + heading_focus(c("heading"), ["ring"], ["old", "red bolt"]) + anchor_boost(c("sample"), c("section"), c("document"), c("heading"), anchors)
    penalty = noise_penalty(F.split("flags", ","), c("role"), c("text"), _PAPERS)
    return rows.withColumn("s", asset_score(keyword_boost(F.lit(_WORDS), c("text")), c("visual"), structural, c("risk"), penalty))


@query(f"WITH {_SQL_SCORES} SELECT id, CASE WHEN visual IS NULL THEN 'textual_only' ELSE 'textual+visual' END AS branch, round(words, 4) AS textual, round(coalesce(visual, 0), 4) AS visual, round(structural, 4) AS structural, round(penalty, 4) AS penalty, round(final, 4) + 0.0::DOUBLE AS final FROM d")
def asset_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's score with its parts: words, vision, types, headings, anchors and penalties."""
    return _scored(spark, sf_dir).select("id", "s.*")


_USABLE = "NOT (audit = 'rejected' OR (kind = 'figure' AND (fallback OR role IN ('page_furniture', 'asset_fragment', 'text_fragment') OR coalesce(preserved, TRUE) = FALSE)) OR (kind = 'table' AND fallback AND NOT structured))"


@query(
    f"""WITH {_SQL_SCORES}, e AS (SELECT *, round(final, 4) AS score, CASE rel WHEN 3 THEN 'exact' WHEN 2 THEN 'descendant' WHEN 1 THEN 'ancestor' END AS relation FROM d WHERE {_USABLE} AND kind = 'figure'), f AS (SELECT *, round(score + CASE relation WHEN 'exact' THEN 0.22 WHEN 'descendant' THEN 0.2 ELSE 0.12 END::DOUBLE, 6) AS final_ FROM e WHERE relation IS NOT NULL),
    g AS (SELECT *, row_number() OVER (ORDER BY final_ DESC, id) AS place FROM f) SELECT id, relation, final_ AS final, place::INT AS place FROM g WHERE place <= 40"""
)
def asset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable figures of the sections that evidence points to, with their bonus, the best first."""
    c = F.col
    usable = _scored(spark, sf_dir).filter(~is_unusable(c("kind"), c("role"), c("audit"), c("fallback"), c("preserved"), c("structured")) & (c("kind") == "figure"))
    found = promoted(usable.select(F.lit(0).alias("query_id"), "id", F.col("s.final").alias("score"), "section"), best_section_relation(c("section"), _ARRAY(_SECTIONS)))
    return found.filter("place <= 40").select("id", "relation", "final", "place")


@query(
    f"""WITH a AS ({plain(_ASSETS)}) SELECT id, {_USABLE} AS usable, array_to_string(list_filter([CASE WHEN sample = '' THEN 'sample_id' END, CASE WHEN document = 'doc5' THEN 'raw_document_id' END, CASE WHEN section = '' THEN 'source_section_id' END, CASE WHEN heading = '' THEN 'heading_path' END, CASE WHEN page_no IS NULL THEN 'page_no' END], lambda x: x IS NOT NULL), ',') AS missing,
    CASE WHEN (sample <> '' OR document <> 'doc5') AND section <> '' AND heading <> '' AND page_no IS NOT NULL THEN 'high' WHEN (sample <> '' OR document <> 'doc5') AND (heading <> '' OR page_no IS NOT NULL) THEN 'medium' ELSE 'low' END AS tier FROM a"""
)
def asset_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each asset is usable, how firmly it is bound to its source, and what is missing for more."""
    c = F.col
    fields = {"sample_id": c("sample"), "raw_document_id": F.when(c("document") != "doc5", c("document")), "source_section_id": c("section"), "heading_path": c("heading"), "page_no": c("page_no")}
    found = shaped(spark, sf_dir, _ASSETS).select("id", (~is_unusable(c("kind"), c("role"), c("audit"), c("fallback"), c("preserved"), c("structured"))).alias("usable"), source_binding(fields).alias("b"))
    return found.select("id", "usable", F.concat_ws(",", "b.missing").alias("missing"), "b.tier")


@query(
    f"""WITH a AS (SELECT *, fallback AND NOT structured AS lost FROM ({plain(_ASSETS)})), f AS (SELECT id, [CASE WHEN preserved = FALSE THEN {{'s': 2, 'v': 0.05, 'r': 'not_preserved_for_vector_db'}} END, CASE WHEN review THEN {{'s': 1, 'v': 0.62, 'r': 'asset_marked_for_review'}} END, CASE WHEN kind = 'figure' AND NOT has_bytes THEN {{'s': 2, 'v': 0.08, 'r': 'figure_without_image_bytes'}} END,
      CASE WHEN kind = 'figure' AND role IN ('page_furniture', 'asset_fragment', 'text_fragment') THEN {{'s': 2, 'v': 0.08, 'r': 'visual_role:' || role}} END, CASE WHEN kind = 'figure' AND role = 'product_photo' THEN {{'s': 1, 'v': 0.46, 'r': 'product_photo_needs_section_specific_use'}} END, CASE WHEN kind = 'figure' AND role = 'layout_drawing' THEN {{'s': 1, 'v': 0.58, 'r': 'layout_drawing_needs_section_specific_use'}} END,
      CASE WHEN kind = 'table' AND lost THEN {{'s': 2, 'v': 0.12, 'r': 'table_storage_fallback_without_structure'}} END, CASE WHEN kind = 'table' AND NOT lost THEN {{'s': 1, 'v': 0.66, 'r': 'table_requires_reconstruction_or_review'}} END, CASE WHEN confidence > 0 AND confidence < 0.5 THEN {{'s': 1, 'v': 0.62, 'r': 'llm_asset_review_low_confidence'}} END] AS all_ FROM a),
    g AS (SELECT id, list_filter(all_, lambda x: x IS NOT NULL) AS found FROM f) SELECT id, CASE coalesce(list_max(list_transform(found, lambda x: x.s)), 0) WHEN 2 THEN 'rejected' WHEN 1 THEN 'review_pending' ELSE 'review_passed' END AS status, least(0.86, coalesce(list_min(list_transform(found, lambda x: x.v)), 1))::DOUBLE AS score, array_to_string(list_transform(found, lambda x: x.r), ',') AS reasons FROM g"""
)
def asset_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, score and reasons of each asset."""
    c = F.col
    gate = quality_gate(c("kind"), c("role"), c("preserved"), c("review"), c("has_bytes"), c("fallback") & ~c("structured"), c("confidence").cast("double"), 0.5)
    found = shaped(spark, sf_dir, _ASSETS).select("id", gate.alias("g"))
    return found.select("id", "g.status", "g.score", F.concat_ws(",", "g.reasons").alias("reasons"))


@query(
    """WITH p AS (SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS channel, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT id AS query_id, v FROM p WHERE id % 50 = 0), s AS (SELECT query_id, id, channel, list_cosine_similarity(q.v, p.v) AS score FROM q, p),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, id) AS k FROM s) SELECT query_id, id, channel, round(score, 6) AS score FROM r WHERE k <= 5"""
)
def channel_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each channel for each query, with the channel that found them."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("channel"), F.col("embedding").alias("vector"))
    asked = points.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("even"), F.lit("odd"))).alias("channel"), "vector")  # the stated query set
    return best_channels(points, asked, 5).withColumn("score", F.round("score", 6))


#: Section types for which layouts, photos, tables, curves and papers are noise, and what each costs.
SCHEMES, CONTROLS, SPECS, OVERVIEWS = ("main_circuit_scheme", "overall_solution", "control_logic", "protection_interlock"), ("protection_interlock", "control_logic", "communication_interface"), ("vfd_spec", "starter_spec"), ("main_circuit_scheme", "overall_solution", "communication_interface")
LAYOUT_COST, PHOTO_COST, UNFOCUSED_COST, STRANGE_COST, CURVE_COST, PAPER_COST = 0.55, 0.68, 0.45, 0.24, 0.34, 0.18


@dataclass(frozen=True)
class NoisePatterns:
    """What noise looks like in an asset's titles and captions: patterns, and words of certificates."""

    layout: str
    photo: str
    control: str
    strange_table: str
    curve: str
    drive: str
    papers: tuple[str, ...]


def section_noise(target: Column, role: Column, kind: Column, text: Column, patterns: NoisePatterns) -> Column:
    """What an asset loses for a section type that its layout, photo, table, curve or paper does not help."""
    low = F.lower(F.coalesce(text, F.lit("")))
    close = F.regexp_replace(low, r"\s+", "")
    role, kind = F.lower(F.coalesce(role, F.lit(""))), F.coalesce(kind, F.lit(""))
    focused = low.rlike(patterns.control)
    papers = reduce(lambda a, b: a | b, (low.contains(w) | close.contains(w.replace(" ", "")) for w in patterns.papers), F.lit(False))
    table = target.isin(*CONTROLS) & (kind == "table") & ~focused
    costs = [
        (target.isin(*SCHEMES) & role.isin("illustration", "layout_drawing") & low.rlike(patterns.layout), LAYOUT_COST), (target.isin(*SCHEMES) & ((role == "product_photo") | low.rlike(patterns.photo)), PHOTO_COST),
        (table, UNFOCUSED_COST), (table & low.rlike(patterns.strange_table), STRANGE_COST), (target.isin(*SPECS) & low.rlike(patterns.curve) & ~low.rlike(patterns.drive), CURVE_COST), (target.isin(*OVERVIEWS) & papers, PAPER_COST),
    ]
    return reduce(lambda total, cost: total + F.when(F.coalesce(cost[0], F.lit(False)), F.lit(cost[1])).otherwise(F.lit(0.0)), costs, F.lit(0.0))


_SEEN = NoisePatterns("ring|bolt", "gizmo", "gear|red", "widget", "pump", "valve", ("large gear", "promo"))
_TARGETED = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'main_circuit_scheme' WHEN 1 THEN 'overall_solution' WHEN 2 THEN 'control_logic' WHEN 3 THEN 'communication_interface' WHEN 4 THEN 'vfd_spec' WHEN 5 THEN 'starter_spec' WHEN 6 THEN 'protection_interlock' ELSE 'other' END AS target,
    CASE p_size % 5 WHEN 0 THEN 'Illustration' WHEN 1 THEN 'layout_drawing' WHEN 2 THEN 'product_photo' WHEN 3 THEN NULL ELSE 'figure' END AS role, CASE p_partkey % 3 WHEN 0 THEN 'table' ELSE 'figure' END AS kind, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name || ' ' || p_type END AS text FROM {part}"""
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(
    f"""WITH t AS (SELECT p_partkey, target, lower(coalesce(role, '')) AS role, kind, lower(coalesce(text, '')) AS low FROM ({plain(_TARGETED)})), f AS (SELECT *, regexp_matches(low, '{_SEEN.control}') AS focused, {" OR ".join(f"contains(low, '{w}') OR contains(replace(low, ' ', ''), '{w.replace(' ', '')}')" for w in _SEEN.papers)} AS papers FROM t)
    SELECT p_partkey, round(CASE WHEN target IN {_IN(SCHEMES)} AND role IN ('illustration', 'layout_drawing') AND regexp_matches(low, '{_SEEN.layout}') THEN 0.55 ELSE 0 END::DOUBLE + CASE WHEN target IN {_IN(SCHEMES)} AND (role = 'product_photo' OR regexp_matches(low, '{_SEEN.photo}')) THEN 0.68 ELSE 0 END::DOUBLE + CASE WHEN target IN {_IN(CONTROLS)} AND kind = 'table' AND NOT focused THEN CASE WHEN regexp_matches(low, '{_SEEN.strange_table}') THEN 0.69 ELSE 0.45 END ELSE 0 END::DOUBLE
      + CASE WHEN target IN {_IN(SPECS)} AND regexp_matches(low, '{_SEEN.curve}') AND NOT regexp_matches(low, '{_SEEN.drive}') THEN 0.34 ELSE 0 END::DOUBLE + CASE WHEN target IN {_IN(OVERVIEWS)} AND papers THEN 0.18 ELSE 0 END::DOUBLE, 6) AS penalty FROM f"""
)
def asset_section_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each asset loses for the section type it is meant for."""
    c = F.col
    return shaped(spark, sf_dir, _TARGETED).select("p_partkey", F.round(section_noise(c("target"), c("role"), c("kind"), c("text"), _SEEN), 6).alias("penalty"))
