"""Scores of material for reuse: a table of rules over features of each pair, priors from knowledge cards, and preferred documents.

A pair is a row of a section and an item of material. It has: base, result_type, heading, content, query_terms, expected_types,
section_class, front, needs_asset, asset_required, form, section_type, equipment_type, specificity, parameter_sensitive,
target_section, target_equipment, preferred_forms, support_forms, related_types; and of the cards that go with the section:
product_texts, product_terms, module_texts, module_terms, product_sections, product_equipment (null where it has no cards).
Null texts are empty, null arrays hold nothing. No pair meets another, so the work grows with the pairs alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import Rule, compiled, sql_compiled
from ..registry import plain, query, shaped
from . import scoring, taxonomy

#: Words that are no terms of material; words that tell a customer's text; how much of a text counts; the cap of texts that are not about commercial matters, and the highest score.
STOPWORDS = ("项目", "方案", "系统", "技术", "章节", "当前", "相关", "说明", "用于", "以及", "进行")
CUSTOMER_WORDS = ("买方", "卖方", "客户", "项目名称", "用户")
CONTENT_CHARS, OFF_TOPIC_CAP, HIGHEST = 1200, 0.18, 1.2
#: Fixed value: what a preferred document adds.
DOCUMENT_POINTS = 0.24
BRACKETS = r"[()（）【】\[\]《》·:：,，/\\\-\s]+"
#: The score of an item for a section.
RULES = [
    Rule(None, "true", "base"),
    Rule("keyword_overlap", "n_overlap > 0", "least(0.22, 0.22 * n_overlap / n_asked)", "words", "overlap_text"),
    Rule("keyword_mismatch_penalty", "n_asked > 0", "-0.12", "words"),
    Rule("heading_match", "n_heading > 0", "0.12"),
    Rule("expected_type", "expected", "0.06"),
    Rule("section_class_match", "class_held", "0.08"),
    Rule("front_matter_penalty", "front", "-0.18"),
    Rule("page_furniture_penalty", "form = 'page_furniture'", "-0.25"),
    Rule("asset_dependency_penalty", "needs_asset and not asset_required", "-0.08"),
    Rule("customer_specific_penalty", "specificity in ('medium', 'high') and customer_words", "case when specificity = 'medium' then -0.08 else -0.12 end"),
    Rule("parameter_type_penalty", "parameter_sensitive and result_type not in ('parameter', 'table')", "-0.04"),
    Rule("parameter_content_form_penalty", "parameter_sensitive and not table_form", "-0.06"),
    Rule("company_profile_penalty", "target_section <> 'company_profile' and section_type = 'company_profile'", "-0.18"),
    Rule("section_type_match", "target_section <> 'unknown' and section_type = target_section", "0.2", "type"),
    Rule("related_section_type_match", "related_section", "0.1", "type"),
    Rule("unknown_section_type_penalty", "target_section not in ('unknown', 'overall_solution') and section_type = 'unknown'", "-0.05", "type"),
    Rule("section_type_mismatch_penalty", "target_section not in ('unknown', 'overall_solution')", "-0.12", "type"),
    Rule("equipment_type_match", "target_equipment <> 'generic' and equipment_type = target_equipment", "0.1", "kind"),
    Rule("equipment_type_mismatch_penalty", "target_equipment <> 'generic' and equipment_type <> 'generic'", "-0.12", "kind"),
    Rule("content_form_match", "preferred_form", "0.08", "form"),
    Rule("support_content_form_match", "support_form", "0.04", "form"),
    Rule("content_form_mismatch_penalty", "n_preferred > 0 and form in ('formula', 'certificate')", "-0.12", "form"),
    Rule("heading_focus_match", "heading_focus", "0.14"),
    Rule("heading_noise_penalty", "heading_off", "-0.22"),
    Rule("commercial_manual_cross_type_score_cap", "off_topic", "0.0"),
]
#: What knowledge cards add where the item fits the section's type or equipment.
PRIORS = [
    Rule("knowledge_wiki_product_match", "relevant and product_held", "0.03"),
    Rule("knowledge_wiki_module_match", "relevant and module_held", "0.04"),
    Rule("knowledge_wiki_product_section_prior", "relevant and product_section", "0.03"),
    Rule("knowledge_wiki_product_equipment_prior", "relevant and product_equipment_held", "0.03"),
]
_TEXTS = ("result_type", "heading", "content", "section_class", "form", "section_type", "equipment_type", "specificity", "target_section", "target_equipment")
_LISTS = ("query_terms", "expected_types", "preferred_forms", "support_forms", "related_types")
_CARDS = ("product_texts", "product_terms", "module_texts", "module_terms", "product_sections", "product_equipment")


def reuse_terms(text: Column, registry: taxonomy.Registry) -> Column:
    """The terms of a section or an item, each once."""
    return F.filter(scoring.case_tokens(text, registry, STOPWORDS), lambda t: F.length(t) >= 2)


def is_relevant(target_section: Column, target_equipment: Column, section: Column, equipment: Column, related: Column) -> Column:
    """Whether an item fits what a section asks for: by its section type or its equipment, where the section asks for either at all."""
    by_section, by_equipment = ~target_section.isin("", "unknown", "overall_solution"), ~target_equipment.isin("", "unknown", "generic")
    fits = (by_section & ((section == target_section) | F.array_contains(related, section))) | (by_equipment & (equipment == target_equipment))
    return (~by_section & ~by_equipment) | fits


def features(pairs: DataFrame, registry: taxonomy.Registry, focus: dict[str, tuple[str, ...]] | None = None, off: dict[str, tuple[str, ...]] | None = None, commercial: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The pairs with all columns that the rules read."""
    c = F.col
    none = F.array().cast("array<string>")
    low = lambda n: F.lower(F.coalesce(c(n), F.lit("")))
    rows = pairs.withColumns({"has_cards": F.coalesce(*(c(n) for n in _CARDS)).isNotNull()} | {n: F.coalesce(c(n), none) for n in (*_LISTS, *_CARDS)})
    rows = rows.withColumns({n: F.coalesce(c(n), F.lit("")) if n in ("heading", "content") else low(n) for n in _TEXTS} | {n: F.coalesce(c(n), F.lit(False)) for n in ("front", "needs_asset", "asset_required", "parameter_sensitive")})
    defaults = {"form": "narrative", "section_type": "unknown", "equipment_type": "generic", "specificity": "medium", "target_section": "unknown", "target_equipment": "generic"}
    rows = rows.withColumns({n: F.coalesce(F.nullif(c(n), F.lit("")), F.lit(v)) for n, v in defaults.items()} | {"base": F.coalesce("base", F.lit(0.0))})
    rows = rows.withColumns({"_heads": reuse_terms(c("heading"), registry), "_words": reuse_terms(F.substring("content", 1, CONTENT_CHARS), registry), "_flat": F.regexp_replace(F.lower(F.concat_ws("\n", "heading", "content")), BRACKETS, "")})
    rows = rows.withColumns({"_terms": F.array_union("_heads", "_words"), "_close": F.regexp_replace(F.lower("heading"), r"\s+", "")})
    held = lambda kind: F.exists(f"{kind}_texts", lambda t: (t != "") & c("_flat").contains(t)) | F.arrays_overlap(f"{kind}_terms", c("_terms"))
    by_type = lambda table: scoring._or(*((c("target_section") == k) & scoring.holds(c("_close"), tuple(w.lower().replace(" ", "") for w in v)) for k, v in (table or {}).items()))
    topic = scoring.commercial_text(F.concat_ws("\n", "heading", F.substring("content", 1, CONTENT_CHARS)), commercial or {})
    relevant = is_relevant(c("target_section"), c("target_equipment"), c("section_type"), c("equipment_type"), c("related_types"))
    return rows.withColumns({
        "n_asked": F.size(F.array_distinct("query_terms")), "n_overlap": F.size(F.array_intersect("query_terms", "_terms")), "n_heading": F.size(F.array_intersect("query_terms", "_heads")), "n_preferred": F.size("preferred_forms"),
        "overlap_text": F.size(F.array_intersect("query_terms", "_terms")).cast("string"), "expected": F.array_contains(F.transform("expected_types", lambda t: F.lower(t)), c("result_type")) & (c("result_type") != ""),
        "class_held": (c("section_class") != "") & F.exists("_terms", lambda t: t.contains(c("section_class"))), "customer_words": scoring.holds(c("content"), CUSTOMER_WORDS), "table_form": c("form").isin(*scoring.TABLE_FORMS),
        "related_section": F.array_contains("related_types", c("section_type")), "preferred_form": F.array_contains("preferred_forms", c("form")), "support_form": F.array_contains("support_forms", c("form")), "heading_focus": by_type(focus), "heading_off": by_type(off),
        "off_topic": (c("target_section") == "commercial_manual_only") & ~topic, "relevant": c("has_cards") & (F.size("_terms") > 0) & relevant, "product_held": held("product"), "module_held": held("module"),
        "product_section": (c("section_type") != "unknown") & F.array_contains("product_sections", c("section_type")), "product_equipment_held": (c("equipment_type") != "generic") & F.array_contains("product_equipment", c("equipment_type")),
    })


def scored(pairs: DataFrame, keep: list[str], registry: taxonomy.Registry, **words: dict[str, tuple[str, ...]]) -> DataFrame:
    """The columns to keep with score, prior (what knowledge cards added) and reasons."""
    c = F.col
    own = features(pairs, registry, **words).select(*keep, "off_topic", compiled(RULES).alias("_s"), compiled(PRIORS).alias("_p"))
    capped = F.when(c("off_topic"), F.least(c("_s.score"), F.lit(OFF_TOPIC_CAP))).otherwise(c("_s.score"))
    final = F.round(F.least(F.lit(HIGHEST), F.greatest(F.lit(0.0), capped + c("_p.score"))), 4)
    return own.select(*keep, final.alias("score"), F.round("_p.score", 4).alias("prior"), F.concat("_s.reasons", "_p.reasons").alias("reasons"))


def preferred_documents(items: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """The items (keys, names array, place, score, reasons) with ``place`` anew: those of one of the documents (keys, document) that a section prefers gain DOCUMENT_POINTS; ties keep their order."""
    name = lambda x: F.regexp_replace(F.lower(x), r"\s+", "")
    wanted = documents.groupBy(*keys).agg(F.collect_set(F.nullif(name(F.col("document")), F.lit(""))).alias("_d"))  # a few a section
    joined = items.join(wanted, keys, "left")
    hit = F.coalesce(F.arrays_overlap(F.transform(F.coalesce("names", F.array().cast("array<string>")), name), F.col("_d")), F.lit(False))
    reason = F.lit("knowledge_wiki_source_document_prior")
    rows = joined.withColumns({"score": F.when(hit, F.round(F.col("score") + DOCUMENT_POINTS, 4)).otherwise(F.col("score")), "reasons": F.when(hit & ~F.array_contains("reasons", reason), F.array_append("reasons", reason)).otherwise(F.col("reasons"))})
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "place")
    return rows.drop("_d").withColumn("place", F.row_number().over(order))


_t = scoring._text
_REUSE = f"""SELECT doc_id, doc_id % 80 AS section_id, round(CAST(doc_id % 90 AS DOUBLE) / 100, 2) AS base, {_t('doc_id % 4', 'Table', 'parameter', 'section', '')} AS result_type, {_t('doc_id % 5', '控制 接口 the', 'und der', '', '清单', 'que las')} AS heading,
    CASE doc_id % 7 WHEN 0 THEN '买方 ' || text WHEN 1 THEN '' ELSE text END AS content, {_t('doc_id % 6', 'the,and,zzz', 'der,und', '', 'que,las,控制', 'xyzzy', '接口,清单')} AS query_terms, {_t('doc_id % 3', 'table', 'Section,Parameter', '')} AS expected_types, {_t('doc_id % 4', 'THE', 'zzz', '', 'nd')} AS section_class,
    doc_id % 13 = 0 AS front, doc_id % 5 = 0 AS needs_asset, doc_id % 10 = 0 AS asset_required, {_t('doc_id % 6', 'narrative', 'page_furniture', 'bom_table', 'formula', '', 'certificate')} AS form, {_t('doc_id % 7', 'unknown', 'other', 'overall_solution', 'company_profile', 'quality', '', 'supply_scope')} AS section_type,
    {_t('doc_id % 5', 'generic', 'motor', 'vfd', '', 'lci')} AS equipment_type, {_t('doc_id % 4', 'medium', 'High', 'low', '')} AS specificity, doc_id % 3 = 0 AS parameter_sensitive, {_t('doc_id % 8', 'unknown', 'other', 'quality', 'commercial_manual_only', 'overall_solution', 'supply_scope', 'company_profile', '')} AS target_section,
    {_t('doc_id % 3', 'generic', 'motor', 'vfd')} AS target_equipment, {_t('doc_id % 3', 'narrative', 'bom_table', '')} AS preferred_forms, {_t('doc_id % 2', 'formula', '')} AS support_forms, {_t('doc_id % 3', 'quality', 'other,supply_scope', '')} AS related_types,
    CASE WHEN doc_id % 4 > 0 THEN {_t('doc_id % 5', 'theand', '接口the', '', 'ofthe', 'xyz')} END AS product_texts, CASE WHEN doc_id % 4 > 0 THEN {_t('doc_id % 2', 'zzz', 'and')} END AS product_terms, CASE WHEN doc_id % 4 > 0 THEN {_t('doc_id % 3', 'undder', 'quelas', '')} END AS module_texts,
    CASE WHEN doc_id % 4 > 0 THEN 'que' END AS module_terms, CASE WHEN doc_id % 4 > 0 THEN 'quality,other' END AS product_sections, CASE WHEN doc_id % 4 > 0 THEN 'motor' END AS product_equipment, source FROM {{documents}}"""
_FOCUS, _OFF = {"other": ("控制", "u n d"), "quality": ("que",)}, {"other": ("清单",), "supply_scope": ("las",)}
_SPLIT = lambda n: f"list_filter(string_split({n}, ','), lambda x: x <> '')"
_TOKENS = lambda text: f"list_distinct(list_filter(flatten(list_transform(list_transform(regexp_extract_all({text}, '[A-Za-z0-9_./+-]{{2,}}|[一-鿿]{{2,}}'), lambda t: lower(t)), lambda t: [t] || list_filter(regexp_split_to_array(t, '[/+|,_-]+'), lambda p: length(p) >= 2) || list_filter([regexp_replace(t, '[/+|,_-]+', '', 'g')], lambda p: length(p) >= 2))), lambda t: length(t) >= 2 AND NOT list_contains({list(STOPWORDS)!r}, t)))"


def _sql_reuse() -> str:
    has = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
    by_type = lambda table: "(" + " OR ".join(f"(target_section = '{k}' AND {has('near', [w.replace(' ', '') for w in v])})" for k, v in table.items()) + ")"
    default = {"form": "narrative", "section_type": "unknown", "equipment_type": "generic", "specificity": "medium", "target_section": "unknown", "target_equipment": "generic"}
    com = {n: has("com", scoring._COMMERCIAL[n]) for n in scoring._COMMERCIAL}
    topic = f"(NOT ({com['supply_scope_terms']} AND NOT {com['strong_delivery_terms']}) AND ({com['manual_only_terms']} OR {com['exact_compound_terms']} OR ({com['conditional_terms']} AND {com['context_terms']})))"
    held = lambda kind: f"(len(list_filter({kind}_texts, lambda t: t <> '' AND contains(flat, t))) > 0 OR len(list_intersect({kind}_terms, terms)) > 0)"
    guard_s, guard_e = "target_section NOT IN ('', 'unknown', 'overall_solution')", "target_equipment NOT IN ('', 'unknown', 'generic')"
    first, last = sql_compiled(RULES), sql_compiled(PRIORS)
    return f"""WITH r AS (SELECT * REPLACE ({', '.join([*(f"{_SPLIT(n)} AS {n}" for n in _LISTS), *(f"coalesce({_SPLIT(n)}, []) AS {n}" for n in _CARDS), *(f"coalesce(nullif(lower({n}), ''), '{v}') AS {n}" for n, v in default.items()), 'lower(section_class) AS section_class', 'lower(result_type) AS result_type'])}), product_terms IS NOT NULL AS has_cards FROM ({plain(_REUSE)})),
    s AS (SELECT *, {_TOKENS('heading')} AS heads, {_TOKENS('substr(content, 1, 1200)')} AS words, regexp_replace(lower(heading || chr(10) || content), '{BRACKETS}', '', 'g') AS flat, regexp_replace(lower(heading), '\\s+', '', 'g') AS near, regexp_replace(lower(heading || chr(10) || substr(content, 1, 1200)), '\\s+', '', 'g') AS com FROM r), t AS (SELECT *, list_distinct(heads || words) AS terms FROM s),
    u AS (SELECT *, len(query_terms) AS n_asked, len(list_intersect(query_terms, terms)) AS n_overlap, len(list_intersect(query_terms, heads)) AS n_heading, len(preferred_forms) AS n_preferred, len(list_intersect(query_terms, terms))::VARCHAR AS overlap_text, list_contains(list_transform(expected_types, lambda e: lower(e)), result_type) AND result_type <> '' AS expected,
      section_class <> '' AND len(list_filter(terms, lambda x: contains(x, section_class))) > 0 AS class_held, {has('content', CUSTOMER_WORDS)} AS customer_words, form IN ('parameter_table', 'bom_table', 'interface_table', 'protection_table') AS table_form, list_contains(related_types, section_type) AS related_section, list_contains(preferred_forms, form) AS preferred_form, list_contains(support_forms, form) AS support_form,
      {by_type(_FOCUS)} AS heading_focus, {by_type(_OFF)} AS heading_off, target_section = 'commercial_manual_only' AND NOT {topic} AS off_topic, has_cards AND len(terms) > 0 AND ((NOT {guard_s} AND NOT {guard_e}) OR ({guard_s} AND (section_type = target_section OR list_contains(related_types, section_type))) OR ({guard_e} AND equipment_type = target_equipment)) AS relevant,
      {held('product')} AS product_held, {held('module')} AS module_held, section_type <> 'unknown' AND list_contains(product_sections, section_type) AS product_section, equipment_type <> 'generic' AND list_contains(product_equipment, equipment_type) AS product_equipment_held FROM t),
    v AS (SELECT doc_id, section_id, source, off_topic, {first[0]} AS own, {last[0]} AS prior, {first[1]} || {last[1]} AS reasons FROM u), x AS (SELECT doc_id, section_id, source, round(least({HIGHEST}::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN off_topic THEN least(own, {OFF_TOPIC_CAP}::DOUBLE) ELSE own END + prior)), 4) AS score, round(prior, 4) AS prior, reasons FROM v)"""


def _reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, _REUSE).withColumns({n: F.filter(F.split(n, ","), lambda x: x != "") for n in (*_LISTS, *_CARDS)})
    return scored(rows, ["doc_id", "section_id", "source"], taxonomy.Registry(), focus=_FOCUS, off=_OFF, commercial=scoring._COMMERCIAL)


@query(f"{_sql_reuse()} SELECT doc_id, score, prior, array_to_string(reasons, ';') AS reasons FROM x")
def reuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document scores as material for its section, and why."""
    return _reuse(spark, sf_dir).select("doc_id", "score", "prior", F.array_join("reasons", ";").alias("reasons"))


@query(
    f"""{_sql_reuse()}, y AS (SELECT *, CASE WHEN (section_id % 3 = 0 AND source IN ('web', 'src1')) OR (section_id % 3 = 1 AND source IN ('src2', 'src0')) THEN round(score + {DOCUMENT_POINTS}::DOUBLE, 4) ELSE score END AS points FROM x) SELECT section_id, doc_id, points AS score, row_number() OVER (PARTITION BY section_id ORDER BY points DESC, doc_id)::INT AS place FROM y"""
)
def reuse_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The material of each section in order, that of preferred documents before."""
    items = _reuse(spark, sf_dir).withColumns({"names": F.array("source"), "place": F.col("doc_id")})
    names = F.when(F.col("section_id") % 3 == 0, F.array(F.lit("WEB"), F.lit("s rc1"))).when(F.col("section_id") % 3 == 1, F.array(F.lit(" src2"), F.lit("SRC0"), F.lit("")))
    wanted = items.select("section_id").distinct().select("section_id", F.explode(names).alias("document"))
    return preferred_documents(items, wanted, ["section_id"]).select("section_id", "doc_id", "score", "place")
