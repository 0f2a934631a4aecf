"""Validation of drafts by rules: a registry in which each rule names the table it reads and what it finds there.

Rules over one table share one scan: each is an array of details, empty where all is well, and one projection makes the
findings of all of them. What a project's drafts contradict each other in is aggregated first and then judged in the same
way. All findings have one schema: project_id, kind, code, level, section_id, section_title, details.

Tables (``Inputs``), each a row per
* card: project_id, blockers array<struct<field, status>>, params map<string, string>
* section of an outline: project_id, section_id, title, mandatory, evidence_types, needs_review, parameter_sensitive, specificity, asset_required
* draft: project_id, section_id, title, text, citations array<struct<evidence_id, source_doc_id, source_title>>, assumptions, params map, assets array<struct<asset_id,
  asset_type, role, risk>>, figure_confirmed, banned array, hints map, must_replace array, block_ids array, gate struct<status, score>, retrieval struct<mode, path, blocks
  array<map<string, double>>, sections array<map<string, double>>>
* bundle of evidence: project_id, evidence_ids, quality, fallback_count, fallback_top
* reuse (optional): project_id, section_id, score, of ``similar.reuse_similarity``

Null texts are empty, null arrays and maps hold nothing, a null project matches none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..registry import plain, query, shaped
from . import drafts as D
from . import similar

#: Hints of assumptions, ways of declaring them, words of technical sections, fields that have to be replaced, and evidence of technical sections.
ASSUMED, LOOSE = ("待确认", "待补充", "TBD", "暂定", "后续确认"), ("TBD", "待补充", "暂定")
DECLARED = ("以最终", "最终以", "以双方确认", "以技术协议", "以供货清单", "按最终", "待确认参数", "待确认事项", "待确认供电参数")
TECHNICAL = ("技术", "架构", "配置", "参数", "实施", "系统", "方案")
REPLACED = ("voltage_level", "power_rating", "quantity", "delivery_scope")
TECHNICAL_EVIDENCE = ("section", "figure", "table", "parameter")
#: Patterns of placeholders, of assets, of table rows and separators, and of quantities with their units.
NAME_PLACEHOLDER, BRACE_PLACEHOLDER = r"\[[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+\]", r"\{\{[^{}\n]+\}\}"
ASSET = r"\[\[ASSET:(FIGURE|TABLE|FORMULA):([^\]]+)\]\]"
TABLE_ROW, TABLE_RULE = r"(?m)^\|.+\|\s*$", r"(?m)^\|\s*:?-{3,}.*\|\s*$"
QUANTITY = "[0-9]+(?:\\.[0-9]+)?(?:套|台|个|项|柜|面|回|路|只|组|根|支)"
#: Least scores of a gate, of retrieval traces (final, semantic, reranked), of evidence and of its fallback; least length of a section.
GATE, FINAL, SEMANTIC, RERANKED, EVIDENCE, FALLBACK, SHORT = 0.78, 0.55, 0.45, 0.45, 0.65, 0.45, 60
DIAGNOSED = ("full_section", "section_pack")


def none() -> Column:
    return F.array().cast("array<string>")


def placeholders(text: Column) -> Column:
    """The different placeholders of a text, in order of their characters."""
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(NAME_PLACEHOLDER), 0), F.regexp_extract_all(text, F.lit(BRACE_PLACEHOLDER), 0))))


def quantity_pairs(text: Column) -> Column:
    """The different numbers with their units, in order, whatever the white space and case."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(text, r"\s+", "")), F.lit(QUANTITY), 0)))


def has_table(text: Column) -> Column:
    return text.rlike(TABLE_ROW) & text.rlike(TABLE_RULE)


def contains_value(text: Column, value: Column) -> Column:
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return bare(text).contains(bare(value))


def has_replacement(text: Column, field: Column, value: Column) -> Column:
    """Whether a text holds a value, or, of a quantity, all its numbers with units."""
    pairs = quantity_pairs(value)
    return contains_value(text, value) | ((field == "quantity") & (F.size(pairs) > 0) & (F.size(F.array_except(pairs, quantity_pairs(text))) == 0))


def any_in(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda found, word: found | text.contains(word), words, F.lit(False))


def implicit_assumption(text: Column) -> Column:
    """Whether a line hints at an assumption outside of any place that declares them: a fold over lines that knows the block it is in."""
    declared = lambda x: ~any_in(x, LOOSE) & (x.startswith("|") | x.startswith("注") | x.startswith("说明") | (x.startswith("#") & (x.contains("待确认") | x.contains("后续确认"))) | any_in(x, DECLARED))
    rows = F.transform(F.filter(F.transform(C.lines(text), C.stripped), lambda x: (x != "") & (x.startswith("#") | any_in(x, ASSUMED))), lambda x: F.struct(x.startswith("#").alias("head"), any_in(x, ASSUMED).alias("hint"), declared(x).alias("told")))
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("found"))
    step = lambda s, x: F.struct(F.when(x["head"], x["hint"] & x["told"]).otherwise(s["inside"]).alias("inside"), (s["found"] | (~x["head"] & x["hint"] & ~x["told"] & ~s["inside"])).alias("found"))
    return F.aggregate(rows, start, step)["found"]


def drifts(title: Column, text: Column) -> Column:
    """Whether a text is too short or holds none of its title's words."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")
    words = F.filter(F.split(F.trim(title), r"[\s/、，,（）()]+"), lambda w: F.length(w) >= 2)
    return (F.length(bare) < SHORT) | ((F.size(words) > 0) & ~F.exists(words, lambda w: bare.contains(w)))


def open_assets(text: Column, assets: Column) -> Column:
    """The ids of assets a text places that someone has to confirm: risky figures, tables that are not written out, formulas."""
    kinds, ids = (F.regexp_extract_all(text, F.lit(ASSET), n) for n in (1, 2))
    of = lambda p: F.element_at(F.concat(F.filter(assets, lambda a: F.trim(a["asset_id"]) == F.trim(p["id"])), F.array(F.lit(None).cast("struct<asset_id:string,asset_type:string,role:string,risk:string>"))), 1)
    written = has_table(text)

    def is_open(p: Column) -> Column:
        risk, kind = F.lower(F.coalesce(of(p)["risk"], F.lit(""))), F.lower(F.coalesce(F.nullif(of(p)["asset_type"], F.lit("")), F.lower(p["kind"])))
        return ~((p["kind"] == "TABLE") & (written | (kind != "table"))) & ~((p["kind"] == "FIGURE") & ~risk.isin("high", "critical"))

    placed = F.zip_with(kinds, ids, lambda k, i: F.struct(k.alias("kind"), i.alias("id")))
    return F.transform(F.filter(placed, is_open), lambda p: F.trim(p["id"]))


def trace_weakness(retrieval: Column) -> Column:
    """What is weak about the scores by which a section's material was found: of its blocks, or of its sections where blocks have none."""
    full = lambda traces: F.filter(F.coalesce(traces, F.array().cast("array<map<string,double>>")), lambda t: F.size(t) > 0)
    blocks, sections = full(retrieval["blocks"]), full(retrieval["sections"])
    traces = F.when(F.size(blocks) > 0, blocks).otherwise(sections)

    def mean(*names: str) -> Column:
        values = F.filter(F.transform(traces, lambda t: F.coalesce(*(F.round(F.try_element_at(t, F.lit(n)), 4) for n in names))), lambda v: v.isNotNull())
        return F.when(F.size(values) > 0, F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values), 4))

    semantic, reranked = mean("semantic", "dense"), mean("rerank")
    chosen = lambda name: F.coalesce(F.size(retrieval[name]), F.lit(0)) > 0
    expected = chosen("blocks") | chosen("sections") | F.coalesce(retrieval["mode"].isin(*DIAGNOSED), F.lit(False)) | F.coalesce(retrieval["path"].startswith("extractive_reuse"), F.lit(False))
    weak = F.array_compact(F.array(
        F.when(F.size(traces) == 0, F.lit("missing_structured_trace")), F.when(mean("final", "hybrid") < FINAL, F.lit("low_final_score")), F.when((semantic < SEMANTIC) & F.coalesce(reranked < RERANKED, F.lit(True)), F.lit("low_semantic_and_rerank"))
    ))
    return F.when(expected, weak).otherwise(none())


@dataclass(frozen=True)
class Check:
    """A rule: which table it reads, and its details there; a finding where they are not empty. other: a code whose finding takes its place."""

    code: str
    over: str
    details: Callable[[], Column]

    @property
    def kind(self) -> str:
        return "warning" if self.code in WARNINGS else "error"


#: Codes of warnings; all others are errors.
WARNINGS = ("VAL101", "VAL102", "VAL103", "VAL104", "VAL105", "VAL106", "VAL107", "VAL109")
CHECKS: list[Check] = []


def check(code: str, over: str) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    def register(details: Callable[[], Column]) -> Callable[[], Column]:
        CHECKS.append(Check(code, over, details))
        return details

    return register


def only(test: Column, details: Column | None = None) -> Column:
    """The details, or the empty string, where a test holds."""
    return F.when(F.coalesce(test, F.lit(False)), F.array(F.lit("")) if details is None else details).otherwise(none())


c = F.col


@check("VAL001", "card")
def open_blockers() -> Column:
    return F.transform(F.filter(c("blockers"), lambda b: F.coalesce(b["status"], F.lit("")) != "resolved"), lambda b: F.coalesce(F.nullif(b["field"], F.lit("")), F.lit("unknown")))


@check("VAL002", "section")
def missing_section() -> Column:
    return only(c("mandatory") & (F.regexp_replace(c("text"), r"\s+", "") == ""))


@check("VAL003", "param")
def conflicting_values() -> Column:
    return only(F.size("values") > 1, F.concat(F.array("param"), F.array_sort("values")))


@check("VAL004", "draft")
def technical_without_citations() -> Column:
    technical = any_in(F.coalesce(F.nullif(c("outline_title"), F.lit("")), c("title")), TECHNICAL) | F.arrays_overlap(c("evidence_types"), F.array(*map(F.lit, TECHNICAL_EVIDENCE)))
    return only(technical & (F.size("citations") == 0))


@check("VAL005", "draft")
def invalid_citations() -> Column:
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    missing = lambda r: blank(r["evidence_id"]) | blank(r["source_doc_id"]) | blank(r["source_title"])
    unknown = lambda r: (F.size("evidence_ids") > 0) & ~F.array_contains("evidence_ids", r["evidence_id"]) & ~F.array_contains("block_ids", r["evidence_id"])
    return F.array_compact(F.transform("citations", lambda r: F.when(missing(r), F.lit("missing_required_fields")).when(unknown(r), F.concat(F.lit("unknown_evidence_id:"), r["evidence_id"]))))


@check("VAL006", "draft")
def unconfirmed_assets() -> Column:
    return only(c("needs_review") & ~c("figure_confirmed"), open_assets(c("text"), c("assets")))


@check("VAL007", "draft")
def open_placeholders() -> Column:
    return placeholders(c("text"))


@check("VAL008", "draft")
def leaked_terms() -> Column:
    return F.array_distinct(F.filter(F.transform("banned", lambda t: F.trim(t)), lambda t: (F.length(t) >= 3) & c("text").contains(t)))


def _expected() -> Column:
    fields = F.filter("must_replace", lambda f: f.isin(*REPLACED) & (F.coalesce(F.try_element_at("hints", f), F.lit("")) != ""))
    return F.when(c("parameter_sensitive"), F.array_distinct(fields)).otherwise(none())


def _missing() -> Column:
    return F.filter(_expected(), lambda f: ~has_replacement(c("text"), f, F.trim(F.try_element_at("hints", f))))


@check("VAL009", "draft")
def nothing_replaced() -> Column:
    return only(F.size(_missing()) == F.size(_expected()), _missing())


@check("VAL106", "draft")
def not_all_replaced() -> Column:
    return only(F.size(_missing()) < F.size(_expected()), _missing())


def _headings(high: bool) -> Column:
    found = D.heading_issues(c("title"), c("text"))
    severe = [code for code, level in D.SEVERITY.items() if level == "high"]
    return F.transform(F.filter(found, lambda i: i["code"].isin(*severe) if high else ~i["code"].isin(*severe)), lambda i: F.concat_ws(":", i["code"], i["target"]))


@check("VAL010", "draft")
def internal_headings() -> Column:
    return _headings(True)


@check("VAL107", "draft")
def loose_headings() -> Column:
    return only(F.size(_headings(True)) == 0, _headings(False))


@check("VAL108", "draft")
def failed_gate() -> Column:
    return only((F.lower("gate.status") == "review_required") | F.coalesce(c("gate.score") < GATE, F.lit(False)), F.array(F.coalesce(F.lower("gate.status"), F.lit(""))))


@check("VAL109", "draft")
def weak_retrieval() -> Column:
    return trace_weakness(c("retrieval"))


@check("VAL105", "draft")
def too_close_to_reuse() -> Column:
    return only(similar.is_reused(c("reuse_score"), c("specificity"), c("parameter_sensitive")), F.array(c("reuse_score").cast("string")))


@check("VAL101", "draft")
def goal_drift() -> Column:
    return only(drifts(F.coalesce(F.nullif(c("outline_title"), F.lit("")), c("title")), c("text")))


@check("VAL102", "draft")
def undeclared_assumption() -> Column:
    return only(implicit_assumption(c("text")) & (F.size("assumptions") == 0))


@check("VAL104", "draft")
def unplaced_assets() -> Column:
    is_table = lambda a: (F.lower(F.coalesce(a["asset_type"], F.lit(""))) == "table") | (F.lower(F.coalesce(a["role"], F.lit(""))) == "table_asset")
    wanted = F.exists("assets", lambda a: ~is_table(a)) | (F.exists("assets", is_table) & ~has_table(c("text")))
    return only(c("asset_required") & wanted & ~c("text").rlike(ASSET))


@check("VAL103", "bundle")
def weak_evidence() -> Column:
    accepted = (c("fallback_count") >= 1) & (c("fallback_top") >= FALLBACK)
    return only(F.coalesce(c("quality") < EVIDENCE, F.lit(True)) & ~F.coalesce(accepted, F.lit(False)), F.array(F.when(c("fallback_count") > 0, F.lit("case_fallback")).otherwise(F.lit("empty"))))


@dataclass(frozen=True)
class Inputs:
    cards: DataFrame
    sections: DataFrame
    drafts: DataFrame
    bundles: DataFrame
    reuse: DataFrame | None = None


def _whole(df: DataFrame, **defaults: Column) -> DataFrame:
    return df.withColumns({name: F.coalesce(c(name), value) for name, value in defaults.items()})


def tables(inputs: Inputs) -> dict[str, DataFrame]:
    """What the rules read, by name: an equi-join each, with empty values for what is missing; every row has section_id and section_title."""
    strings, words, pairs, no = none(), F.lit(""), F.create_map().cast("map<string,string>"), F.lit(False)
    alone = {"section_id": F.lit(None).cast("string"), "section_title": F.lit(None).cast("string")}
    drafts = inputs.drafts.withColumns({"text": F.coalesce("text", words), "title": F.coalesce("title", words)})
    outline = inputs.sections.select("project_id", "section_id", c("title").alias("outline_title"), "evidence_types", "needs_review", "parameter_sensitive", "specificity", "asset_required")
    rows = drafts.join(outline, ["project_id", "section_id"], "left").join(inputs.bundles.select("project_id", "evidence_ids"), "project_id", "left")
    if inputs.reuse is not None:
        rows = rows.join(inputs.reuse.select("project_id", "section_id", c("score").alias("reuse_score")), ["project_id", "section_id"], "left")
    else:
        rows = rows.withColumn("reuse_score", F.lit(None).cast("double"))
    asset = F.array().cast("array<struct<asset_id:string,asset_type:string,role:string,risk:string>>")
    rows = _whole(rows, evidence_types=strings, evidence_ids=strings, assumptions=strings, banned=strings, must_replace=strings, block_ids=strings, assets=asset, hints=pairs, needs_review=no, parameter_sensitive=no, asset_required=no, figure_confirmed=no)
    rows = _whole(rows, citations=F.array().cast("array<struct<evidence_id:string,source_doc_id:string,source_title:string>>"), outline_title=words).withColumn("section_title", c("title"))
    written = drafts.groupBy("project_id", "section_id").agg(F.max_by("text", F.length(F.trim("text"))).alias("text"))
    sections = _whole(inputs.sections.join(written, ["project_id", "section_id"], "left"), text=words, mandatory=no).withColumn("section_title", c("title"))
    told = inputs.cards.select("project_id", F.explode("params").alias("param", "value")).union(inputs.drafts.select("project_id", F.explode("params").alias("param", "value")))
    values = told.withColumn("value", F.trim("value")).filter("value <> ''").groupBy("project_id", "param").agg(F.collect_set("value").alias("values")).withColumns(alone)  # what one project calls a parameter
    return {"card": _whole(inputs.cards, blockers=F.array().cast("array<struct<field:string,status:string>>")).withColumns(alone), "section": sections, "param": values, "draft": rows, "bundle": inputs.bundles.withColumns(alone)}


def findings(inputs: Inputs, codes: tuple[str, ...] | None = None) -> DataFrame:
    """All findings, or those of some codes; each table is read once, whatever the number of its rules."""
    out = []
    for name, rows in tables(inputs).items():
        own = [k for k in CHECKS if k.over == name and (codes is None or k.code in codes)]
        if not own:
            continue
        every = F.array(*(F.struct(F.lit(k.kind).alias("kind"), F.lit(k.code).alias("code"), k.details().alias("details")) for k in own))
        found = rows.select("project_id", "section_id", "section_title", F.explode(F.filter(every, lambda i: F.size(i["details"]) > 0)).alias("i"))
        out.append(found.select("project_id", "i.kind", "i.code", F.when(c("i.kind") == "error", F.lit("P0")).otherwise(F.lit("P1")).alias("level"), "section_id", "section_title", "i.details"))
    return reduce(DataFrame.unionByName, out)


def status_of(found: DataFrame, projects: DataFrame, open_tasks: DataFrame) -> DataFrame:
    """(project_id, n_errors, n_warnings, status) of each project, by its findings and its open review tasks (project_id)."""
    issues = found.groupBy("project_id").agg(F.collect_set(F.when(c("kind") == "error", c("code"))).alias("codes"), F.count_if(c("kind") == "error").alias("n_errors"), F.count_if(c("kind") == "warning").alias("n_warnings"))  # codes are a few
    tasks = open_tasks.groupBy("project_id").agg(F.count("*").alias("open"))
    rows = projects.select("project_id").distinct().join(issues, "project_id", "left").join(tasks, "project_id", "left")
    zero = lambda n: F.coalesce(c(n), F.lit(0))
    return rows.select("project_id", zero("n_errors").alias("n_errors"), zero("n_warnings").alias("n_warnings"), D.validation_status(F.coalesce("codes", none()), zero("open")).alias("status"))


_VALIDATED = """SELECT doc_id, 'p' || CAST(doc_id % 97 AS STRING) AS project_id, 's' || CAST(doc_id AS STRING) AS section_id, CASE doc_id % 6 WHEN 0 THEN '系统 配置' WHEN 1 THEN 'Intro the' WHEN 2 THEN '' WHEN 3 THEN source ELSE 'Scope/und' END AS title,
    CASE WHEN doc_id % 19 = 0 THEN ' ' ELSE CASE doc_id % 23 WHEN 0 THEN '### A. First' || chr(10) WHEN 1 THEN '### 概述' || chr(10) WHEN 2 THEN '### 推荐资产' || chr(10) ELSE '' END || substr(text, 1, 30 + doc_id % 400) || CASE doc_id % 11 WHEN 0 THEN chr(10) || '待确认 the rest' WHEN 1 THEN chr(10) || '| TBD |' WHEN 2 THEN chr(10) || '# 待确认事项' || chr(10) || '待确认 x' WHEN 3 THEN chr(10) || '说明 暂定' WHEN 4 THEN chr(10) || '注 待确认' ELSE '' END
      || CASE doc_id % 7 WHEN 0 THEN chr(10) || '[Company_A] and ' || chr(123) || chr(123) || 'x y' || chr(125) || chr(125) || ' [Company_A]' WHEN 1 THEN ' 10 kV, 3台 and 2 套' WHEN 2 THEN chr(10) || '| a | b |' || chr(10) || '| --- | --- |' ELSE '' END || CASE doc_id % 5 WHEN 0 THEN ' [[ASSET:FIGURE:a1]]' WHEN 1 THEN ' [[ASSET:TABLE:a2]] [[ASSET:FORMULA: a3 ]]' ELSE '' END END AS text,
    CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'e1|d|t' WHEN 2 THEN 'e1|d|t,e9|d|t' ELSE 'e2||t,b1|d|t,e7|d|t' END AS citations, CASE WHEN doc_id % 8 = 0 THEN 'known' ELSE '' END AS assumptions, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'volt= 10kV ,power=' || CAST(doc_id % 2 AS STRING) ELSE 'volt=10kV' END AS params,
    CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a1|figure||high' WHEN 2 THEN 'a2|table||' ELSE 'a1|figure||low,a2||table_asset|critical' END AS assets, doc_id % 9 = 0 AS figure_confirmed, CASE doc_id % 3 WHEN 0 THEN ' the , ab,und ' ELSE '' END AS banned,
    CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'voltage_level=10KV,quantity=3 台2套' WHEN 2 THEN 'voltage_level=1 0 kV,quantity=7台,other=x' ELSE 'quantity=,voltage_level=e' END AS hints, CASE doc_id % 2 WHEN 0 THEN 'voltage_level,quantity' ELSE 'voltage_level,other' END AS must_replace,
    CASE doc_id % 5 WHEN 0 THEN 'Review_Required' WHEN 1 THEN 'passed' ELSE '' END AS gate_status, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE round(CAST(doc_id % 100 AS DOUBLE) / 100, 2) END AS gate_score, CASE doc_id % 6 WHEN 0 THEN 'full_section' ELSE 'other' END AS mode, CASE doc_id % 10 WHEN 0 THEN 'extractive_reuse_x' ELSE 'p' END AS trace_path,
    CASE doc_id % 4 WHEN 0 THEN 'final=0.5;semantic=0.4;rerank=0.6,hybrid=0.7' WHEN 1 THEN 'final=0.91234567;dense=0.3' ELSE '' END AS trace_blocks, CASE doc_id % 3 WHEN 0 THEN 'final=0.2' WHEN 1 THEN 'semantic=0.1;rerank=0.1' ELSE '' END AS trace_sections,
    CASE doc_id % 7 WHEN 0 THEN 'figure' WHEN 1 THEN 'text,parameter' ELSE '' END AS evidence_types, doc_id % 4 < 3 AS mandatory, doc_id % 2 = 0 AS needs_review, doc_id % 3 < 2 AS parameter_sensitive, doc_id % 5 < 3 AS asset_required FROM {documents}"""
_PROJECTS = """SELECT 'p' || CAST(n AS STRING) AS project_id, CASE n % 3 WHEN 0 THEN 'voltage|open,name|resolved' WHEN 1 THEN '' ELSE '|open' END AS blockers, CASE n % 2 WHEN 0 THEN 'volt=10kV,power=0' ELSE 'volt=6kV' END AS params, CASE n % 3 WHEN 0 THEN '' ELSE 'e1,e2' END AS evidence_ids,
    CASE n % 5 WHEN 0 THEN NULL ELSE round(CAST(n AS DOUBLE) / 100, 2) END AS quality, CAST(n % 4 AS INT) AS fallback_count, round(CAST(n % 10 AS DOUBLE) / 10, 1) AS fallback_top FROM (SELECT DISTINCT doc_id % 97 AS n FROM {documents})"""


def _inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    rows, projects = shaped(spark, sf_dir, _VALIDATED), shaped(spark, sf_dir, _PROJECTS)
    words = lambda x: F.filter(F.split(x, ","), lambda w: w != "")
    pairs = lambda x: F.map_from_entries(F.transform(words(c(x)), lambda p: F.struct(F.substring_index(p, "=", 1), F.substring_index(p, "=", -1))))
    records = lambda x, *names: F.transform(words(c(x)), lambda p: F.struct(*(F.get(F.split(p, "[|]"), F.lit(n)).alias(name) for n, name in enumerate(names))))
    traces = lambda x: F.transform(words(c(x)), lambda t: F.map_from_entries(F.transform(F.split(t, ";"), lambda p: F.struct(F.substring_index(p, "=", 1), F.substring_index(p, "=", -1).cast("double")))))
    drafts = rows.withColumns({"citations": records("citations", "evidence_id", "source_doc_id", "source_title"), "assets": records("assets", "asset_id", "asset_type", "role", "risk"), "params": pairs("params"), "hints": pairs("hints"), "block_ids": F.array(F.lit("b1"))})
    drafts = drafts.withColumns({n: words(c(n)) for n in ("assumptions", "must_replace", "evidence_types")} | {"banned": F.split("banned", ",")})
    drafts = drafts.withColumns({"gate": F.struct(c("gate_status").alias("status"), c("gate_score").alias("score")), "retrieval": F.struct(c("mode"), c("trace_path").alias("path"), traces("trace_blocks").alias("blocks"), traces("trace_sections").alias("sections"))})
    sections = drafts.select("project_id", "section_id", "title", "mandatory", "evidence_types", "needs_review", "parameter_sensitive", F.lit("medium").alias("specificity"), "asset_required")
    cards = projects.select("project_id", records("blockers", "field", "status").alias("blockers"), pairs("params").alias("params"))
    return Inputs(cards, sections, drafts.drop("evidence_types", "needs_review", "parameter_sensitive", "asset_required", "mandatory"), projects.select("project_id", words(c("evidence_ids")).alias("evidence_ids"), "quality", "fallback_count", "fallback_top"))


def _sql_findings() -> str:
    """The findings of these tables, rule by rule, in DuckDB's SQL."""
    split = lambda x: f"list_filter(string_split({x}, ','), lambda w: w <> '')"
    anyof = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
    value = lambda key, of: f"list_filter(list_transform({split(of)}, lambda p: CASE WHEN string_split(p, '=')[1] = {key} THEN string_split(p, '=')[-1] END), lambda v: v IS NOT NULL)[1]"
    pairs = lambda x: f"list_sort(list_distinct(regexp_extract_all(lower(regexp_replace({x}, '\\s+', '', 'g')), '{QUANTITY}')))"
    bare = lambda x: f"lower(regexp_replace({x}, '\\s+', '', 'g'))"
    told = f"(NOT {anyof('x', LOOSE)} AND (starts_with(x, '|') OR starts_with(x, '注') OR starts_with(x, '说明') OR (starts_with(x, '#') AND (contains(x, '待确认') OR contains(x, '后续确认'))) OR {anyof('x', DECLARED)}))"
    num = lambda name: f"TRY_CAST(nullif(regexp_extract(t, '(?:^|;){name}=([0-9.]+)', 1), '') AS DOUBLE)"
    mean = lambda *names: f"round(list_avg(list_filter(list_transform(traces, lambda t: round(coalesce({', '.join(num(n) for n in names)}), 4)), lambda v: v IS NOT NULL)), 4)"
    strip = D._STRIP.format("text")
    table = f"(regexp_matches(text, '{TABLE_ROW}') AND regexp_matches(text, '{TABLE_RULE}'))"
    level = lambda code: "'warning' AS kind, '%s' AS code, 'P1' AS level" % code if code in WARNINGS else "'error' AS kind, '%s' AS code, 'P0' AS level" % code
    rule = lambda code, details, of="e": f"SELECT project_id, {level(code)}, section_id, section_title, {details} AS details FROM {of}"
    when = lambda test, details="['']": f"CASE WHEN coalesce({test}, FALSE) THEN {details} ELSE [] END"
    titles = f"list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {D._STRIP.format('x')}), lambda x: regexp_matches(x, '^#{{3,6}}\\s+\\S')), lambda x: {D._STRIP.format('regexp_replace(x, chr(94) || chr(35) || chr(123) || chr(50) || chr(44) || chr(54) || chr(125) || chr(92) || chr(115) || chr(43), chr(0))')})"
    titles = titles.replace("chr(94) || chr(35) || chr(123) || chr(50) || chr(44) || chr(54) || chr(125) || chr(92) || chr(115) || chr(43), chr(0)", "'^#{2,6}\\s+', ''")
    missing = f"list_filter(expected, lambda f: NOT (contains({bare('text')}, {bare('trim(' + value('f', 'hints') + ')')}) OR (f = 'quantity' AND len({pairs(value('f', 'hints'))}) > 0 AND len(list_filter({pairs(value('f', 'hints'))}, lambda q: NOT list_contains({pairs('text')}, q))) = 0)))"
    return f"""WITH d AS (SELECT *, title AS section_title FROM ({plain(_VALIDATED)})), p AS (SELECT * RENAME (evidence_ids AS known) FROM ({plain(_PROJECTS)})),
    a AS (SELECT d.*, p.known, {strip} AS bare, {split('citations')} AS cites, {split('assets')} AS things, {table} AS has_table, {titles} AS heads, list_filter({split('must_replace')}, lambda f: list_contains({list(REPLACED)!r}, f) AND coalesce({value('f', 'hints')}, '') <> '' AND parameter_sensitive) AS expected,
      CASE WHEN trace_blocks <> '' THEN {split('trace_blocks')} ELSE {split('trace_sections')} END AS traces FROM d LEFT JOIN p USING (project_id)),
    b AS (SELECT *, {missing} AS missing, list_filter(heads, lambda h: regexp_matches(h, '{D.NOTE_HEADING}')) AS h1, list_filter(heads, lambda h: regexp_matches(h, '{D.LETTER_HEADING}')) AS h2, list_filter(heads, lambda h: regexp_matches(h, '{D.EMPTY_HEADING}') AND NOT contains(title, h)) AS h3, {mean('final', 'hybrid')} AS m_final, {mean('semantic', 'dense')} AS m_sem, {mean('rerank')} AS m_rank,
      list_filter(list_transform(string_split(text, chr(10)), lambda x: {D._STRIP.format('x')}), lambda x: x <> '') AS rows, list_zip(regexp_extract_all(text, '{ASSET}', 1), regexp_extract_all(text, '{ASSET}', 2)) AS placed FROM a),
    e AS (SELECT *, list_transform(rows, lambda x, i: {{'x': x, 'head': list_filter(list_transform(list_slice(rows, 1, i), lambda y: CASE WHEN starts_with(y, '#') THEN y END), lambda y: y IS NOT NULL)[-1]}}) AS placed_rows FROM b),
    v AS (SELECT project_id, string_split(x, '=')[1] AS param, trim(string_split(x, '=')[-1]) AS value FROM (SELECT project_id, unnest({split('params')}) AS x FROM d UNION ALL SELECT project_id, unnest({split('params')}) FROM p)), w AS (SELECT project_id, NULL::VARCHAR AS section_id, NULL::VARCHAR AS section_title, param, list_sort(list(DISTINCT value)) AS vals FROM v WHERE value <> '' GROUP BY 1, 4),
    q AS (SELECT *, NULL::VARCHAR AS section_id, NULL::VARCHAR AS section_title FROM p),
    f AS ({" UNION ALL ".join([
        rule("VAL001", f"list_transform(list_filter({split('blockers')}, lambda x: string_split(x, '|')[2] <> 'resolved'), lambda x: coalesce(nullif(string_split(x, '|')[1], ''), 'unknown'))", "q"),
        rule("VAL002", when(f"mandatory AND {bare('text')} = ''")),
        rule("VAL003", when("len(vals) > 1", "list_concat([param], vals)"), "w"),
        rule("VAL004", when(f"({anyof('title', TECHNICAL)} OR len(list_filter({split('evidence_types')}, lambda t: list_contains({list(TECHNICAL_EVIDENCE)!r}, t))) > 0) AND len(cites) = 0")),
        rule("VAL005", "list_filter(list_transform(cites, lambda r: CASE WHEN string_split(r, '|')[1] = '' OR string_split(r, '|')[2] = '' OR string_split(r, '|')[3] = '' THEN 'missing_required_fields' WHEN known <> '' AND NOT contains(known, string_split(r, '|')[1]) AND string_split(r, '|')[1] <> 'b1' THEN 'unknown_evidence_id:' || string_split(r, '|')[1] END), lambda x: x IS NOT NULL)"),
        rule("VAL006", when("needs_review AND NOT figure_confirmed", "list_transform(list_filter(placed, lambda z: CASE z[1] WHEN 'TABLE' THEN NOT has_table AND NOT contains(assets, 'a2||table_asset') OR (z[1] = 'TABLE' AND NOT has_table AND contains(assets, 'a2||table_asset')) WHEN 'FIGURE' THEN contains(assets, 'a1|figure||high') ELSE TRUE END), lambda z: trim(z[2]))")),
        rule("VAL007", f"list_sort(list_distinct(regexp_extract_all(text, '{NAME_PLACEHOLDER}') || regexp_extract_all(text, '{BRACE_PLACEHOLDER}')))"),
        rule("VAL008", "list_filter(list_transform(string_split(banned, ','), lambda t: trim(t)), lambda t: length(t) >= 3 AND contains(text, t))"),
        rule("VAL009", when("len(missing) = len(expected)", "missing")),
        rule("VAL106", when("len(missing) < len(expected)", "missing")),
        rule("VAL010", "list_transform(h1, lambda h: 'SQ001:' || h) || list_transform(h2, lambda h: 'SQ002:' || h)"),
        rule("VAL107", when("len(h1) + len(h2) = 0", "list_transform(h3, lambda h: 'SQ003:' || h)")),
        rule("VAL108", when(f"lower(gate_status) = 'review_required' OR coalesce(gate_score < {GATE}, FALSE)", "[lower(gate_status)]")),
        rule("VAL109", when("trace_blocks <> '' OR trace_sections <> '' OR mode = 'full_section' OR starts_with(trace_path, 'extractive_reuse')", f"list_filter([CASE WHEN len(traces) = 0 THEN 'missing_structured_trace' END, CASE WHEN m_final < {FINAL} THEN 'low_final_score' END, CASE WHEN m_sem < {SEMANTIC} AND (m_rank IS NULL OR m_rank < {RERANKED}) THEN 'low_semantic_and_rerank' END], lambda x: x IS NOT NULL)")),
        rule("VAL101", when(f"length(bare) < {SHORT} OR (len(list_filter(regexp_split_to_array(trim(title), '[\\s/、，,（）()]+'), lambda k: length(k) >= 2)) > 0 AND len(list_filter(regexp_split_to_array(trim(title), '[\\s/、，,（）()]+'), lambda k: length(k) >= 2 AND contains(bare, k))) = 0)")),
        rule("VAL102", when(f"assumptions = '' AND len(list_filter(placed_rows, lambda r: NOT starts_with(r.x, '#') AND {anyof('r.x', ASSUMED)} AND NOT {told.replace('(x,', '(r.x,')} AND NOT coalesce({anyof('r.head', ASSUMED)} AND {told.replace('(x,', '(r.head,')}, FALSE))) > 0")),
        rule("VAL104", when(f"asset_required AND (contains(assets, '|figure|') OR (contains(assets, 'table') AND NOT has_table)) AND NOT regexp_matches(text, '{ASSET}')")),
        rule("VAL103", when(f"coalesce(quality < {EVIDENCE}, TRUE) AND NOT (fallback_count >= 1 AND fallback_top >= {FALLBACK})", "[CASE WHEN fallback_count > 0 THEN 'case_fallback' ELSE 'empty' END]"), "q"),
    ])})"""  # fmt: skip


@query(_sql_findings() + " SELECT project_id, kind, code, level, section_id, array_to_string(details, ';') AS details FROM f WHERE len(details) > 0")
def validation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule but the reuse of material (a unit test has it) finds in the projects' cards, outlines, drafts and evidence."""
    return findings(_inputs(spark, sf_dir)).select("project_id", "kind", "code", "level", "section_id", F.array_join("details", ";").alias("details"))


@query(
    f"""{_sql_findings()}, g AS (SELECT project_id, count(*) FILTER (WHERE kind = 'error') AS n_errors, count(*) FILTER (WHERE kind = 'warning') AS n_warnings, bool_or(kind = 'error' AND code IN {D.in_list(D.HARD)}) AS hard, count(*) FILTER (WHERE (kind = 'error' AND code IN ('VAL003', 'VAL006', 'VAL108')) OR (kind = 'warning' AND code IN {D.in_list(D.REVIEW)})) AS tasks FROM f WHERE len(details) > 0 GROUP BY 1)
    SELECT project_id, coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings, CASE WHEN hard THEN 'blocked' WHEN tasks > 0 THEN 'review_required' ELSE 'passed' END AS status FROM p LEFT JOIN g USING (project_id)"""
)
def project_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's findings, as counts, and whether it is blocked, to be reviewed, or passed."""
    inputs = _inputs(spark, sf_dir)
    found = findings(inputs)
    tasks = D.review_tasks(found.withColumns({"param": F.get("details", F.lit(0)), "draft_version": c("project_id")}), found.select(F.lit(None).cast("string").alias("signature")).limit(0))
    return status_of(found, inputs.cards, tasks.select(F.split("signature", ":")[1].alias("project_id")))
