"""Requirement cards: what a project's fields and its requirement document say, what is missing, and how sure that is.

One plan composes the excerpt of the document, the objective, the questions to ask and the next version of each project's
card. Null fields count as missing; a project without a document has an empty context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import stripped
from ..operators.excerpts import requirement_excerpts
from ..operators.records import next_versions
from ..registry import plain, query, shaped

#: Characters of a preview and of an objective; sentences that tell an objective; words of internal notes.
PREVIEW, OBJECTIVE = 600, 180
TELLING = (r"(本项目[^。！？]{0,180}[。！？]?)", r"(项目面向[^。！？]{0,180}[。！？]?)", r"(方案采用[^。！？]{0,180}[。！？]?)")
INTERNAL = ("review", "质量审查", "质量review", "导出", "导出稿", "draft", "smoke", "联调", "测试", "验证", "llm", "prompt", "模型", "闭环", "relay")
#: Fields to ask for, with their priority and whether they block; how sure a card is: while its document is parsed, with a context, and without.
ASKED = (("product_line", "p0", True), ("industry", "p1", False), ("business_objective", "p1", False))
PENDING, CONFIDENT, UNSURE = 0.55, 0.82, 0.65


def summarised(context: Column) -> Column:
    """An objective from a text: the first telling sentence, or its beginning, without headings, tables and rules."""
    lines = F.filter(F.transform(F.split(context, "\n"), stripped), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("|") & ~x.rlike(r"^[-:\s|]+$"))
    flat = F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " "))
    bare = lambda x: F.regexp_replace(x, "[。！？]+$", "")
    found = F.when(F.lit(False), F.lit(""))
    for pattern in TELLING:
        found = found.when(flat.rlike(pattern), bare(F.trim(F.regexp_extract(flat, pattern, 1))))
    return found.otherwise(bare(F.substring(flat, 1, OBJECTIVE)))


def requirement_cards(projects: DataFrame, documents: DataFrame, cards: DataFrame, most: int, internal: tuple[str, ...] = INTERNAL, **words: tuple[str, ...]) -> DataFrame:
    """(project_id, version, objective, context, preview, missing, blocking, confidence, status) of each project's new card.

    projects: (project_id, product_line, industry, description, rfp_id); documents: (doc_id, text, status); cards: (project_id,
    version), those that exist. A project whose document is still being parsed has a card from its description, or none without one.
    words: headings and markers of requirements (see ``excerpts``).
    """
    c = F.col
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    context = requirement_excerpts(documents.filter(F.coalesce("status", F.lit("")) != "parsing").select("doc_id", "text"), most, **words).select(c("doc_id").alias("rfp_id"), stripped(c("excerpt")).alias("context"))
    states = documents.select(c("doc_id").alias("rfp_id"), (F.coalesce("status", F.lit("")) == "parsing").alias("pending"))
    rows = projects.join(states, "rfp_id", "left").join(context, "rfp_id", "left").withColumns({"pending": F.coalesce("pending", F.lit(False)), "context": F.coalesce("context", F.lit(""))})
    rows = rows.filter(~c("pending") | ~blank(c("description")))
    own = F.trim(F.coalesce("description", F.lit("")))
    noted = F.exists(F.array(*map(F.lit, internal)), lambda t: F.lower(own).contains(t))
    rows = rows.withColumn("objective", F.when((own != "") & ~noted, own).otherwise(summarised(c("context"))))
    value = {"product_line": F.coalesce("product_line", F.lit("")), "industry": F.coalesce("industry", F.lit("")), "business_objective": c("objective")}
    missing = F.array_compact(F.array(*(F.when(value[n] == "", F.lit(f"{n}_{p}")) for n, p, _ in ASKED), F.when(c("pending"), F.lit("rfp_parse_pending"))))
    blocking = F.array_compact(F.array(*(F.when(value[n] == "", F.lit(f"{n}_{p}")) for n, p, blocks in ASKED if blocks)))
    sure = F.when(c("pending"), F.lit(PENDING)).when(c("context") != "", F.lit(CONFIDENT)).otherwise(F.lit(UNSURE))
    versions = next_versions(projects.select("project_id", F.lit(0).alias("current_version")), cards)
    found = rows.withColumns({"missing": missing, "blocking": blocking, "confidence": sure}).join(versions, "project_id")
    status = F.when(F.size("blocking") > 0, F.lit("BLOCKED_FOR_CLARIFICATION")).otherwise(F.lit("REQUIREMENT_DRAFTED"))
    return found.select("project_id", c("next_version").alias("version"), "objective", "context", F.substring("context", 1, PREVIEW).alias("preview"), "missing", "blocking", "confidence", status.alias("status"))


_PROJECTS = "SELECT doc_id AS project_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE source END AS product_line, CASE doc_id % 3 WHEN 0 THEN '' ELSE lang END AS industry, CASE doc_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'Demo of it' WHEN 2 THEN NULL ELSE ' Upgrade ' || lang END AS description, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id END AS rfp_id FROM {documents}"
_RFPS = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '# head' || chr(10) || '| t |' || chr(10) || '概述 本项目 采用 the' || lang || '。 more' WHEN 1 THEN '' ELSE substr(text, 1, 700) END AS text, CASE doc_id % 9 WHEN 0 THEN 'parsing' ELSE 'done' END AS status FROM {documents}"
_OLD = "SELECT doc_id AS project_id, doc_id % 4 AS version FROM {documents} WHERE doc_id % 3 = 1"
_S = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


@query(
    rf"""WITH p AS (SELECT p.*, coalesce(r.status = 'parsing', FALSE) AS pending, CASE WHEN r.status <> 'parsing' THEN {_S.format('r.text')} ELSE '' END AS c FROM ({plain(_PROJECTS)}) p LEFT JOIN ({plain(_RFPS)}) r ON r.doc_id = p.rfp_id), q AS (SELECT * EXCLUDE (c), coalesce(c, '') AS context, trim(coalesce(description, '')) AS own FROM p WHERE NOT pending OR trim(coalesce(description, '')) <> ''),
    f AS (SELECT *, trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(context, chr(10)), lambda x: {_S.format('x')}), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '|') AND NOT regexp_matches(x, '^[-:\s|]+$')), ' '), '\s+', ' ', 'g'), ' ') AS flat FROM q),
    o AS (SELECT *, CASE WHEN own <> '' AND NOT contains(lower(own), 'demo') THEN own WHEN regexp_matches(flat, '{TELLING[0]}') THEN regexp_replace(trim(regexp_extract(flat, '{TELLING[0]}', 1)), '[。！？]+$', '') ELSE regexp_replace(substr(flat, 1, 180), '[。！？]+$', '') END AS objective FROM f)
    SELECT o.project_id, greatest(0, coalesce(v.version, 0)) + 1 AS version, objective, sha256(context) AS context, length(substr(context, 1, 600)) AS n_preview, array_to_string(list_filter([CASE WHEN coalesce(product_line, '') = '' THEN 'product_line_p0' END, CASE WHEN coalesce(industry, '') = '' THEN 'industry_p1' END, CASE WHEN objective = '' THEN 'business_objective_p1' END, CASE WHEN pending THEN 'rfp_parse_pending' END], lambda x: x IS NOT NULL), ',') AS missing,
      CASE WHEN pending THEN 0.55 WHEN context <> '' THEN 0.82 ELSE 0.65 END::DOUBLE AS confidence, CASE WHEN coalesce(product_line, '') = '' THEN 'BLOCKED_FOR_CLARIFICATION' ELSE 'REQUIREMENT_DRAFTED' END AS status FROM o LEFT JOIN ({plain(_OLD)}) v ON v.project_id = o.project_id"""
)
def requirement_card_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next requirement card of each project, from documents that fit the budget."""
    found = requirement_cards(shaped(spark, sf_dir, _PROJECTS), shaped(spark, sf_dir, _RFPS), shaped(spark, sf_dir, _OLD), 1000, ("demo",))
    return found.select("project_id", "version", "objective", F.sha2("context", 256).alias("context"), F.length("preview").alias("n_preview"), F.array_join("missing", ",").alias("missing"), "confidence", "status")
