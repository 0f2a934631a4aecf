"""Drafts judged by rules: headings, style, terms, repeats, placeholders, evidence; review tasks and status."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..functions import text as T
from ..functions.matching import Second
from ..registry import plain, query, shaped

#: Patterns of headings that are notes of the editor's, numbered in letters or say nothing; of phrases and voices that do not belong into a text.
NOTE_HEADING = "^(建议插入图表|建议图表|建议参考资产|推荐资产|可用参考资料|可用复用包|替换与禁用约束|参考摘要|图表建议|插图建议|图表清单)$"
LETTER_HEADING, EMPTY_HEADING = r"^[A-Z]\.\s*[^\n]+$", "^(概述|说明|补充说明|其他|附加说明)$"
PHRASES = "综上所述|总之|具有(较强|良好|显著)?(先进性|可靠性|经济性|前瞻性)|处于(国内|行业)?领先水平|经过(我们|本团队|研发团队)?(深入研究|反复验证)"
VOICES = "我们|本团队|研发团队|内部测试"
#: Section classes and words of technical sections, and from how many visible characters they are long enough.
TECHNICAL_CLASSES, TECHNICAL_WORDS, TECHNICAL_CHARS = ("architecture", "configuration", "implementation", "custom"), ("技术", "架构", "配置", "参数", "实施", "系统", "方案", "控制", "接口", "主回路"), 300
#: Similarity and length from which paragraphs count as repeated, as duplicates, and as reused.
REPEATED, REPEATED_CHARS, DUPLICATE, DUPLICATE_CHARS, REUSED_CHARS = 0.78, 40, 0.96, 90, 60
#: Codes that block a project, those of errors that ask for a review, and those of warnings that do.
HARD = ("VAL001", "VAL002", "VAL004", "VAL005", "VAL007", "VAL008", "VAL009", "VAL010")
BLOCKING_REVIEW, REVIEW = ("VAL108",), ("VAL101", "VAL102", "VAL103", "VAL104", "VAL105", "VAL106", "VAL107", "VAL108", "VAL109")
SEVERITY = {"SQ001": "high", "SQ002": "high", "SQ003": "medium", "SQ004": "medium", "SQ010": "medium", "SQ011": "high", "SQ013": "medium", "KW001": "medium", "KW010": "medium"}
ASSET = r"\[\[ASSET:[A-Z]+:[^\]]+\]\]"


def in_list(codes: tuple[str, ...]) -> str:
    """A list for SQL."""
    return "(" + ", ".join(f"'{x}'" for x in codes) + ")"


def draft_headings(text: Column) -> Column:
    """array<struct<level, title>> of the headings from the second level on."""
    found = F.filter(F.transform(C.lines(text), C.stripped), lambda x: x.rlike(r"^#{2,6}\s+\S"))
    return F.transform(found, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#{2,6})", 1)).alias("level"), C.stripped(F.regexp_replace(x, r"^#{2,6}\s+", "")).alias("title")))


def heading_issues(title: Column, text: Column) -> Column:
    """array<struct<code, target>>: notes, letters, empty words and repeats among the headings below the second level."""
    own = F.transform(F.filter(draft_headings(text), lambda h: h["level"] > 2), lambda h: h["title"])
    issue = lambda code, x: F.struct(F.lit(code).alias("code"), x.alias("target"))
    each = lambda code, test: F.transform(F.filter(own, test), lambda x: issue(code, x))
    again = F.filter(own, lambda x, i: F.array_contains(F.transform(F.slice(own, F.lit(1), i), F.lower), F.lower(x)))
    return F.array_distinct(
        F.concat(
            each("SQ001", lambda x: x.rlike(NOTE_HEADING)),
            each("SQ002", lambda x: x.rlike(LETTER_HEADING)),
            each("SQ003", lambda x: x.rlike(EMPTY_HEADING) & ~title.contains(x)),
            F.transform(again, lambda x: issue("SQ004", x)),
        )
    )


def body(text: Column) -> Column:
    """The text without headings and lines of placeholders, cut at blank lines: array<string> of paragraphs."""
    left_out = lambda x: (x.contains("##") & C.stripped(x).rlike(r"^#{2,6}\s+\S")) | (x.contains("[[ASSET:") & x.rlike(ASSET))
    kept = F.filter(C.lines(F.coalesce(text, F.lit(""))), lambda x: ~left_out(x))
    joined = F.array_join(F.transform(kept, lambda x: F.when(x.rlike(r"\S"), F.rtrim(x)).otherwise(F.lit(""))), "\n")
    return F.filter(F.transform(F.split(joined, r"\n\s*\n"), C.stripped), lambda p: p != "")


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"[`*_>#\-|]", ""))


def content_issues(title: Column, section_class: Column, text: Column, forbidden: list[str], glossary: list[tuple[str, list[str]]]) -> Column:
    """array<struct<code, target>>: empty phrases, inner voices, forbidden phrases, mixed terms, and technical sections that are too short."""
    found = lambda whole: C.once(F.lower(whole), lambda low: _content_issues(title, section_class, whole, low, forbidden, glossary))
    return C.once(F.array_join(body(text), "\n\n"), found)


def _content_issues(title: Column, section_class: Column, whole: Column, low: Column, forbidden: list[str], glossary: list[tuple[str, list[str]]]) -> Column:
    issue = lambda code, x: F.struct(F.lit(code).alias("code"), x.alias("target"))
    technical = F.lower(section_class).isin(*TECHNICAL_CLASSES) | title.rlike("|".join(TECHNICAL_WORDS))
    found = [
        F.when(whole.rlike(PHRASES), issue("SQ010", F.regexp_extract(whole, f"({PHRASES})", 1))),
        F.when(whole.rlike(VOICES), issue("SQ011", F.regexp_extract(whole, f"({VOICES})", 1))),
        F.when(technical & (visible_chars(whole) < TECHNICAL_CHARS), issue("SQ013", F.lit(""))),
        *(F.when(low.contains(p.lower()), issue("KW001", F.lit(p))) for p in forbidden),
    ]
    for term, others in glossary:
        total = lambda counts: F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + n)
        mixed = lambda counts: (F.size(F.filter(counts, lambda n: n > 0)) >= 2) & (total(F.slice(counts, 2, 1 + len(others))) >= 1) & (total(counts) >= 3)
        found.append(F.when(C.once(F.array(*(T.word_occurrences(low, t) for t in (term, *others))), mixed), issue("KW010", F.lit(term))))
    return F.when(whole != "", F.array_compact(F.array(*found))).otherwise(F.array().cast("array<struct<code:string,target:string>>"))


def plain_similarity(text: Column) -> Column:
    """The form in which texts are compared: no placeholders, no markup, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSET, " "), r"[#>*`_\-|\[\]()]", " "), r"\s+", " ")))


def ratio(a: str, b: Second, least: float, counts: dict[str, int] | None = None) -> float:
    """How similar two texts are by their matching stretches; 0 where bounds already say that it is below ``least``. counts: of a's characters."""
    both = len(a) + len(b.y)
    if not a or not b.y or 2 * min(len(a), len(b.y)) < least * both:
        return 0.0
    if 2.0 * b.common(counts or Counter(a)) / both < least or not b.long and 2.0 * b.at_most(a) / both < least:
        return 0.0
    return b.ratio(a)


def repeats(parts: list[str]) -> Iterator[tuple[int, int, float]]:
    """(place of the first, of the second, ratio) of the paragraphs of a draft that say the same; what a text needs is worked out once."""
    seconds: dict[int, Second] = {}
    able = [i for i, p in enumerate(parts) if len(p) >= REPEATED_CHARS]
    for k, i in enumerate(able):
        a = parts[i]
        counts = seconds[i].counts if i in seconds else Counter(a)
        for j in able[k + 1 :]:
            if 2 * min(len(a), len(parts[j])) < REPEATED * (len(a) + len(parts[j])):
                continue
            if j not in seconds:
                seconds[j] = Second(parts[j])
            if (r := ratio(a, seconds[j], REPEATED, counts)) >= REPEATED:
                yield i + 1, j + 1, r
        seconds.pop(i, None)


def repeated_paragraphs(drafts: DataFrame, most: int = 2) -> DataFrame:
    """(draft_id, first, second, similarity): the first pairs of paragraphs of a draft that say the same."""
    kind = drafts.schema["draft_id"].dataType.simpleString()
    rows = drafts.select("draft_id", F.transform(body(F.col("text")), plain_similarity).alias("paragraphs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for draft, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(draft, *h) for h in islice(repeats(parts), most)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((batch.schema.field(0).type, pa.int32(), pa.int32(), pa.float64()))], names=["draft_id", "first", "second", "similarity"])

    return rows.mapInArrow(run, f"draft_id {kind}, first int, second int, similarity double")


def review_tasks(issues: DataFrame, existing: DataFrame) -> DataFrame:
    """(signature, task_type, level, code, section_id) of issues (kind, code, section_id, param, draft_version) that ask for one, without repeats and those that exist."""
    c = F.col
    error = c("kind") == "error"
    task = F.when(error & c("code").isin(*BLOCKING_REVIEW), F.lit("content_review")).when(error & (c("code") == "VAL003"), F.lit("param_conflict")).when(error & (c("code") == "VAL006"), F.lit("figure_confirm")).when((c("kind") == "warning") & c("code").isin(*REVIEW), F.lit("content_review"))
    section = F.when(task == "param_conflict", F.lit("-")).otherwise(F.coalesce(F.nullif(c("section_id"), F.lit("")), F.lit("-")))
    signature = F.concat_ws(":", task, c("draft_version").cast("string"), section, "code", F.when(task == "param_conflict", F.coalesce("param", F.lit("unknown"))))
    rows = issues.select(signature.alias("signature"), task.alias("task_type"), F.when(error, F.lit("P0")).otherwise(F.lit("P1")).alias("level"), "code", section.alias("section_id")).filter(task.isNotNull())
    first = rows.groupBy("signature").agg(F.min(F.struct("level", "task_type", "code", "section_id")).alias("t")).select("signature", "t.task_type", "t.level", "t.code", "t.section_id")
    return first.join(existing.select("signature"), "signature", "left_anti")


def validation_status(codes: Column, open_tasks: Column) -> Column:
    """blocked, review_required or passed, from an array of error codes and the number of open tasks."""
    hard = F.arrays_overlap(codes, F.array(*map(F.lit, HARD)))
    return F.when(hard, F.lit("blocked")).when(open_tasks > 0, F.lit("review_required")).otherwise(F.lit("passed"))


def writing_metrics(text: Column, residue: str, filler: str) -> Column:
    """struct<paragraphs, residue, filler, ratio>: paragraphs, hits of two patterns, and fillers a paragraph."""
    n = F.size(F.filter(F.split(text, r"\n\s*\n+"), lambda p: C.stripped(p) != ""))
    hits = F.regexp_count(text, F.lit(filler))
    return F.struct(n.alias("paragraphs"), F.regexp_count(text, F.lit(residue)).alias("residue"), hits.alias("filler"), (hits / F.greatest(n, F.lit(1))).alias("ratio"))


_DRAFTS = """SELECT doc_id AS draft_id, CASE doc_id % 4 WHEN 0 THEN '系统 方案' WHEN 1 THEN '概述 与范围' ELSE source END AS title, CASE WHEN doc_id % 6 = 0 THEN 'Architecture' ELSE 'intro' END AS section_class,
    '## ' || lang || chr(10) || '### 概述' || chr(10) || CASE doc_id % 5 WHEN 0 THEN '### A. First' || chr(10) WHEN 1 THEN '### 推荐资产' || chr(10) || '### a. first' || chr(10) || '### A. First' || chr(10) ELSE '' END || replace(text, chr(10), chr(10) || chr(10)) || CASE doc_id % 7 WHEN 0 THEN chr(10) || '总之, 我们 the VFD and lci. VFD' WHEN 1 THEN chr(10) || 'Use vfd, LCI; lci [[ASSET:FIGURE:12]]' ELSE '' END AS text FROM {documents}"""
_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_SQL_BODY = rf"""list_filter(list_transform(string_split_regex(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches({_STRIP.format('x')}, '^#{{2,6}}\s+\S') AND NOT regexp_matches(x, '{ASSET}')), lambda x: CASE WHEN {_STRIP.format('x')} = '' THEN '' ELSE rtrim(x, ' ') END), chr(10)), '\n\s*\n'), lambda p: {_STRIP.format('p')}), lambda p: p <> '')"""


@query(
    rf"""WITH d AS (SELECT draft_id, title, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: regexp_matches(x, '^#{{3,6}}\s+\S')), lambda x: {_STRIP.format("regexp_replace(x, '^#{2,6}\\s+', '')")}) AS own FROM ({plain(_DRAFTS)})),
    h AS (SELECT draft_id, title, own, unnest(own) AS target, generate_subscripts(own, 1) AS i FROM d), j AS (SELECT *, regexp_matches(target, '{NOTE_HEADING}') AS a, regexp_matches(target, '{LETTER_HEADING}') AS b, regexp_matches(target, '{EMPTY_HEADING}') AND NOT contains(title, target) AS c, list_contains(list_transform(list_slice(own, 1, i - 1), lambda x: lower(x)), lower(target)) AS d FROM h)
    SELECT draft_id, code, target FROM (SELECT draft_id, 'SQ001' AS code, target FROM j WHERE a UNION SELECT draft_id, 'SQ002', target FROM j WHERE b UNION SELECT draft_id, 'SQ003', target FROM j WHERE c UNION SELECT draft_id, 'SQ004', target FROM j WHERE d)"""
)
def heading_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the headings of drafts."""
    found = shaped(spark, sf_dir, _DRAFTS).select("draft_id", F.explode(heading_issues(F.col("title"), F.col("text"))).alias("i"))
    return found.select("draft_id", "i.code", "i.target")


_FORBIDDEN, _GLOSSARY = ["lci.", "idiot"], [("VFD", ["LCI"])]
_SQL_COUNT = lambda t: f"len(list_filter(regexp_extract_all(' ' || regexp_replace(lower(w), '([a-z0-9])({t})', '\\1_', 'g') || ' ', '{t}[^a-z0-9]'), lambda x: TRUE))"


@query(
    rf"""WITH d AS (SELECT draft_id, title, section_class, array_to_string({_SQL_BODY}, chr(10) || chr(10)) AS w FROM ({plain(_DRAFTS)})),
    e AS (SELECT *, {_SQL_COUNT("vfd")} AS n1, {_SQL_COUNT("lci")} AS n2, length(regexp_replace(regexp_replace(w, '\s+', '', 'g'), '[`*_>#\-|]', '', 'g')) AS visible FROM d WHERE w <> ''),
    f AS (SELECT draft_id, unnest([CASE WHEN regexp_matches(w, '{PHRASES}') THEN 'SQ010' END, CASE WHEN regexp_matches(w, '{VOICES}') THEN 'SQ011' END, CASE WHEN (lower(section_class) IN {TECHNICAL_CLASSES!r} OR regexp_matches(title, '{"|".join(TECHNICAL_WORDS)}')) AND visible < 300 THEN 'SQ013' END,
      CASE WHEN contains(lower(w), 'lci.') THEN 'KW001' END, CASE WHEN contains(lower(w), 'idiot') THEN 'KW001' END, CASE WHEN n1 > 0 AND n2 > 0 AND n1 + n2 >= 3 THEN 'KW010' END]) AS code FROM e) SELECT draft_id, code, count(*) AS n FROM f WHERE code IS NOT NULL GROUP BY 1, 2"""
)
def content_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the text of drafts, by code."""
    c = F.col
    found = shaped(spark, sf_dir, _DRAFTS).select("draft_id", F.explode(content_issues(c("title"), c("section_class"), c("text"), _FORBIDDEN, _GLOSSARY)).alias("i"))
    return found.groupBy("draft_id", F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


_ISSUES = """SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'warning' ELSE 'error' END AS kind, 'VAL' || CASE l_partkey % 9 WHEN 0 THEN '003' WHEN 1 THEN '006' WHEN 2 THEN '108' WHEN 3 THEN '101' WHEN 4 THEN '105' WHEN 5 THEN '008' WHEN 6 THEN '001' ELSE '999' END AS code,
    CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE 's' || CAST(l_suppkey % 7 AS STRING) END AS section_id, l_returnflag AS param, l_orderkey AS draft_version FROM {lineitem}"""


@query(
    f"""WITH i AS ({plain(_ISSUES)}), t AS (SELECT *, CASE WHEN kind = 'error' AND code IN {in_list(BLOCKING_REVIEW)} THEN 'content_review' WHEN kind = 'error' AND code = 'VAL003' THEN 'param_conflict' WHEN kind = 'error' AND code = 'VAL006' THEN 'figure_confirm' WHEN kind = 'warning' AND code IN {in_list(REVIEW)} THEN 'content_review' END AS task FROM i),
    u AS (SELECT *, CASE WHEN task = 'param_conflict' THEN '-' ELSE coalesce(nullif(section_id, ''), '-') END AS sec FROM t WHERE task IS NOT NULL), v AS (SELECT concat_ws(':', task, draft_version::VARCHAR, sec, code, CASE WHEN task = 'param_conflict' THEN coalesce(param, 'unknown') END) AS signature, CASE WHEN kind = 'error' THEN 'P0' ELSE 'P1' END AS level FROM u)
    SELECT signature, min(level) AS level FROM v WHERE signature NOT IN (SELECT 'figure_confirm:' || o_orderkey || ':s1:VAL006' FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"""
)
def review_blueprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review tasks that issues ask for, each once, without those that exist."""
    done = shaped(spark, sf_dir, "SELECT 'figure_confirm:' || CAST(o_orderkey AS STRING) || ':s1:VAL006' AS signature FROM {orders} WHERE o_orderstatus = 'F'")
    return review_tasks(shaped(spark, sf_dir, _ISSUES), done).select("signature", "level")


@query(f"WITH i AS ({plain(_ISSUES)}) SELECT draft_version, CASE WHEN count(*) FILTER (WHERE kind = 'error' AND code IN {in_list(HARD)}) > 0 THEN 'blocked' WHEN count(*) FILTER (WHERE kind = 'warning') > 0 THEN 'review_required' ELSE 'passed' END AS status FROM i GROUP BY 1")
def draft_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each draft is blocked, to be reviewed, or passed."""
    error = F.col("kind") == "error"
    grouped = shaped(spark, sf_dir, _ISSUES).groupBy("draft_version").agg(F.collect_set(F.when(error, F.col("code"))).alias("codes"), F.count_if(~error).alias("open"))  # a code is one of a few
    return grouped.select("draft_version", validation_status(F.col("codes"), F.col("open")).alias("status"))


@query(
    rf"""WITH d AS (SELECT draft_id, len(list_filter(string_split_regex(text, '\n\s*\n+'), lambda p: {_STRIP.format('p')} <> '')) AS paragraphs, len(regexp_extract_all(text, '\[\[ASSET:|推荐资产')) AS residue, len(regexp_extract_all(text, 'ation|ment|总之')) AS filler FROM ({plain(_DRAFTS)}))
    SELECT draft_id, paragraphs::INT AS paragraphs, residue::INT AS residue, filler::INT AS filler, round(filler / greatest(paragraphs, 1), 6) AS ratio, round(sum(filler) OVER () / greatest(1, sum(paragraphs) OVER ()), 6) AS overall FROM d"""
)
def writing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, residue and fillers of each draft, with the ratio of all drafts."""
    own = shaped(spark, sf_dir, _DRAFTS).select("draft_id", writing_metrics(F.col("text"), r"\[\[ASSET:|推荐资产", "ation|ment|总之").alias("m")).select("draft_id", "m.*")
    every = own.agg((F.sum("filler") / F.greatest(F.lit(1), F.sum("paragraphs"))).alias("overall"))  # one row
    return own.crossJoin(F.broadcast(every)).withColumns({"ratio": F.round("ratio", 6), "overall": F.round("overall", 6)})


_TECHNICAL, _NOISE = "ring|widget|gear", "bolt|gizmo"


@query(
    f"""WITH s AS (SELECT p_brand, regexp_matches(p_name, '{_TECHNICAL}') AS technical, len(regexp_extract_all(p_name || ' ' || lower(p_type), '{_NOISE}|small')) AS body, len(regexp_extract_all(lower(p_brand) || p_size, '1')) AS evidence FROM part)
    SELECT p_brand, count(*) FILTER (WHERE technical) AS n_technical, round(count(*) FILTER (WHERE technical AND body = 0 AND evidence = 0) / nullif(count(*) FILTER (WHERE technical), 0), 6) AS accuracy, sum(body)::BIGINT AS body_hits, sum(evidence)::BIGINT AS evidence_hits FROM s GROUP BY 1"""
)
def evidence_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group's technical sections the share without hits of noise in text or evidence, and all such hits."""
    rows = shaped(spark, sf_dir, "SELECT p_brand, p_name, p_name || ' ' || lower(p_type) AS body, lower(p_brand) || CAST(p_size AS STRING) AS evidence FROM {part}")
    rows = rows.select("p_brand", F.col("p_name").rlike(_TECHNICAL).alias("technical"), F.regexp_count("body", F.lit(f"{_NOISE}|small")).alias("body"), F.regexp_count("evidence", F.lit("1")).alias("evidence"))
    clean = F.col("technical") & (F.col("body") == 0) & (F.col("evidence") == 0)
    found = rows.groupBy("p_brand").agg(F.count_if("technical").alias("n_technical"), F.count_if(clean).alias("_c"), F.sum("body").alias("body_hits"), F.sum("evidence").alias("evidence_hits"))
    return found.select("p_brand", "n_technical", F.round(F.try_divide("_c", "n_technical"), 6).alias("accuracy"), "body_hits", "evidence_hits")


@query(
    """WITH a AS (SELECT l_orderkey, l_returnflag = 'R' AS required, l_suppkey % 4 > 0 AS bound, l_tax > 0.07 AS wrong, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem), s AS (SELECT l_orderkey, bool_or(required) AS required, bool_or(bound) FILTER (WHERE k <= 3) AS top3, bool_or(bound AND k = 1) AS first, count(*) FILTER (WHERE wrong) AS wrong FROM a GROUP BY 1)
    SELECT l_orderkey % 10 AS job, count(*) FILTER (WHERE required) AS n_required, round(count(*) FILTER (WHERE required AND top3) / nullif(count(*) FILTER (WHERE required), 0), 6) AS top3_rate, round(count(*) FILTER (WHERE required AND first) / nullif(count(*) FILTER (WHERE required), 0), 6) AS primary_rate, round(sum(wrong) / greatest(1, count(*) FILTER (WHERE required)), 6) AS wrong_rate FROM s GROUP BY 1"""
)
def asset_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one of a section's first three assets is bound to its source, how often the first is, and wrong ones a section."""
    best = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    rows = shaped(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag = 'R' AS required, l_suppkey % 4 > 0 AS bound, l_tax > 0.07 AS wrong FROM {lineitem}").withColumn("k", F.row_number().over(best))
    sections = rows.groupBy("l_orderkey").agg(F.bool_or("required").alias("required"), F.bool_or(F.when(F.col("k") <= 3, F.col("bound"))).alias("top3"), F.bool_or(F.col("bound") & (F.col("k") == 1)).alias("first"), F.count_if("wrong").alias("wrong"))
    need = F.col("required")
    found = sections.groupBy((F.col("l_orderkey") % 10).alias("job")).agg(F.count_if(need).alias("n_required"), F.count_if(need & F.col("top3")).alias("a"), F.count_if(need & F.col("first")).alias("b"), F.sum("wrong").alias("w"))
    share = lambda c: F.round(F.try_divide(c, "n_required"), 6)
    return found.select("job", "n_required", share("a").alias("top3_rate"), share("b").alias("primary_rate"), F.round(F.col("w") / F.greatest(F.lit(1), "n_required"), 6).alias("wrong_rate"))


@query()
def repeated_paragraphs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pairs of paragraphs of each draft that say the same; a unit test holds them against a plain version."""
    return repeated_paragraphs(shaped(spark, sf_dir, _DRAFTS))


#: What older projects were about, words of their starting sequence, sections in which that may stand; technical section types, and words of headings that do not belong there.
OLD_OBJECTS = ("高浓磨机", "磨机", "高炉鼓风机", "鼓风机", "压缩机", "油站", "冷却器")
OLD_SEQUENCE = ("lci", "sfc", "变频软起", "软起动", "软启动", "纯加速", "换相", "同步切换", "工频切换", "励磁柜", "总启动时间")
SEQUENCE_ALLOWED = ("lci", "sfc", "变频软起", "软起动", "软启动", "同步切换", "工频切换", "启动时间", "启动过程", "同步电机")
SCHEME_TYPES = ("overall_solution", "main_circuit_scheme", "vfd_spec", "starter_spec", "motor_spec", "transformer_spec", "control_logic", "communication_interface", "protection_interlock")
STRAY_HEADINGS = ("培训", "售后", "维保", "质保", "巡检", "备品备件", "配件及工具", "建设、经营", "建设经营", "经营方案", "运营模式", "项目建设", "项目实施", "实施进度", "进度规划", "进度计划", "进度安排", "施工进度", "节能效益分享", "收益回收", "所有权", "合同期满")
DRIFT_SHOWN = 4


def tokens_in(text: Column, tokens: tuple[str, ...]) -> Column:
    """The tokens that a text holds, whatever the case and white space, in their own order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    close = F.regexp_replace(low, r"\s+", "")
    return F.array_compact(F.array(*(F.when(low.contains(t) | close.contains(t.replace(" ", "")), F.lit(t)) for t in tokens)))


def drift_issues(section: Column, project: Column, section_type: Column, text: Column, objects: tuple[str, ...] = OLD_OBJECTS, sequence: tuple[str, ...] = OLD_SEQUENCE, allowed: tuple[str, ...] = SEQUENCE_ALLOWED, stray: tuple[str, ...] = STRAY_HEADINGS) -> Column:
    """array<struct<code, target>>: old projects' objects or starting sequence in a section that is not about them (SQ014), and a heading that does not belong into a technical section (SQ015).

    section, project: what title, purpose and keywords of the section and the fields of the project say.
    """
    whole = F.array_join(body(text), "\n\n")
    told = F.concat_ws(" ", section, project)
    some = lambda x, words: F.size(tokens_in(x, words)) > 0
    of_objects, of_sequence = tokens_in(whole, objects), tokens_in(whole, sequence)
    issue = lambda code, x: F.struct(F.lit(code).alias("code"), x.alias("target"))
    shown = lambda hits: F.array_join(F.slice(hits, 1, DRIFT_SHOWN), "、")
    old = F.when((F.size(of_objects) > 0) & ~some(told, allowed) & ~some(told, objects), issue("SQ014", shown(of_objects))).when((F.size(of_sequence) >= 2) & ~some(told, allowed), issue("SQ014", shown(of_sequence)))
    off = F.filter(draft_headings(text), lambda h: (h["level"] > 2) & some(h["title"], stray))
    return F.when(whole != "", F.array_compact(F.array(old, F.when(F.lower(section_type).isin(*SCHEME_TYPES) & (F.size(off) > 0), issue("SQ015", F.get(off, F.lit(0))["title"]))))).otherwise(F.array().cast("array<struct<code:string,target:string>>"))


_DRIFT = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '启动过程' WHEN 1 THEN 'the hat' ELSE 'plain' END AS section, CASE doc_id % 7 WHEN 0 THEN 'P que' WHEN 1 THEN 'lci 改造' ELSE lang END AS project, CASE doc_id % 3 WHEN 0 THEN 'VFD_spec' ELSE 'other' END AS section_type,
    CASE doc_id % 4 WHEN 0 THEN '### 2.1 质保 与服务' || chr(10) WHEN 1 THEN '## 培训' || chr(10) || '#### 实施 进度' || chr(10) ELSE '' END || replace(substr(text, 1, 300), chr(10), chr(10) || chr(10)) || CASE doc_id % 6 WHEN 0 THEN ' 鼓风 机 SFC' WHEN 1 THEN ' 换相, LCI' WHEN 2 THEN ' 油站' ELSE '' END AS text FROM {documents}"""
_OLD = ("que", "鼓风机", "油站", "hat t")


def _sql_tokens(text: str, tokens: tuple[str, ...]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains(lower({text}), '{t}') OR contains(regexp_replace(lower({text}), '\\s+', '', 'g'), '{t.replace(' ', '')}') THEN '{t}' END" for t in tokens) + "], lambda x: x IS NOT NULL)"


@query(
    rf"""WITH d AS (SELECT *, array_to_string({_SQL_BODY}, chr(10) || chr(10)) AS w, section || ' ' || project AS told, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: regexp_matches(x, '^#{{3,6}}\s+\S')), lambda x: {_STRIP.format("regexp_replace(x, '^#{2,6}\\s+', '')")}) AS heads FROM ({plain(_DRIFT)})),
    h AS (SELECT *, {_sql_tokens("w", _OLD)} AS a, {_sql_tokens("w", OLD_SEQUENCE)} AS b, len({_sql_tokens("told", SEQUENCE_ALLOWED)}) > 0 AS ok, len({_sql_tokens("told", _OLD)}) > 0 AS own, list_filter(heads, lambda q: len({_sql_tokens("q", STRAY_HEADINGS)}) > 0) AS off FROM d WHERE w <> '')
    SELECT doc_id, 'SQ014' AS code, array_to_string(list_slice(CASE WHEN len(a) > 0 AND NOT ok AND NOT own THEN a ELSE b END, 1, 4), '、') AS target FROM h WHERE NOT ok AND ((len(a) > 0 AND NOT own) OR len(b) >= 2) UNION ALL SELECT doc_id, 'SQ015', off[1] FROM h WHERE lower(section_type) = 'vfd_spec' AND len(off) > 0"""
)
def drift_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where drafts drift to other projects or other sections."""
    c = F.col
    found = shaped(spark, sf_dir, _DRIFT).select("doc_id", F.explode(drift_issues(c("section"), c("project"), c("section_type"), c("text"), _OLD)).alias("i"))
    return found.select("doc_id", "i.code", "i.target")
