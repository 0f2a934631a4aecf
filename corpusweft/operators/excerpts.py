"""Excerpts of requirement documents: the paragraphs that say most about what is required, within a budget, in their order.

A text within the budget is its own excerpt. Else its paragraphs are scored by a few rules, taken from the best down while they
fit, and put together in their order with a mark where some are left out; a text without any such paragraph gives its beginning.
The choice is a fold over one text's paragraphs, so a text is one row's work. Null texts give an empty excerpt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import stripped
from ..registry import plain, query, shaped

#: Words of headings under which requirements stand, and words that mark a requirement.
HEADINGS = (
    "项目概况", "项目背景", "项目简介", "项目说明", "招标范围", "供货范围", "采购范围", "建设范围", "工程范围", "技术参数", "技术规格", "技术要求", "技术指标", "技术规范", "性能要求", "设备清单", "供货清单", "材料清单", "物料清单", "接口边界", "外部接口", "系统接口",
    "工期要求", "交货期", "交付要求", "交付时间", "进度计划", "验收标准", "质量验收", "验收要求", "质量要求", "售后服务", "运维要求", "服务要求", "保修要求", "技术服务", "评分标准", "评分细则", "评标办法", "评审标准", "投标人资格", "资格要求", "资质要求",
)
MARKERS = ("必须", "应当", "应该", "不得", "不应", "禁止", "强制", "投标人", "供方", "卖方", "甲方", "乙方", "关键", "核心要求", "强制要求", "≥", "≤", "不少于", "不低于", "不大于", "不高于", "不超过", "不小于")
#: A number with a unit; what a numbered heading begins with; the mark of a gap.
SPECIFICATION = r"(?i)[0-9]+(?:\.[0-9]+)?\s*(?:[VAWkKMmGgHhz]|kW|MW|Hz|kHz|MHz|GHz|kg|km|cm|mm|m|s|ms|μs|ns|°C|℃|%|个|台|套|件|页|条|项|分钟|小时|天|月|年|V|A|Ω|Pa|kPa|MPa)"
OPENER = r"^\s*(?:[0-9]+(?:\.[0-9]+){0,3}\s*[、.．]|[一二三四五六七八九十百零]+[、.．]|（[一二三四五六七八九十百零0-9]+）|\([一二三四五六七八九十百零0-9]+\)|第[一二三四五六七八九十百零0-9]+[章节条款部分])"
GAP, GAP_CHARS = "[...]", 9
#: Points for a heading's word, a marker (and how many count), a specification, a numbered heading, and a length that reads well.
PER_HEADING, PER_MARKER, MARKERS_MOST, SPECIFIED, OPENED, READABLE, READABLE_FROM, READABLE_TO = 10.0, 1.0, 5, 1.0, 2.0, 0.5, 40, 800


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, parted by empty lines, or by lines where there are none."""
    parted = F.split(text, r"\n\s*\n+")
    chosen = F.when(F.size(parted) > 1, parted).otherwise(F.split(text, "\n"))
    return F.filter(F.transform(chosen, stripped), lambda p: p != "")


def paragraph_points(p: Column, headings: tuple[str, ...] = HEADINGS, markers: tuple[str, ...] = MARKERS) -> Column:
    """What a paragraph says about requirements; a good length counts only beside something else."""
    held = lambda words: reduce(lambda a, b: a + b, (p.contains(w).cast("int") for w in words), F.lit(0))
    own = held(headings) * PER_HEADING + F.least(F.lit(MARKERS_MOST), held(markers)) * PER_MARKER + F.when(p.rlike(SPECIFICATION), F.lit(SPECIFIED)).otherwise(F.lit(0.0)) + F.when(p.rlike(OPENER), F.lit(OPENED)).otherwise(F.lit(0.0))
    return own + F.when((own > 0) & F.length(p).between(READABLE_FROM, READABLE_TO), F.lit(READABLE)).otherwise(F.lit(0.0))


def requirement_excerpts(docs: DataFrame, most: int, headings: tuple[str, ...] = HEADINGS, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """(doc_id, excerpt) of documents (doc_id, text): at most about ``most`` characters, or one paragraph that is longer, at most twice as many."""
    c = F.col
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scored = F.transform(paragraphs(c("text")), lambda p, i: F.struct((-paragraph_points(p, headings, markers)).alias("down"), i.alias("at"), F.length(p).alias("size"), p.alias("p")))
    rows = rows.withColumn("_p", F.when(F.length("text") > most, scored)).withColumn("_r", F.array_sort(F.filter("_p", lambda x: x["down"] < 0)))
    start = F.struct(F.lit(0).alias("used"), F.slice("_r", 1, 0).alias("taken"))

    def step(s: Column, x: Column) -> Column:
        first = F.size(s["taken"]) == 0
        fits = first | (s["used"] + x["size"] + GAP_CHARS <= most)
        return F.struct(F.when(fits, s["used"] + x["size"] + F.when(first, F.lit(0)).otherwise(F.lit(GAP_CHARS))).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["taken"], F.array(x))).otherwise(s["taken"]).alias("taken"))

    taken = F.aggregate("_r", start, step, lambda s: F.array_sort(F.transform(s["taken"], lambda x: F.struct(x["at"].alias("at"), x["p"].alias("p")))))
    rows = rows.withColumn("_t", taken)
    parts = F.transform("_t", lambda x, n: F.concat(F.when((n > 0) & (x["at"] - F.get(c("_t"), F.greatest(n - 1, F.lit(0)))["at"] > 1), F.lit(f"{GAP}\n\n")).otherwise(F.lit("")), x["p"]))
    excerpt = F.when(F.length("text") <= most, c("text")).when(F.coalesce(F.size("_r"), F.lit(0)) > 0, F.substring(F.array_join(parts, "\n\n"), 1, 2 * most)).otherwise(F.substring("text", 1, most))
    return rows.select("doc_id", excerpt.alias("excerpt"))


_KEYS, _MARKS, _MOST = ("tion th", "der und", "las que"), ("and", "est", "ment", "ich"), 900
_RFP = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, '. ', chr(10) || chr(10)) WHEN 1 THEN replace(text, '. ', chr(10) || ' ' || chr(10) || '1.2. ') WHEN 2 THEN replace(text, '. ', chr(10) || '3 kV ') ELSE text END AS text FROM {documents}"


def _sql_excerpts() -> str:
    strip = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
    hits = lambda words: " + ".join(f"contains(p, '{w}')::INT" for w in words)
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, text FROM ({plain(_RFP)})), l AS (SELECT doc_id, list_filter(list_transform(CASE WHEN regexp_matches(text, '\n\s*\n+') THEN string_split_regex(text, '\n\s*\n+') ELSE string_split(text, chr(10)) END, lambda x: {strip.format('x')}), lambda x: x <> '') AS ps FROM d WHERE length(text) > {_MOST}),
    p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM l), o AS (SELECT *, 10.0 * ({hits(_KEYS)}) + least(5, {hits(_MARKS)}) + CASE WHEN regexp_matches(p, '{SPECIFICATION}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(p, '{OPENER}') THEN 2 ELSE 0 END AS own FROM p),
    r AS (SELECT *, own + CASE WHEN own > 0 AND length(p) BETWEEN 40 AND 800 THEN 0.5 ELSE 0 END AS points FROM o WHERE own > 0), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, i) AS k FROM r),
    s AS (SELECT doc_id, k, length(p) AS used, [i] AS chosen FROM k WHERE k = 1 UNION ALL SELECT k.doc_id, k.k, CASE WHEN used + length(p) + 9 <= {_MOST} THEN used + length(p) + 9 ELSE used END, CASE WHEN used + length(p) + 9 <= {_MOST} THEN list_append(chosen, i) ELSE chosen END FROM s JOIN k ON k.doc_id = s.doc_id AND k.k = s.k + 1),
    f AS (SELECT doc_id, list_sort(arg_max(chosen, k)) AS spots FROM s GROUP BY 1), e AS (SELECT doc_id, substr(array_to_string(list_transform(spots, lambda v, n: CASE WHEN n > 1 AND v > spots[n - 1] + 1 THEN '[...]' || chr(10) || chr(10) ELSE '' END || ps[v]), chr(10) || chr(10)), 1, {2 * _MOST}) AS excerpt FROM f JOIN l USING (doc_id))
    SELECT d.doc_id, CASE WHEN length(text) <= {_MOST} THEN text WHEN e.excerpt IS NOT NULL THEN e.excerpt ELSE substr(text, 1, {_MOST}) END AS excerpt FROM d LEFT JOIN e ON e.doc_id = d.doc_id"""


@query(_sql_excerpts())
def requirement_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excerpt of each document by the full rule, with words that occur in these texts."""
    return requirement_excerpts(shaped(spark, sf_dir, _RFP), _MOST, _KEYS, _MARKS)
