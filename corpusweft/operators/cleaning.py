"""Markdown from parsed pages: lines of covers, tables of contents and page furniture go, and why is counted.

Whether a line lies on the cover or in the table of contents depends on lines before it. Each line is a function on these two
states: a numbered section leaves both, a heading of contents enters the latter, any other line changes nothing. Composition of
such functions is associative and keeps, of each kind, only the last place where it occurred, so the states of all lines of all
texts of a batch come from running maxima.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..registry import query, shaped
from . import scoring

#: What lines of a parsed page look like that are no text.
IMAGE, BLANKS = re.compile(r"<!--\s*image\s*-->"), re.compile(r"\n{3,}")
FURNITURE, LEADERS, RULE = re.compile(r"(版本\s*页码|总页数|页码\s*\d+|版权所有)", re.IGNORECASE), re.compile(r"[.．·•]{8,}"), re.compile(r"^\|?[\s:\-]{8,}\|[\s|\-:]*$")
DATE = re.compile(r"^#{1,6}\s+\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日\s*$")
LABEL, CONTENTS = re.compile(r"^#{1,6}\s+(项目名称|买方|卖方|联系人|电话|地址)\s*[:：]\s*$"), re.compile(r"^#{1,6}\s+目录\s*$")
NUMBERED, FILE = re.compile(r"^#{1,6}\s+\d+(?:\.\d+)*\s+"), re.compile(r"^#{1,6}\s+.+\.(pdf|docx?|pptx?)\s*$", re.IGNORECASE)
BRAND, BRAND_CHARS = re.compile(r"^[A-Z][A-Z0-9 .,&()/_-]{4,}$"), 48
COVER, COVER_ALONE = re.compile(r"(项目名称|买方|卖方|联系人|电话|地址|日期)"), re.compile(r"^(项目名称|买方|卖方|联系人|电话|地址|日期)\s*[:：]?\s*$")
#: A line of a table of contents, the longest reusable table, the least text of a reusable chunk.
CONTENTS_LINE, TABLE_CHARS, LEAST_CHARS = r"^(?:#{1,6}\s+)?(?:[-*]\s+)?.+?(?:\t|\s{2,})[0-9]{1,4}\s*$", 2200, 80
#: Why a line goes; the counts of a text are by these. Lines of no kind of their own count among all that go.
CONTENTS_KIND, FILE_KIND, BRAND_KIND, COVER_KIND, FURNITURE_KIND, OTHER_KIND = range(1, 7)
COUNTS = {"lines_removed": range(1, 7), "toc_lines_removed": (CONTENTS_KIND,), "front_matter_lines_removed": (FILE_KIND, BRAND_KIND, COVER_KIND), "brand_lines_removed": (BRAND_KIND,), "page_furniture_lines_removed": (FURNITURE_KIND,)}
#: Bytes of texts that are cleaned together.
SMALL = 1 << 20


def last_seen(here: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each line the last place up to it, in its own text, where something is; -1 where there is none."""
    at = np.maximum.accumulate(np.where(here, np.arange(len(here)), -1))
    return np.where(at >= starts, at, -1)


def fate(line: str, first: bool, cover: bool) -> int:
    """Why a line outside of any contents goes, 0 for one that stays."""
    if first and FILE.match(line):
        return FILE_KIND
    if cover:
        if len(line) <= BRAND_CHARS and BRAND.match(line):
            return BRAND_KIND
        labels = len(COVER.findall(line))
        if labels and (labels >= 2 or line.count(":") + line.count("：") >= 2 or COVER_ALONE.match(line)):
            return COVER_KIND
    if FURNITURE.search(line):
        return FURNITURE_KIND
    if LEADERS.search(line) or RULE.match(line):
        return OTHER_KIND
    return COVER_KIND if cover and line.startswith("#") and (DATE.match(line) or LABEL.match(line)) else 0


def kept_form(line: str) -> str:
    """A line that stays: dates and labels are no headings, and runs of spaces become one, but in tables."""
    bare = line.strip()
    if bare.startswith("#") and (DATE.match(bare) or LABEL.match(bare)):
        return bare.lstrip("#").strip()
    return (line if bare.startswith("|") else re.sub(r"[ \t]{2,}", " ", line)).rstrip()


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about SMALL bytes: a text in lines with its marks takes many times its size."""
    for batch in batches:
        todo = [batch] if batch.num_rows else []
        while todo:
            some = todo.pop()
            if some.num_rows > 1 and some.nbytes > 2 * SMALL:
                half = some.num_rows // 2
                todo += [some.slice(half), some.slice(0, half)]
            else:
                yield some


def cleaned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, and how many lines went, by reason): texts of parsed pages without their furniture. A null text is empty."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [IMAGE.sub("", unicodedata.normalize("NFKC", t or "")).splitlines() for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(sizes)
            lines = [line for text in texts for line in text]
            bare = [line.strip() for line in lines]
            starts = np.repeat(ends - sizes, sizes)
            heads = [b if b.startswith("#") else "" for b in bare]
            dated, numbered, contents = (np.fromiter((bool(h) and pattern.match(h) is not None for h in heads), bool, len(heads)) for pattern in (DATE, NUMBERED, CONTENTS))
            cover = last_seen(numbered & ~dated, starts) < 0
            inside = last_seen(contents, starts) > last_seen(numbered, starts)
            why = np.zeros(len(lines), np.int64)
            for i in np.flatnonzero(~inside):
                if bare[i]:
                    why[i] = fate(bare[i], i == starts[i], cover[i])
            why[inside] = CONTENTS_KIND
            out = []
            for size, end in zip(sizes.tolist(), ends.tolist()):
                stays = (kept_form(lines[i]) if bare[i] else "" for i in range(end - size, end) if not why[i])
                out.append(BLANKS.sub("\n\n", "\n".join(stays)).strip())
            of = np.repeat(np.arange(len(texts)), sizes)
            counts = [np.bincount(of[np.isin(why, list(kinds))], minlength=len(texts)) for kinds in COUNTS.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), *(pa.array(n.astype(np.int64)) for n in counts)], names=["id", "text", *COUNTS])

    schema = f"id {kind}, text string, " + ", ".join(f"{n} long" for n in COUNTS)
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def cleaned_files(files: DataFrame) -> DataFrame:
    """The same of (doc_id, text, path), where only texts of PDF files are changed; others pass as they are, their null texts as empty."""
    is_pdf = F.lower(F.coalesce("path", F.lit(""))).endswith(".pdf")
    none = {n: F.lit(0).cast("long") for n in COUNTS}
    rest = files.filter(~is_pdf).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(none).withColumn("cleaner", F.lit("noop"))
    return cleaned(files.filter(is_pdf)).withColumn("cleaner", F.lit("pdf-basic-v1")).unionByName(rest)


def is_contents(text: Column) -> Column:
    """Whether a chunk is a table of contents: three lines or more, all but one of which end in a page number."""
    lines = F.filter(F.transform(C.lines(text), C.stripped), lambda x: x != "")
    page = lambda x: x.rlike(CONTENTS_LINE)
    odd = F.exists(lines, lambda x: x.contains("|") | (~page(x) & x.rlike("^[#*-]")))
    return (F.size(lines) >= 3) & ~odd & (F.size(F.filter(lines, page)) >= F.greatest(F.lit(3), F.size(lines) - 1))


def is_reusable(text: Column, kind: Column, heading: Column, front: Column, risk: Column) -> Column:
    """Whether a chunk may go into a library of blocks: no front matter, title or contents, little risk, neither too short nor an endless table."""
    title = F.lower(F.coalesce(heading, F.lit("")))
    named = title.rlike(scoring.DOCUMENT_TITLE) | F.trim(title).isin(*scoring.CONTENTS)
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return ~front & ~named & ~is_contents(text) & (risk != "high") & ~((kind == "TABLE") & (F.length(text) > TABLE_CHARS)) & (F.length(flat) >= LEAST_CHARS)


_PAGES = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '# sample.pdf' || chr(10) WHEN 1 THEN '## 买方 :' || chr(10) || '## 2024 年 6 月 9 日' || chr(10) ELSE '' END || CASE doc_id % 3 WHEN 0 THEN 'ACME ELECTRIC' || chr(10) || '项目名称: a 买方: b' || chr(10) ELSE '' END || CASE doc_id % 4 WHEN 0 THEN '## 目录' || chr(10) || 'x .......... 4' || chr(10) || chr(10) ELSE '' END
    || CASE doc_id % 7 WHEN 0 THEN '' ELSE '## 1 Scope' || chr(10) END || replace(text, '  ', chr(10) || '版本 页码 2' || chr(10) || '|----------|' || chr(10) || '## 2024 年 6 月 9 日' || chr(10)) || CASE doc_id % 6 WHEN 0 THEN chr(10) || '## 目录' || chr(10) || 'ｆｕｌｌ　ｗｉｄｔｈ' || chr(10) || '## 2.1 next' || chr(10) || 'a   b  ' ELSE '' END AS text, CASE WHEN doc_id % 8 = 0 THEN 'a.docx' ELSE 'B.PDF' END AS path FROM {documents}"""
_CHUNKS = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Intro  1' || chr(10) || '# Scope   12' || chr(10) || lang || chr(9) || '3' || chr(10) || 'the end of it' WHEN 1 THEN '- a  1' || chr(10) || 'b  2' || chr(10) || 'c  3' || chr(10) || '- d' WHEN 2 THEN 'a  1' || chr(10) || 'b  2' || chr(10) || '| 3' || chr(10) || 'c  4' WHEN 3 THEN 'a 1' || chr(10) || 'b 2' || chr(10) || 'c 3' ELSE text END AS text, CASE WHEN doc_id % 4 = 0 THEN 'TABLE' ELSE 'PLAIN' END AS kind,
    CASE doc_id % 9 WHEN 0 THEN 'plan.docx' WHEN 1 THEN 'Contents' WHEN 2 THEN NULL ELSE lang END AS heading, doc_id % 11 = 0 AS front, CASE WHEN doc_id % 7 = 0 THEN 'high' ELSE 'low' END AS risk FROM {documents}"""


@query()
def markdown_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed pages, cleaned, with counts of what went; a unit test holds them against a line-by-line version."""
    return cleaned_files(shaped(spark, sf_dir, _PAGES))


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')"
_REUSABLE_SQL = rf"""WITH c AS (SELECT *, {_LINES} AS l FROM ({_CHUNKS.replace('{documents}', 'documents')})), t AS (SELECT *, len(l) >= 3 AND len(list_filter(l, lambda x: contains(x, '|') OR (NOT regexp_matches(x, '{CONTENTS_LINE}') AND regexp_matches(x, '^[#*-]')))) = 0 AND len(list_filter(l, lambda x: regexp_matches(x, '{CONTENTS_LINE}'))) >= greatest(3, len(l) - 1) AS contents FROM c)
    SELECT doc_id, contents, NOT front AND NOT contents AND NOT (regexp_matches(lower(coalesce(heading, '')), '{scoring.DOCUMENT_TITLE}') OR lower(trim(coalesce(heading, ''))) IN ('目录', '目 录', 'contents')) AND risk <> 'high' AND NOT (kind = 'TABLE' AND length(text) > {TABLE_CHARS}) AND length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= {LEAST_CHARS} AS reusable FROM t"""


@query(_REUSABLE_SQL)
def reusable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are tables of contents, and which may go into a library of blocks."""
    c = F.col
    rows = shaped(spark, sf_dir, _CHUNKS)
    return rows.select("doc_id", is_contents(c("text")).alias("contents"), is_reusable(c("text"), c("kind"), c("heading"), c("front"), c("risk")).alias("reusable"))
