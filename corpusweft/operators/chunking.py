"""Documents into chunks, chunks judged for an index, headings into their plain forms and section trees."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..functions import headings as H
from ..registry import plain, query, shaped, table

#: Most characters of a chunk, and the heading levels and depths at which a new one starts.
CHUNK_CHARS, SPLIT_LEVEL, SPLIT_DEPTH = 2400, 2, 1


def chunk_parts(blocks: Column, limit: int = CHUNK_CHARS) -> Column:
    """array<struct<content, heading>> of an array of blocks: a block joins the open chunk while both fit into ``limit``; headings of high levels and tables start new ones.

    A fold over the blocks of one text: each step looks at the open chunk and the current heading only.
    """
    part = "struct<content:string,heading:string>"
    start = F.struct(F.lit("").alias("open"), F.lit(None).cast("string").alias("heading"), F.array().cast(f"array<{part}>").alias("done"))

    def seen(block: Column) -> Column:
        first = C.stripped(F.split(block, "\n")[0])
        marks = F.regexp_extract(first, r"^(#{1,6})\s+\S", 1)
        return F.struct(block.alias("block"), F.length(marks).alias("level"), F.when(marks != "", C.stripped(F.regexp_replace(first, r"^#{1,6}\s+", ""))).alias("title"), C.is_table(block).alias("table"))

    def judged(b: Column) -> Column:
        depth = F.when(b["title"].isNotNull(), F.size(H.ordinals(b["title"]))).otherwise(F.lit(0))
        return F.struct(b["block"].alias("block"), b["level"].alias("level"), b["title"].alias("title"), b["table"].alias("table"), depth.alias("depth"))

    def step(state: Column, b: Column) -> Column:
        block, title = b["block"], b["title"]
        starts = title.isNotNull() & (state["heading"].isNull() | F.when(b["depth"] > 0, b["depth"] <= SPLIT_DEPTH).otherwise(b["level"] <= SPLIT_LEVEL))
        heading = F.when(starts | (title.isNotNull() & state["heading"].isNull()), title).otherwise(state["heading"])
        closed = lambda content, of: F.array(F.struct(content.alias("content"), of.alias("heading")))
        own_table = b["table"]
        flushed = starts | own_table
        kept = F.when(flushed, F.lit("")).otherwise(state["open"])
        fits = (kept == "") | (F.length(kept) + 2 + F.length(block) <= limit)
        done = F.when((state["open"] != "") & flushed, F.concat(state["done"], closed(state["open"], F.when(starts, state["heading"]).otherwise(heading)))).otherwise(state["done"])
        done = F.when(own_table, F.concat(done, closed(block, heading))).when(~fits, F.concat(done, closed(kept, heading))).otherwise(done)
        rest = F.when(own_table, F.lit("")).when(kept == "", block).when(fits, F.concat(kept, F.lit("\n\n"), block)).otherwise(block)
        return F.struct(rest.alias("open"), heading.alias("heading"), done.alias("done"))

    end = lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(F.struct(s["open"].alias("content"), s["heading"].alias("heading"))))).otherwise(s["done"])
    return F.aggregate(F.transform(F.transform(blocks, seen), judged), start, step, end)


def chunked(docs: DataFrame, id_column: str = "doc_id", limit: int = CHUNK_CHARS) -> DataFrame:
    """(id, chunk_index, chunk_type, content, heading_path, token_count, risk_level, front_matter, needs_asset_lookup): chunks of texts whose blocks blank lines part."""
    blocks = F.filter(F.transform(F.split("text", "\n\n"), C.stripped), lambda b: b != "")
    parts = docs.select(id_column, F.posexplode(chunk_parts(blocks, limit)).alias("chunk_index", "part")).select(id_column, "chunk_index", "part.*")
    text = F.col("content")
    return parts.select(
        id_column,
        "chunk_index",
        F.when(C.is_table(text), F.lit("TABLE")).otherwise(F.lit("PLAIN")).alias("chunk_type"),
        "content",
        F.col("heading").alias("heading_path"),
        F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long").alias("token_count"),
        C.risk_level(text, F.col("chunk_index")).alias("risk_level"),
        ((F.col("chunk_index") <= C.FRONT_CHUNKS) & C.flat(text).rlike(C.FURNITURE)).alias("front_matter"),
        C.flat(text).rlike(C.FIGURE).alias("needs_asset_lookup"),
    )


def section_tree(headings: DataFrame, document: str = "doc_id", place: str = "place", level: str = "level", title: str = "title") -> DataFrame:
    """Headings in order as a tree: section_id (1.2.1), parent_id, and the path of titles.

    The parent is the nearest earlier heading of a lower level. No heading between a parent and its child has a lower level
    than the parent, so the last heading of each lower level, as seen from a heading, tells all of its ancestors: those that
    come after every last one of a lower level still. Rows are dealt by document once. A null document has no tree.
    """
    back = Window.partitionBy(document).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    levels = range(1, 9)
    own = F.col(document).isNotNull()
    rows = headings.withColumns({f"_p{n}": F.max(F.when(own & (F.col(level) == n), F.col(place))).over(back) for n in levels})
    last = lambda below: F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(f"_p{n}", F.lit(-1)) for n in levels if n < below))
    rows = rows.withColumn("_above", F.greatest(F.lit(-1), *(F.when(F.col(level) > n, F.coalesce(f"_p{n}", F.lit(-1))).otherwise(F.lit(-1)) for n in levels)))
    rows = rows.withColumn("_number", F.row_number().over(Window.partitionBy(document, "_above").orderBy(place)))
    known = F.struct(F.col(place).alias("p"), F.col("_number").cast("string").alias("n"), F.col(title).alias("t"))
    rows = rows.withColumns({f"_l{n}": F.max(F.when(own & (F.col(level) == n), known)).over(back) for n in levels})
    over = lambda n, of: F.when((F.col(level) > n) & (F.col(f"_p{n}") > last(n)), F.col(f"_l{n}.{of}"))
    section = F.concat_ws(".", *(over(n, "n") for n in levels), F.col("_number").cast("string"))
    path = F.concat_ws(" > ", *(over(n, "t") for n in levels), title)
    found = rows.select(document, place, level, title, "_above", section.alias("section_id"), path.alias("path"))
    parent = F.when(F.col("_above") >= 0, F.regexp_replace("section_id", r"\.[0-9]+$", ""))
    return found.select(document, place, level, title, "section_id", parent.alias("parent_id"), "path")


def sibling_sections(sections: DataFrame, keys: list[str], quality: str, place: str) -> DataFrame:
    """Of sections that share keys the one of the best quality (the first of equals), at the place of the first, with the titles of all."""
    best = F.max_by(F.struct(*sections.columns), F.struct(F.col(quality), -F.col(place)))
    grouped = sections.groupBy(*keys).agg(best.alias("b"), F.min(place).alias("first"), F.count("*").alias("n_merged"))
    return grouped.select(*(F.col(f"b.{c}").alias(c) for c in sections.columns if c != place), F.col("first").alias(place), "n_merged")


def flattened(trees: DataFrame, id_column: str, children: str = "children") -> DataFrame:
    """(id, order, level, title) of nested trees in pre-order, as deep as their type goes; trees are structs with ``title`` and an array of ``children``."""
    out, now = None, trees.select(id_column, F.posexplode("sections").alias("_i", "_s")).select(id_column, F.format_string("%06d", "_i").alias("order"), F.lit(1).alias("level"), "_s")
    for n in itertools.count(1):
        rows = now.select(id_column, "order", "level", F.col("_s.title").alias("title"))
        out = rows if out is None else out.unionByName(rows)
        if children not in {f.name for f in now.schema["_s"].dataType.fields}:
            break
        now = now.select(id_column, "order", F.posexplode(f"_s.{children}").alias("_i", "_c")).select(id_column, F.concat("order", F.format_string(".%06d", "_i")).alias("order"), F.lit(n + 1).alias("level"), F.col("_c").alias("_s"))
    return out


def matched_sections(chunks: DataFrame, sections: DataFrame, document: str = "doc_id") -> DataFrame:
    """Each chunk (chunk_index, content) with the section whose title or alias its first line names.

    Sections are looked for from the last match on and then from the start, so a document's chunks follow each other: one
    document's rows at a time.
    """
    kind = chunks.schema[document].dataType.simpleString()
    both = chunks.select(document, F.lit(1).alias("side"), F.col("chunk_index").cast("long").alias("place"), H.compact(F.regexp_replace(F.split("content", "\n")[0], r"^#+\s*", "")).alias("name"), F.lit(None).cast("string").alias("section_id"))
    named = sections.select(document, F.lit(0).alias("side"), F.col("place").cast("long").alias("place"), F.explode(F.transform(H.aliases(F.col("title")), lambda a: F.replace(a, F.lit(" "), F.lit("")))).alias("name"), "section_id")

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["side"], r["place"]))
        listed = [r for r in rows if not r["side"]]
        out, cursor = [], -1
        for r in rows:
            if r["side"]:
                hits = [s for s in listed if s["name"] and s["name"] == r["name"]]
                ahead = [s for s in hits if s["place"] > cursor] or hits
                found = min(ahead, key=lambda s: s["place"]) if ahead else None
                cursor = found["place"] if found else cursor
                out.append((r[document], r["place"], found["section_id"] if found else None))
        names = [document, "chunk_index", "section_id"]
        return pa.table([pa.array([o[i] for o in out], f) for i, f in enumerate((table.schema.field(document).type, pa.int64(), pa.string()))], names=names)

    return both.unionByName(named).groupBy(document).applyInArrow(run, f"{document} {kind}, chunk_index long, section_id string")


def section_anchors(chunks: DataFrame, sections: DataFrame, document: str = "doc_id") -> DataFrame:
    """Each chunk's heading path with the section of the best kind of match: the same path, the same plain path, or an alias of its last title."""
    a = chunks.select(document, "chunk_index", "heading_path", H.normalised(F.col("heading_path")).alias("_plain"))
    b = sections.select(F.col(document).alias("_d"), "section_id", F.col("path").alias("_path"), H.normalised(F.col("path")).alias("_other"), H.aliases(F.col("title")).alias("_names"))
    rank = F.when(F.col("heading_path") == F.col("_path"), F.lit(1)).when(F.col("_plain") == F.col("_other"), F.lit(2)).when(F.array_contains("_names", F.col("_plain")), F.lit(3))
    joined = a.join(b, F.col(document) == F.col("_d")).withColumn("rank", rank).filter(F.col("rank").isNotNull())
    return joined.groupBy(document, "chunk_index").agg(F.min(F.struct("rank", "section_id")).alias("m")).select(document, "chunk_index", "m.section_id", F.element_at(F.array(F.lit("exact"), F.lit("normalized"), F.lit("alias")), F.col("m.rank")).alias("match"))


_HEADINGS = """SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN '第' || CAST(p_size % 9 + 1 AS STRING) || '章 ' || p_name WHEN 1 THEN '第十' || substr('一二三四五六七八九', CAST(p_size % 9 + 1 AS INT), 1) || '节 系统 总体 方案'
    WHEN 2 THEN '二十' || substr('一二三四五六七八九', CAST(p_size % 9 + 1 AS INT), 1) || '、' || p_name WHEN 3 THEN '（' || CAST(p_size AS STRING) || '）' || p_name WHEN 4 THEN CAST(p_size % 5 AS STRING) || '.' || CAST(p_size % 3 AS STRING) || ' ' || p_name
    WHEN 5 THEN CAST(p_size % 5 AS STRING) || '.' || CAST(p_size % 3 AS STRING) || '.2 系统结构及组成' WHEN 6 THEN CAST(p_size AS STRING) || ' ' || p_name WHEN 7 THEN CAST(p_size AS STRING) || '总体说明.....' || CAST(p_size AS STRING)
    WHEN 8 THEN '系统 总体 要求, (' || p_brand || ')' WHEN 9 THEN '十' WHEN 10 THEN '   ' ELSE p_type END AS heading FROM {part}"""


def _sql_normalised(t: str) -> str:
    title = "CASE " + " ".join(f"WHEN regexp_matches({t}, '{f}') THEN regexp_extract({t}, '{f}', 2)" for f in H.FORMS) + f" ELSE {t} END"
    spaced = f"regexp_replace(regexp_replace(regexp_replace({title}, '{H.FILLER}', ' ', 'g'), '{H.PUNCTUATION}', ' ', 'g'), '\\s+', ' ', 'g')"
    once = f"regexp_replace(trim({spaced}, ' '), '({H.IDEOGRAPH}) ({H.IDEOGRAPH})', '\\1\\2', 'g')"
    return f"regexp_replace({once}, '({H.IDEOGRAPH}) ({H.IDEOGRAPH})', '\\1\\2', 'g')"


def _sql_numeral(token: str) -> str:
    digit = lambda c: f"(CASE WHEN {c} = '〇' THEN 0 WHEN length({c}) = 1 AND instr('{H.NUMERALS}', {c}) > 0 THEN instr('{H.NUMERALS}', {c}) - 1 END)"
    bare = f"regexp_replace(regexp_replace(trim({token}, ' '), '^第', ''), '[章节条]$', '')"
    before, after = f"string_split({bare}, '十')[1]", f"substr({bare}, instr({bare}, '十') + 1)"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9]+') THEN TRY_CAST({bare} AS INT) WHEN {bare} = '十' THEN 10 WHEN NOT contains({bare}, '十') THEN {digit(bare)} WHEN starts_with({bare}, '十') THEN 10 + coalesce({digit(after)}, 0) WHEN ends_with({bare}, '十') THEN coalesce({digit(before)}, 0) * 10 ELSE {digit(before)} * 10 + {digit(after)} END"


def _sql_ordinals(t: str) -> str:
    dotted = lambda token: f"list_transform(string_split({token}, '.'), lambda n: TRY_CAST(n AS INT))"
    cases = [f"WHEN regexp_matches({t}, '{H.UNIT_ALONE}') OR regexp_matches({t}, '{H.NUMERAL_ALONE}') THEN [{_sql_numeral(t)}]", f"WHEN regexp_matches({t}, '{H.DOTTED_ALONE}') THEN {dotted(t)}"]
    cases += [f"WHEN regexp_matches({t}, '{f}') THEN [{_sql_numeral(f"regexp_extract({t}, '{f}', 1)")}]" for f in H.FORMS[:5]]
    cases += [f"WHEN regexp_matches({t}, '{f}') THEN {dotted(f"regexp_extract({t}, '{f}', 1)")}" for f in H.FORMS[5:]]
    return f"list_filter(CASE {' '.join(cases)} ELSE []::INT[] END, lambda n: n IS NOT NULL)"


def _sql_aliases(own: str) -> str:
    close = f"replace({own}, ' ', '')"
    return f"list_filter([{own}, {close}, replace({close}, '及', ''), CASE WHEN starts_with({own}, '系统') AND length({own}) > 4 THEN trim(substr({own}, 3), ' ') END, CASE WHEN starts_with({own}, '总体') AND length({own}) > 4 THEN '系统' || {own} END], lambda a: a IS NOT NULL AND a <> '')"


@query(
    f"""WITH f AS (SELECT id, trim(heading, ' ') AS t FROM ({plain(_HEADINGS)})), n AS (SELECT id, t, {_sql_normalised("t")} AS own, {_sql_ordinals("t")} AS numbers FROM f), a AS (SELECT *, {_sql_aliases("own")} AS forms FROM n)
    SELECT id, own AS normalized, array_to_string(list_filter(forms, lambda x, i: NOT list_contains(list_slice(forms, 1, i - 1), x)), '|') AS aliases, array_to_string(numbers, '.') AS ordinals FROM a"""
)
def heading_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with their plain form, the aliases under which they are found, and their numbers."""
    t = F.col("heading")
    return shaped(spark, sf_dir, _HEADINGS).select("id", H.normalised(t).alias("normalized"), F.concat_ws("|", H.aliases(t)).alias("aliases"), F.concat_ws(".", F.transform(H.ordinals(t), lambda n: n.cast("string"))).alias("ordinals"))


_FAMILY = r"CASE WHEN regexp_matches({0}, '^\s*[0-9]') THEN string_split(regexp_extract({0}, '^\s*([0-9]+(?:\.[0-9]+)*)', 1), '.') ELSE []::VARCHAR[] END"


@query(
    rf"""WITH f AS (SELECT id, trim(heading, ' ') AS t FROM ({plain(_HEADINGS)})), o AS (SELECT id, t, {_sql_ordinals("t")} AS n FROM f WHERE id % 12 IN (4, 5, 6)), p AS (SELECT id, t, n, lead(t) OVER (ORDER BY id) AS u, lead(n) OVER (ORDER BY id) AS m FROM o),
    q AS (SELECT *, {_FAMILY.format("t")} AS x, {_FAMILY.format("u")} AS y FROM p WHERE u IS NOT NULL)
    SELECT id, len(list_filter(range(1, least(len(n), len(m)) + 1), lambda i: list_slice(n, 1, i) = list_slice(m, 1, i)))::INT AS shared, len(n) > 0 AND len(n) < len(m) AND list_slice(m, 1, len(n)) = n AS is_parent,
    CASE WHEN len(x) > 0 AND len(y) > 0 AND x[1] = y[1] THEN CASE WHEN len(x) >= 2 AND len(y) >= 2 AND list_slice(x, 1, 2) = list_slice(y, 1, 2) THEN 0.2 ELSE 0.12 END ELSE 0.0 END::DOUBLE AS family FROM q"""
)
def heading_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each numbered heading against the next: numbers in common, whether it may be its parent, and the similarity of their families."""
    rows = shaped(spark, sf_dir, _HEADINGS).filter("id % 12 IN (4, 5, 6)").select("id", F.col("heading").alias("t"))
    places = _numbered(rows)
    after = places.select((F.col("k") - 1).alias("k"), F.col("t").alias("u"))
    n, m = H.ordinals(F.col("t")), H.ordinals(F.col("u"))
    return places.join(after, "k").select("id", H.common_prefix(n, m).alias("shared"), H.may_be_parent(n, m).alias("is_parent"), H.family_similarity(F.col("t"), F.col("u")).alias("family"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``k``, their place by id: a count below in each block of ids plus the blocks before, so no window holds all rows."""
    blocks = rows.withColumn("_b", F.floor(F.col("id") / 4096))
    sizes = blocks.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._b") < F.col("a._b"), "left").groupBy("a._b").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return blocks.join(before, "_b").select(*rows.columns, (F.row_number().over(Window.partitionBy("_b").orderBy("id")) + F.col("_before")).alias("k"))


_CHUNKS = """SELECT doc_id, doc_id % 12 AS chunk_index, CASE doc_id % 10 WHEN 3 THEN '2 参数' WHEN 4 THEN '1.5' ELSE source END AS heading,
    CASE doc_id % 16 WHEN 1 THEN '# ' || substr(text, 1, 20) WHEN 2 THEN '版本 3 页码 ' || substr(text, 1, 60) WHEN 3 THEN substr(text, 1, 14) WHEN 4 THEN 'Да Нет ' || substr(text, 1, 10) WHEN 5 THEN 'the' WHEN 6 THEN '见下图 circuit ' || text
      WHEN 7 THEN '| 参数 | 数值 |' || chr(10) || '| --- | --- |' || chr(10) || '| a | 3 kV |' || chr(10) || '| b | 5 mm |' WHEN 8 THEN '|1.5|2|3|' || chr(10) || '|4|5|6|' WHEN 9 THEN '|x###|y@@@|' || chr(10) || '|' || substr(text, 1, 8) || '|Ã|'
      WHEN 10 THEN '|1|2|3|4|' || repeat(chr(10) || '|10|20 x|30|y|', CAST(doc_id % 31 AS INT)) WHEN 11 THEN ' ' WHEN 12 THEN 'U = R × I²' WHEN 13 THEN '控制 原理' ELSE text END AS content FROM {documents}"""
_KIND = "CASE WHEN contains(content, '|') AND contains(content, chr(10) || '|') THEN 'TABLE' ELSE 'PLAIN' END"
_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


def _sql_profile(text: str) -> str:
    """CTE columns of a table's rows, cells and ratios, from a CTE named base with ``text``."""
    cells = rf"list_transform(string_split(regexp_replace(regexp_replace({_STRIP.format('x')}, '^\|+', ''), '\|+$', ''), '|'), lambda c: {_STRIP.format('c')})"
    rows = rf"list_filter(list_transform(list_filter(string_split({text}, chr(10)), lambda x: contains(x, '|')), lambda x: {cells}), lambda r: len(list_filter(r, lambda c: c <> '')) > 0 AND len(list_filter(r, lambda c: NOT regexp_matches(c, '{C.SEPARATOR_CELL}'))) > 0)"
    bad = f"regexp_matches(c, '{C.GARBLED}') OR regexp_matches(c, '{C.GARBLED_RUN}') OR (length(c) >= 8 AND (length(c) - length(translate(c, '#*@$', ''))) / length(c) >= 0.25)"
    return f"""r AS (SELECT *, {rows} AS rows_ FROM base), p AS (SELECT *, list_filter(flatten(rows_), lambda c: c <> '') AS cells, CASE WHEN len(rows_) > 0 THEN list_slice(rows_[1], 1, 8) ELSE []::VARCHAR[] END AS header, coalesce(list_max(list_transform(rows_, lambda r: len(r))), 0) AS n_columns FROM r),
    v AS (SELECT *, len(list_filter(cells, lambda c: regexp_matches(c, '{C.NUMBER}'))) / greatest(len(cells), 1) AS numeric_ratio, len(list_filter(cells, lambda c: regexp_matches(c, '{C.UNIT}'))) AS unit_hits, len(list_filter(cells, lambda c: {bad})) / greatest(len(cells), 1) AS garbled_ratio,
      len(list_filter(header, lambda c: regexp_matches(c, '{C.SPEC_HEADER}'))) > 0 AS spec FROM p),
    w AS (SELECT *, CASE WHEN len(rows_) = 0 THEN 'sparse_lookup' WHEN garbled_ratio >= 0.12 THEN 'garbled_table' WHEN len(rows_) >= 10 AND numeric_ratio >= 0.3 THEN 'parameter_matrix' WHEN unit_hits >= 2 OR spec THEN 'spec_sheet' ELSE 'sparse_lookup' END AS profile FROM v)"""


@query(
    f"""WITH base AS (SELECT doc_id, content AS text FROM ({plain(_CHUNKS)})), {_sql_profile("text")}
    SELECT doc_id, profile, round(CASE WHEN len(rows_) = 0 THEN 0.45 WHEN garbled_ratio >= 0.12 THEN least(0.96, 0.58 + garbled_ratio) WHEN profile = 'parameter_matrix' THEN 0.84 WHEN profile = 'spec_sheet' THEN 0.77 ELSE 0.69 END, 4)::DOUBLE AS confidence, len(rows_)::INT AS n_rows, n_columns::INT AS n_columns,
    round(numeric_ratio, 4) AS numeric_ratio, unit_hits::INT AS unit_hits, round(garbled_ratio, 4) AS garbled_ratio, array_to_string(header, '|') AS header,
    array_to_string(list_filter([CASE WHEN len(rows_) = 0 THEN 'empty_or_unparsed_table' END, CASE WHEN garbled_ratio >= 0.12 THEN 'garbled_cells' END, CASE WHEN unit_hits >= 2 THEN 'unit_dense' END, CASE WHEN numeric_ratio >= 0.35 THEN 'numeric_dense' END, CASE WHEN spec THEN 'spec_headers' END], lambda x: x IS NOT NULL), ',') AS flags FROM w"""
)
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of each text's table rows: sizes, ratios, a name, its confidence and flags."""
    found = shaped(spark, sf_dir, _CHUNKS).select("doc_id", C.table_profile(F.col("content")).alias("p")).select("doc_id", "p.*")
    rounded = {c: F.round(c, 4) for c in ("confidence", "numeric_ratio", "garbled_ratio")}
    return found.withColumns(rounded | {"header": F.concat_ws("|", "header"), "flags": F.concat_ws(",", "flags")})


_LOW = rf"""list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), lambda x: x) AS filled"""


@query(
    rf"""WITH base AS (SELECT doc_id, chunk_index, heading, content, {_STRIP.format('content')} AS text, {_KIND} AS kind, trim(regexp_replace(content, '\s+', ' ', 'g'), ' ') AS flat FROM ({plain(_CHUNKS)})), {_sql_profile("text")},
    a AS (SELECT *, {_LOW}, regexp_replace({_STRIP.format('heading')}, '^#+\s*', '') AS title FROM w),
    b AS (SELECT *, list_filter(filled, lambda x: NOT starts_with(x, '#')) AS own FROM a),
    c AS (SELECT *, array_to_string(list_filter(list_transform(CASE WHEN len(own) > 0 THEN own ELSE filled END, lambda x: regexp_replace(x, '^#+\s*', '')), lambda x: x <> ''), ' ') AS body FROM b),
    d AS (SELECT *, {_STRIP.format("concat_ws(' ', nullif(title, ''), nullif(body, ''))")} AS whole FROM c),
    e AS (SELECT *, length(regexp_replace(whole, '\s', '', 'g')) AS visible, length(regexp_replace(whole, '[^Ѐ-ӿ]', '', 'g')) AS cyrillic FROM d),
    g AS (SELECT *, visible = 0 OR (cyrillic / greatest(visible, 1) >= 0.12 AND visible <= 40) OR (lower(body) IN ({", ".join(f"'{w}'" for w in C.STOP_WORDS)}) AND length(title) <= 20) OR (visible <= 24 AND len(regexp_extract_all(whole, '{C.WORD}')) <= 2 AND NOT regexp_matches(whole, '[一-鿿]{{2,}}')) AS low,
      ({" + ".join(f"contains(flat, '{m}')::INT" for m in C.FIGURE_MARKERS)}) AS marks, ({" + ".join(f"contains(flat, '{m}')::INT" for m in C.PROSE_MARKERS)}) AS prose, regexp_matches(flat, '{C.FURNITURE}') AS furniture, list_filter(header, lambda c: c <> '') AS heads FROM e),
    h AS (SELECT *, list_filter([
      CASE WHEN chunk_index <= 6 AND furniture THEN 'front_matter_noise' END,
      CASE WHEN kind = 'PLAIN' AND len(filled) > 0 AND len(own) = 0 AND length(flat) <= 60 THEN 'heading_only' END,
      CASE WHEN furniture AND length(flat) <= 120 THEN 'page_furniture' END,
      CASE WHEN kind = 'TABLE' AND (length(content) > 2200 OR len(list_filter(string_split(content, chr(10)), lambda x: contains(x, '|'))) > 28) THEN 'oversized_table' END,
      CASE WHEN regexp_matches(flat, '{C.GARBLED}') THEN 'garbled_formula_text' END,
      CASE WHEN regexp_matches(flat, '{C.FIGURE}') AND kind <> 'TABLE' AND (length(flat) <= 260 OR (marks >= 2 AND prose = 0)) THEN 'figure_reference_only' END,
      CASE WHEN text = '' THEN 'empty_chunk' END,
      CASE WHEN text <> '' AND kind = 'PLAIN' AND low THEN 'low_signal_plain_fragment' END,
      CASE WHEN text <> '' AND kind = 'TABLE' AND profile = 'garbled_table' THEN 'garbled_table_fragment' END,
      CASE WHEN text <> '' AND kind = 'TABLE' AND profile = 'sparse_lookup' AND len(rows_) <= 4 AND numeric_ratio >= 0.8 AND ((len(heads) > 0 AND len(list_filter(heads, lambda c: NOT regexp_matches(c, '{C.NUMERIC_CELL}'))) = 0) OR regexp_matches({_STRIP.format('heading')}, '{C.NUMERIC_HEADING}')) THEN 'numeric_table_fragment' END
    ], lambda x: x IS NOT NULL) AS reasons FROM g)
    SELECT doc_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS indexable, len(reasons) > 0 OR regexp_matches(flat, '{C.FIGURE}') OR regexp_matches(flat, '{C.MATH}') OR regexp_matches(flat, '{C.SCRIPTS}') AS review_required,
    list_has_any(reasons, ['oversized_table', 'garbled_table_fragment']) AS preserved FROM h"""
)
def ingestion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with the reasons that keep it out of the index, whether it needs a review, and whether it is kept for its assets."""
    t = F.col("content")
    kind = F.when(C.is_table(t), F.lit("TABLE")).otherwise(F.lit("PLAIN"))
    found = shaped(spark, sf_dir, _CHUNKS).select("doc_id", "content", C.ingestion_reasons(t, kind, F.col("chunk_index"), F.col("heading")).alias("r"))
    return found.select("doc_id", F.concat_ws(",", "r").alias("reasons"), (F.size("r") == 0).alias("indexable"), C.needs_review(t, F.col("r")).alias("review_required"), C.preserved_for_assets(F.col("r")).alias("preserved"))


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), t AS (SELECT doc_id, line, {_STRIP.format('x')} AS text FROM l)
    SELECT doc_id, count(*) AS n_lines, min(line)::INT AS first_line, sum(CASE WHEN regexp_matches(text, '{C.GARBLED}') THEN 1 ELSE 0 END)::BIGINT AS n_garbled FROM t WHERE text <> '' AND (regexp_matches(text, '{C.MATH}') OR regexp_matches(text, '{C.SCRIPTS}')) GROUP BY 1"""
)
def formula_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document look like formulas, the first of them, and how many are garbled."""
    docs = table(spark, sf_dir, "documents").filter(C.is_formula(F.col("text")))  # few texts have such a line
    found = docs.select("doc_id", C.formula_lines(F.col("text")).alias("f")).filter(F.size("f") > 0)
    return found.select("doc_id", F.size("f").cast("long").alias("n_lines"), F.get("f", F.lit(0))["line"].alias("first_line"), F.size(F.filter("f", lambda x: x["garbled"])).cast("long").alias("n_garbled"))


_MARKDOWN = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '## 1.' || CAST(doc_id % 7 AS STRING) || ' ' || lang || chr(10) || chr(10) ELSE '' END || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || '# ' || source || chr(10) || chr(10) || '| a | b |' || chr(10) || '| 1 | 2 |' AS text FROM {documents}"


@query(
    rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda b: {_STRIP.format('b')}), lambda b: b <> '') AS blocks FROM ({plain(_MARKDOWN)})),
    s AS (SELECT doc_id, blocks, 0 AS i, '' AS open, NULL::VARCHAR AS heading, 0 AS n, []::STRUCT(content VARCHAR, heading VARCHAR)[] AS made FROM d
      UNION ALL SELECT doc_id, blocks, i, CASE WHEN own_table THEN '' WHEN kept = '' THEN block WHEN fits THEN kept || chr(10) || chr(10) || block ELSE block END, new_heading,
        n + (open <> '' AND flushed)::INT + (own_table OR NOT fits)::INT, CASE WHEN open <> '' AND flushed THEN [{{'content': open, 'heading': CASE WHEN starts THEN heading ELSE new_heading END}}] ELSE [] END || CASE WHEN own_table THEN [{{'content': block, 'heading': new_heading}}] WHEN NOT fits THEN [{{'content': kept, 'heading': new_heading}}] ELSE [] END
      FROM (SELECT *, kept = '' OR length(kept) + 2 + length(block) <= 2400 AS fits FROM (SELECT *, starts OR own_table AS flushed, CASE WHEN starts OR own_table THEN '' ELSE open END AS kept, CASE WHEN starts OR (title IS NOT NULL AND heading IS NULL) THEN title ELSE heading END AS new_heading FROM
        (SELECT *, title IS NOT NULL AND (heading IS NULL OR CASE WHEN len(numbers) > 0 THEN len(numbers) <= 1 ELSE level <= 2 END) AS starts, contains(block, '|') AND contains(block, chr(10) || '|') AS own_table FROM
        (SELECT *, {_sql_ordinals("title")} AS numbers FROM (SELECT doc_id, blocks, i + 1 AS i, open, heading, n, blocks[i + 1] AS block, CASE WHEN regexp_matches(string_split(blocks[i + 1], chr(10))[1], '^#{{1,6}}\s+\S') THEN regexp_replace(string_split(blocks[i + 1], chr(10))[1], '^#{{1,6}}\s+', '') END AS title,
          length(regexp_extract(blocks[i + 1], '^(#{{1,6}})', 1)) AS level FROM s WHERE i < len(blocks))))))),
    made_parts AS (SELECT doc_id, n, made FROM s UNION ALL SELECT doc_id, n + 1, [{{'content': open, 'heading': heading}}] FROM s WHERE i = len(blocks) AND open <> ''),
    c AS (SELECT doc_id, n - len(made) + generate_subscripts(made, 1) - 1 AS chunk_index, unnest(made) AS part FROM made_parts WHERE len(made) > 0)
    SELECT doc_id, chunk_index::INT AS chunk_index, CASE WHEN contains(part.content, '|') AND contains(part.content, chr(10) || '|') THEN 'TABLE' ELSE 'PLAIN' END AS chunk_type, part.heading AS heading_path, greatest(1, length(part.content) // 4)::BIGINT AS token_count, sha256(part.content) AS content_sha256 FROM c"""
)
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks at blank lines, headings and tables."""
    found = chunked(shaped(spark, sf_dir, _MARKDOWN))
    return found.select("doc_id", "chunk_index", "chunk_type", "heading_path", "token_count", F.sha2("content", 256).alias("content_sha256"))


_OUTLINE = "SELECT o_custkey AS doc_id, o_orderkey AS place, CAST(1 + o_orderkey % 4 AS INT) AS level, o_orderpriority AS title FROM {orders}"


@query(
    f"""WITH RECURSIVE h AS (SELECT doc_id, place, level, title FROM ({plain(_OUTLINE)})), a AS (SELECT h.*, (SELECT max(p.place) FROM h p WHERE p.doc_id = h.doc_id AND p.place < h.place AND p.level < h.level) AS above FROM h),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, above ORDER BY place) AS number FROM a),
    t AS (SELECT doc_id, place, level, title, number::VARCHAR AS section_id, NULL::VARCHAR AS parent_id, title AS path FROM n WHERE above IS NULL
      UNION ALL SELECT n.doc_id, n.place, n.level, n.title, t.section_id || '.' || n.number, t.section_id, t.path || ' > ' || n.title FROM n JOIN t ON n.doc_id = t.doc_id AND n.above = t.place)
    SELECT doc_id, place, level, title, section_id, parent_id, path FROM t"""
)
def section_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings in order as a tree with numbers and paths."""
    return section_tree(shaped(spark, sf_dir, _OUTLINE))


_SECTIONS = "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS place, l_shipdate AS shipped, l_returnflag AS title, CAST(l_quantity AS INT) AS quality FROM {lineitem}"


@query(
    f"""WITH s AS ({plain(_SECTIONS)}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY quality DESC, place) AS k, min(place) OVER (PARTITION BY doc_id, title) AS first, count(*) OVER (PARTITION BY doc_id, title) AS n_merged FROM s)
    SELECT doc_id, title, quality, first AS place, n_merged FROM r WHERE k = 1"""
)
def sibling_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of one parent and title united in the best of them, at the place of the first."""
    return sibling_sections(shaped(spark, sf_dir, _SECTIONS).drop("shipped"), ["doc_id", "title"], "quality", "place")
