"""Knowledge layers: cards of groups, items with quality and evidence, layers and their audit, term lexicons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..registry import plain, query, shaped, table
from ..sources.shared import checkpointed
from . import ranking

#: What an item's score starts from, and what evidence, documents and reuse add to it (each and at most).
ITEM_START, PER_EVIDENCE, EVIDENCE_MOST, PER_DOCUMENT, DOCUMENT_MOST, PER_REUSE, REUSE_MOST = 0.64, 0.055, 0.22, 0.04, 0.12, 0.01, 0.05
#: Scores of items with these flags, the ceilings of others, and the bands of scores.
FLAG_SCORES = {"missing_source_evidence": 0.0, "over_generic_term": 0.38, "source_section_missing": 0.52}
CEILING_FLAGS, CEILING, UNSURE_CEILING, HIGHEST = ("conflicts_with_published", "cross_section_contamination", "ocr_noise_high"), 0.74, 0.68, 0.95
APPROVED, REVIEWED = 0.82, 0.60
#: Flags that keep an item out, types of items, and terms too general to be one.
BLOCKING = ("missing_source_evidence", "cross_section_contamination", "ocr_noise_high", "conflicts_with_published", "over_generic_term", "asset_type_uncertain", "source_section_missing")
ITEM_TYPES = ("term_alias", "product_family", "section_template", "asset_type_rule")
GENERIC = ("系统", "方案", "设备", "柜", "装置", "产品", "模块", "项目", "工程", "图纸", "示意图", "模板")
#: Points of a card's evidence: its documents, section types, equipment types and terms.
EVIDENCE_POINTS = {"document": 4, "section": 3, "equipment": 2, "term": 1}


def most_frequent(rows: DataFrame, key: str, column: str, most: int, name: str) -> DataFrame:
    """(key, name): each key's most frequent values of a column in an array, equal counts by value."""
    counted = rows.filter(F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != "")).groupBy(key, column).agg(F.count("*").alias("_n"))
    first = counted.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_n"), column))).filter(F.col("_k") <= most)
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", column))), lambda x: x[column]).alias(name))  # ``most`` values a key


def cards(entries: DataFrame, key: str, lists: dict[str, tuple[str, int]]) -> DataFrame:
    """(key, entry_count, one array for each of ``lists``): name -> (column, how many of its most frequent values)."""
    found = entries.groupBy(key).agg(F.count("*").alias("entry_count"))
    for name, (column, most) in lists.items():
        found = found.join(most_frequent(entries, key, column, most, name), key, "left")
    return found.withColumns({name: F.coalesce(name, F.array().cast(f"array<{entries.schema[c].dataType.simpleString()}>")) for name, (c, _) in lists.items()})


def assigned(entries: DataFrame, definitions: dict[str, list[str]], text: Column, name: str) -> DataFrame:
    """The entries once for each definition of which the text holds a keyword, whatever the case; an entry may fall in many."""
    held = F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (F.lower(text).contains(w.lower()) for w in words)), F.lit(key)) for key, words in definitions.items())))
    return entries.withColumn(name, F.explode(held))


def quality_flags(base: Column, name: Column, n_evidence: Column, n_bad_evidence: Column, n_documents: Column, reuse: Column, conflicts: Column) -> Column:
    """An item's flags in order, without repeats."""
    bare = F.regexp_replace(F.trim(name), r"[\s/_\-·:：]+", "")
    ideographs = F.length(F.regexp_replace(bare, "[^一-鿿]", ""))
    general = (bare == "") | bare.isin(*GENERIC) | ((ideographs == 1) & (F.length(bare) <= 2))
    own = F.array_compact(
        F.array(
            F.when((n_evidence == 0) | (n_documents == 0), F.lit("missing_source_evidence")),
            F.when((n_evidence > 0) & (n_bad_evidence > 0), F.lit("source_section_missing")),
            F.when(n_documents == 0, F.lit("low_source_document_coverage")),
            F.when(n_documents < 2, F.lit("single_source")),
            F.when(reuse <= 0, F.lit("low_reuse_value")),
            F.when(conflicts, F.lit("conflicts_with_published")),
            F.when(general, F.lit("over_generic_term")),
        )
    )
    return F.array_distinct(F.concat(F.filter(base, lambda f: f != ""), own))


def quality_score(kind: Column, flags: Column, n_evidence: Column, n_documents: Column, reuse: Column) -> Column:
    has = lambda *names: F.arrays_overlap(flags, F.array(*map(F.lit, names)))
    base = ITEM_START + F.least(F.lit(EVIDENCE_MOST), n_evidence * PER_EVIDENCE) + F.least(F.lit(DOCUMENT_MOST), n_documents * PER_DOCUMENT) + F.least(F.lit(REUSE_MOST), F.greatest(F.coalesce(reuse, F.lit(0)), F.lit(0)) * PER_REUSE)
    base = base - F.when((kind == "term_alias") & (n_evidence < 2), F.lit(0.08)).otherwise(F.lit(0.0)) - F.when(has("low_source_document_coverage"), F.lit(0.01)).otherwise(F.lit(0.0)) - F.when(has("low_reuse_value"), F.lit(0.02)).otherwise(F.lit(0.0))
    base = F.when(has(*CEILING_FLAGS), F.least(base, F.lit(CEILING))).otherwise(base)
    base = F.when(has("asset_type_uncertain"), F.least(base, F.lit(UNSURE_CEILING))).otherwise(base)
    out = F.round(S.clamp(base, 0.0, HIGHEST), 4)
    for flag, value in reversed(FLAG_SCORES.items()):
        out = F.when(has(flag), F.lit(value)).otherwise(out)
    return out


def is_blocked(flags: Column) -> Column:
    return F.exists(flags, lambda f: f.isin(*BLOCKING) | f.startswith("blocking:"))


def quality_status(score: Column, flags: Column) -> Column:
    lost = F.arrays_overlap(flags, F.array(F.lit("missing_source_evidence"), F.lit("over_generic_term")))
    return F.when(lost, F.lit("rejected")).when(is_blocked(flags), F.lit("review_required")).when(score >= APPROVED, F.lit("auto_approved")).when(score >= REVIEWED, F.lit("review_required")).otherwise(F.lit("rejected"))


def is_publishable(status: Column, score: Column, item_id: Column, kind: Column, name: Column, flags: Column, n_evidence: Column, n_bad_evidence: Column) -> Column:
    whole = (F.trim(item_id) != "") & kind.isin(*ITEM_TYPES) & (F.trim(name) != "") & score.between(0.0, 1.0)
    return status.isin("auto_approved", "published") & (score >= APPROVED) & whole & ~is_blocked(flags) & (n_evidence > 0) & (n_bad_evidence == 0)


def in_layers(items: DataFrame, publishable: Column) -> DataFrame:
    """The items once for each layer that holds them: every one in draft, publishable ones also in published, rejected or quarantined ones also in rejected."""
    layers = F.array_compact(F.array(F.lit("draft"), F.when(publishable, F.lit("published")), F.when(F.col("status").isin("rejected", "quarantined"), F.lit("rejected"))))
    return items.withColumn("layer", F.explode(layers))


def write_layers(items: DataFrame, publishable: Column, folder: str) -> None:
    """Each layer as a part of a table under the folder."""
    in_layers(items, publishable).write.mode("overwrite").partitionBy("layer").parquet(folder)


def listed(items: DataFrame, text: str, columns: list[str], order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the items that hold the text in any of the columns, in order, with ``total``; the limit is kept within 1 to 500."""
    found = items.filter(F.lower(F.concat_ws(" ", *columns)).contains(text.strip().lower())) if text.strip() else items
    total = found.agg(F.count("*").alias("total"))  # one row
    page = found.orderBy(*order).offset(max(0, offset)).limit(max(1, min(500, limit)))
    return page.crossJoin(F.broadcast(total))


def text_match(candidate: Column, asked: Column) -> Column:
    """3 where the candidate lies in what is asked, and 1 for each word of that which it has."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    words = lambda c: F.array_distinct(F.regexp_extract_all(flat(c), F.lit(r"[a-z0-9_+-]{2,}|[一-鿿]{2,}"), 0))
    points = F.when(flat(asked).contains(flat(candidate)), F.lit(3)).otherwise(F.lit(0)) + F.size(F.array_intersect(words(asked), words(candidate)))
    return F.when(flat(candidate) == "", F.lit(0)).otherwise(points)


def distribution_count(distribution: Column, key: str, wanted: Column) -> Column:
    """The largest count of a value in an array of structs (key, count); 0 for generic and unknown values."""
    hits = F.transform(F.filter(distribution, lambda x: F.lower(x[key]) == F.lower(wanted)), lambda x: x["count"].cast("double"))
    return F.when(F.lower(wanted).isin("", "generic", "unknown"), F.lit(0.0)).otherwise(F.coalesce(F.array_max(hits), F.lit(0.0)))


def card_evidence(cards_: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """(card, entry, points, place): entries that share a document, section type, equipment type or term with a card, the best first.

    cards_: (card, documents, sections, equipment, terms) of arrays. Each combination of values that entries have keeps its first
    ``limit`` entries, as any others that share just these come after them in every card; cards with equal arrays are one kind,
    and kinds meet the combinations that they ask for by an equi-join. Only different terms meet all texts.
    """
    c = F.col
    kinds = {"documents": ("document", "document"), "sections": ("section", "section"), "equipment": ("equipment", "equipment_type"), "terms": ("term", "_term")}
    whole = lambda n: F.sort_array(F.array_distinct(F.filter(F.flatten(F.collect_list(F.coalesce(n, F.array().cast("array<string>")))), lambda v: v.isNotNull()))).alias(n)
    own = cards_.groupBy("card").agg(*map(whole, kinds)).withColumn("terms", F.filter("terms", lambda t: t != ""))  # a few values a card
    asked = own.select(*kinds).distinct()
    any_of = lambda values: F.concat(values, F.array(F.lit(None).cast("string")))  # noqa: E731  null: whatever the value
    terms = asked.select(F.explode("terms").alias("_term")).distinct()
    held = entries.join(F.broadcast(terms), F.lower("text").contains(F.lower("_term"))).select("entry", "_term")
    held = entries.select("entry", "document", "section", "equipment_type", F.lit(None).cast("string").alias("_term")).unionByName(entries.join(held, "entry").select("entry", "document", "section", "equipment_type", "_term"))
    columns = [column for _, column in kinds.values()]
    combined = held
    for column in columns[:-1]:
        combined = combined.withColumn(column, F.explode(F.array_distinct(F.array(c(column), F.lit(None).cast("string")))))
    combined = combined.filter(F.coalesce(*columns).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*columns).orderBy("entry"))).filter(c("_n") <= limit)
    wanted = asked
    for values, (_, column) in kinds.items():
        wanted = wanted.withColumn(f"_{column}", F.explode(any_of(c(values))))
    points = sum(F.when(c(column).isNotNull(), EVIDENCE_POINTS[kind]).otherwise(0) for kind, column in kinds.values())
    same = reduce(Column.__and__, (c(f"_{column}").eqNullSafe(c(column)) for column in columns))
    total = wanted.join(combined, same).groupBy(*kinds, "entry").agg(F.max(points).cast("long").alias("points"))
    best = total.withColumn("place", F.row_number().over(Window.partitionBy(*kinds).orderBy(F.desc("points"), "entry"))).filter(c("place") <= limit)
    return own.join(best, list(kinds)).select("card", "entry", "points", "place")


def title_parts(title: Column) -> Column:
    """What titles are compared by: their words and their pairs of characters; numbers in front do not count."""
    bare = F.regexp_replace(F.lower(title), r"^\s*\d+(\.\d+)*\s*", "")
    words = F.array_distinct(F.regexp_extract_all(bare, F.lit("[A-Za-z0-9]+|[一-鿿]{2,}"), 0))
    close = F.regexp_replace(bare, r"[^a-z0-9一-鿿]+", "")
    pairs = F.array_distinct(F.when(F.length(close) > 1, F.transform(F.sequence(F.lit(1), F.length(close) - 1), lambda i: F.substr(close, i, F.lit(2)))).otherwise(F.array(close)))
    return F.struct(words.alias("words"), pairs.alias("pairs"))


def parts_similarity(a: Column, b: Column) -> Column:
    """The larger of the overlaps of two titles' words and pairs of characters."""
    return F.greatest(S.jaccard(a["words"], b["words"]), S.jaccard(a["pairs"], b["pairs"]))


def title_similarity(a: Column, b: Column) -> Column:
    """The larger of the overlaps of words and of pairs of characters; numbers in front do not count."""
    return parts_similarity(title_parts(a), title_parts(b))


def alias_groups(pairs: DataFrame) -> DataFrame:
    """(term, head): terms of pairs (long, alias) that are linked over any number of pairs, with the first term of their group.

    Labels spread over the links until none changes; both sides of a link are equi-joins, so a group may be of any size.
    """
    links = pairs.select(F.col("long").alias("a"), F.col("alias").alias("b")).filter("a <> b")
    both = links.union(links.select("b", "a")).distinct()
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("head"))
    while True:
        labels = checkpointed(labels)
        nearer = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("head").alias("near"))
        new = labels.join(nearer, "a").select("a", F.least("head", "near").alias("head"))
        if not new.join(labels.withColumnRenamed("head", "was"), "a").filter("head <> was").limit(1).count():
            return labels.select(F.col("a").alias("term"), "head")
        labels = new


def mined_aliases(text: Column) -> Column:
    """array<struct<long, alias>> of long forms and abbreviations that a text puts side by side: LONG (ALIAS), LONG 简称 ALIAS."""
    forms = (r"([A-Za-z0-9一-鿿\-]{2,32})\s*[（(]([A-Z][A-Z0-9-]{1,15})[)）]", r"([A-Za-z0-9一-鿿\-]{2,32})\s*[，,:：]?\s*(?:以下简称|下简称|简称|缩写为|又称|亦称)\s*([A-Z][A-Z0-9-]{1,15})")
    found = [F.arrays_zip(F.regexp_extract_all(text, F.lit(f), 1).alias("long"), F.regexp_extract_all(text, F.lit(f), 2).alias("alias")) for f in forms]
    both = F.concat(*(F.transform(x, lambda p: F.struct(F.lower(p["long"]).alias("long"), F.lower(p["alias"]).alias("alias"))) for x in found))
    return F.array_distinct(F.filter(both, lambda p: p["long"] != p["alias"]))


def expanded(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Terms (id, term) with all members of their groups in the lexicon (term, head), each once, the term itself among them."""
    own = terms.join(lexicon, "term", "left")
    more = own.filter("head is not null").select("id", "head").distinct().join(lexicon, "head").select("id", "term")
    return terms.select("id", "term").union(more).distinct()


_ENTRIES = """SELECT p_partkey AS entry, CASE WHEN p_size % 10 = 0 THEN 'generic' ELSE p_brand END AS equipment_type, split(p_type, ' ')[{0}] AS section_type, split(p_name, ' ')[{0}] AS heading, 'file' || CAST(p_size AS STRING) AS file_name, p_name || ' ' || p_type AS text FROM {{part}}"""
_ENTRIES_SPARK, _ENTRIES_SQL = _ENTRIES.format(0), _ENTRIES.format(1)


def _sql_cards(entries: str, key: str, lists: dict[str, tuple[str, int]]) -> str:
    parts = [f"WITH e AS ({entries}), c AS (SELECT {key}, count(*) AS entry_count FROM e GROUP BY 1)"]
    for name, (column, most) in lists.items():
        parts.append(f"{name}_ AS (SELECT {key}, array_to_string(list(v ORDER BY n DESC, v), '|') AS {name} FROM (SELECT {key}, {column} AS v, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {column}) AS k FROM e WHERE {column} IS NOT NULL AND trim({column}::VARCHAR) <> '' GROUP BY 1, 2) WHERE k <= {most} GROUP BY 1)")
    return ", ".join(parts) + f" SELECT {key}, entry_count, " + ", ".join(f"coalesce({n}, '') AS {n}" for n in lists) + " FROM c " + " ".join(f"LEFT JOIN {n}_ USING ({key})" for n in lists)


def _joined(found: DataFrame, lists: dict[str, tuple[str, int]]) -> DataFrame:
    return found.withColumns({n: F.concat_ws("|", n) for n in lists})


_EQUIPMENT = {"top_section_types": ("section_type", 5), "top_headings": ("heading", 6), "source_documents": ("file_name", 4)}


@query(_sql_cards(f"SELECT * FROM ({plain(_ENTRIES_SQL)}) WHERE equipment_type <> 'generic'", "equipment_type", _EQUIPMENT))
def equipment_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each kind of equipment with its frequent section types, headings and documents."""
    return _joined(cards(shaped(spark, sf_dir, _ENTRIES_SPARK).filter("equipment_type <> 'generic'"), "equipment_type", _EQUIPMENT), _EQUIPMENT)


_MODULES = {"bolts": ["bolt"], "rings": ["RING"], "cheap": ["economy", "promo"], "none": ["zinc-free"]}
_MODULE = {"top_equipment_types": ("equipment_type", 4), "top_section_types": ("section_type", 4), "top_headings": ("heading", 6), "source_documents": ("file_name", 5)}
_HELD = " UNION ALL ".join(f"SELECT *, '{k}' AS module_key FROM f WHERE {' OR '.join(f"contains(lower(text), '{w.lower()}')" for w in words)}" for k, words in _MODULES.items())


@query(_sql_cards(f"WITH f AS ({plain(_ENTRIES_SQL)}) {_HELD}", "module_key", _MODULE))
def module_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of modules by keywords; an entry may belong to many."""
    return _joined(cards(assigned(shaped(spark, sf_dir, _ENTRIES_SPARK), _MODULES, F.col("text"), "module_key"), "module_key", _MODULE), _MODULE)


_INTERFACE = {"top_headings": ("heading", 6), "top_equipment_types": ("equipment_type", 4), "source_documents": ("file_name", 4)}


@query(_sql_cards(f"SELECT * FROM ({plain(_ENTRIES_SQL)}) WHERE section_type IN ('ECONOMY', 'PROMO', 'Economy', 'Promo')", "section_type", _INTERFACE))
def interface_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of chosen section types."""
    return _joined(cards(shaped(spark, sf_dir, _ENTRIES_SPARK).filter(F.col("section_type").isin("ECONOMY", "PROMO", "Economy", "Promo")), "section_type", _INTERFACE), _INTERFACE)


_TEMPLATE = {"common_headings": ("heading", 6), "source_documents": ("file_name", 4), "outline_examples": ("equipment_type", 3)}


@query(_sql_cards(f"SELECT * FROM ({plain(_ENTRIES_SQL)}) WHERE section_type <> 'unknown'", "section_type", _TEMPLATE))
def section_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each section type: common headings, documents and examples."""
    return _joined(cards(shaped(spark, sf_dir, _ENTRIES_SPARK).filter("section_type <> 'unknown'"), "section_type", _TEMPLATE), _TEMPLATE)


_OUTLINES = "SELECT c_mktsegment AS product_family, 'c' || CAST(c_custkey AS STRING) AS title, CAST(n.n_name AS STRING) AS nation, o.o_orderstatus AS section_type, o.o_orderpriority AS equipment_type FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey"
_PRODUCT = {"top_equipment_types": ("equipment_type", 4), "top_section_types": ("section_type", 5), "source_documents": ("nation", 6)}


@query(_sql_cards(plain(_OUTLINES), "product_family", _PRODUCT).replace("count(*) AS entry_count FROM e", "count(DISTINCT title) AS entry_count FROM e"))
def product_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each product family over its outlines and their blocks; outlines without blocks stay."""
    rows = shaped(spark, sf_dir, _OUTLINES)
    outlines = rows.select("product_family", "title").distinct().groupBy("product_family").agg(F.count("*").alias("entry_count"))
    return _joined(cards(rows, "product_family", _PRODUCT).drop("entry_count").join(outlines, "product_family"), _PRODUCT)


_ITEMS = """SELECT CASE WHEN p_partkey % 50 = 0 THEN '' ELSE 'item:' || CAST(p_partkey AS STRING) END AS item_id, CASE p_partkey % 5 WHEN 0 THEN 'term_alias' WHEN 1 THEN 'product_family' WHEN 2 THEN 'section_template' WHEN 3 THEN 'asset_type_rule' ELSE 'note' END AS item_type,
    CASE p_partkey % 13 WHEN 0 THEN '系统' WHEN 1 THEN '柜' WHEN 2 THEN '' WHEN 3 THEN '三 x' ELSE p_name END AS canonical_name, p_size % 6 AS n_evidence, CASE WHEN p_size % 9 = 4 THEN 1 ELSE 0 END AS n_bad, p_size % 4 AS n_documents, p_partkey % 7 - 1 AS reuse, p_partkey % 17 = 3 AS conflicts,
    CASE p_partkey % 11 WHEN 0 THEN 'ocr_noise_high' WHEN 1 THEN 'asset_type_uncertain,blocking:x' WHEN 2 THEN 'single_source' ELSE '' END AS base FROM {part}"""
_SQL_FLAGS = f"""f AS (SELECT *, list_filter(string_split(base, ','), lambda x: x <> '') AS b0, regexp_replace(trim(canonical_name, ' '), '[\\s/_\\-·:：]+', '', 'g') AS bare FROM ({plain(_ITEMS)})),
    g AS (SELECT *, b0 || list_filter([CASE WHEN n_evidence = 0 OR n_documents = 0 THEN 'missing_source_evidence' END, CASE WHEN n_evidence > 0 AND n_bad > 0 THEN 'source_section_missing' END, CASE WHEN n_documents = 0 THEN 'low_source_document_coverage' END, CASE WHEN n_documents < 2 THEN 'single_source' END, CASE WHEN reuse <= 0 THEN 'low_reuse_value' END,
      CASE WHEN conflicts THEN 'conflicts_with_published' END, CASE WHEN bare = '' OR bare IN ({", ".join(f"'{g}'" for g in GENERIC)}) OR (length(regexp_replace(bare, '[^一-鿿]', '', 'g')) = 1 AND length(bare) <= 2) THEN 'over_generic_term' END], lambda x: x IS NOT NULL) AS all_ FROM f),
    i AS (SELECT *, list_filter(all_, lambda x, i: NOT list_contains(list_slice(all_, 1, i - 1), x)) AS flags FROM g),
    s AS (SELECT *, CASE WHEN list_contains(flags, 'missing_source_evidence') THEN 0.0 WHEN list_contains(flags, 'over_generic_term') THEN 0.38 WHEN list_contains(flags, 'source_section_missing') THEN 0.52 ELSE
      round(least(0.95, greatest(0.0, least(CASE WHEN list_has_any(flags, {list(CEILING_FLAGS)!r}) THEN 0.74 ELSE 9 END, CASE WHEN list_contains(flags, 'asset_type_uncertain') THEN 0.68 ELSE 9 END, 0.64::DOUBLE + least(0.22::DOUBLE, n_evidence * 0.055::DOUBLE) + least(0.12::DOUBLE, n_documents * 0.04::DOUBLE) + least(0.05::DOUBLE, greatest(reuse, 0) * 0.01::DOUBLE)
        - CASE WHEN item_type = 'term_alias' AND n_evidence < 2 THEN 0.08 ELSE 0 END - CASE WHEN list_contains(flags, 'low_source_document_coverage') THEN 0.01 ELSE 0 END - CASE WHEN list_contains(flags, 'low_reuse_value') THEN 0.02 ELSE 0 END))), 4) END::DOUBLE AS score FROM i),
    l AS (SELECT *, len(list_filter(flags, lambda x: x IN ({", ".join(f"'{b}'" for b in BLOCKING)}) OR starts_with(x, 'blocking:'))) > 0 AS blocked FROM s),
    w AS (SELECT *, CASE WHEN list_has_any(flags, ['missing_source_evidence', 'over_generic_term']) THEN 'rejected' WHEN blocked THEN 'review_required' WHEN score >= 0.82 THEN 'auto_approved' WHEN score >= 0.60 THEN 'review_required' ELSE 'rejected' END AS status FROM l),
    x AS (SELECT *, status IN ('auto_approved', 'published') AND score >= 0.82 AND trim(item_id) <> '' AND item_type IN {ITEM_TYPES!r} AND trim(canonical_name) <> '' AND NOT blocked AND n_evidence > 0 AND n_bad = 0 AS publishable FROM w)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, _ITEMS)
    c = F.col
    rows = rows.withColumn("flags", quality_flags(F.split("base", ","), c("canonical_name"), c("n_evidence"), c("n_bad"), c("n_documents"), c("reuse"), c("conflicts")))
    rows = rows.withColumn("score", quality_score(c("item_type"), c("flags"), c("n_evidence"), c("n_documents"), c("reuse")))
    rows = rows.withColumn("status", quality_status(c("score"), c("flags")))
    return rows.withColumn("publishable", is_publishable(c("status"), c("score"), c("item_id"), c("item_type"), c("canonical_name"), c("flags"), c("n_evidence"), c("n_bad")))


@query(f"WITH {_SQL_FLAGS} SELECT item_id, item_type, canonical_name, array_to_string(flags, ',') AS flags, score, status, publishable FROM x")
def item_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their flags, score, status, and whether they may be published."""
    return _items(spark, sf_dir).select("item_id", "item_type", "canonical_name", F.concat_ws(",", "flags").alias("flags"), "score", "status", "publishable")


@query(f"WITH {_SQL_FLAGS}, y AS (SELECT item_type, status, unnest(list_filter(['draft', CASE WHEN publishable THEN 'published' END, CASE WHEN status IN ('rejected', 'quarantined') THEN 'rejected' END], lambda v: v IS NOT NULL)) AS layer FROM x) SELECT layer, status, item_type, count(*) AS n FROM y GROUP BY GROUPING SETS ((layer), (status), (item_type), (layer, status))")
def layer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items each layer, status and type holds, over all layers."""
    rows = in_layers(_items(spark, sf_dir), F.col("publishable")).groupBy("layer", "status", "item_type").agg(F.count("*").alias("n"))
    part = lambda *keys: rows.groupBy(*keys).agg(F.sum("n").alias("n")).select(*(F.col(c) if c in keys else F.lit(None).cast("string").alias(c) for c in ("layer", "status", "item_type")), "n")
    return part("layer").union(part("status")).union(part("item_type")).union(part("layer", "status"))


@query(f"WITH {_SQL_FLAGS}, y AS (SELECT *, count(*) OVER () AS total FROM x WHERE contains(lower(concat_ws(' ', item_id, canonical_name)), 'ring')) SELECT item_id, item_type, canonical_name, status, total FROM y ORDER BY item_type, canonical_name, item_id LIMIT 20 OFFSET 10")
def item_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the items that hold a text, in order, with the number of all."""
    found = listed(_items(spark, sf_dir), "ring", ["item_id", "canonical_name"], ["item_type", "canonical_name", "item_id"], 20, 10)
    return found.select("item_id", "item_type", "canonical_name", "status", "total")


@query(f"WITH {_SQL_FLAGS}, p AS (SELECT DISTINCT item_type || ':' || trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', '-', 'g'), '-') AS id FROM x WHERE publishable) SELECT p_partkey, p_name FROM part WHERE 'product_family:' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') IN (SELECT id FROM p)")
def published_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured assets whose derived id is that of a published item."""
    ids = _items(spark, sf_dir).filter("publishable").select(F.concat_ws(":", "item_type", T.slug(F.col("canonical_name"))).alias("id")).distinct()
    assets = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.lit("product_family:"), T.slug(F.col("p_name"))).alias("id"))
    return assets.join(ids, "id", "left_semi").select("p_partkey", "p_name")


_CARDS = "SELECT s_suppkey AS card, 'file' || CAST(s_suppkey % 50 + 1 AS STRING) || ',file' || CAST(s_suppkey % 7 + 1 AS STRING) AS documents, 'PROMO,ECONOMY,Promo' AS sections, 'Brand#' || CAST(s_suppkey % 5 + 1 AS STRING) || CAST(s_suppkey % 5 + 1 AS STRING) AS equipment, 'ring,gear' AS terms FROM {supplier}"


@query(
    f"""WITH e AS ({plain(_ENTRIES_SQL)}), c AS (SELECT card, string_split(documents, ',') AS documents, string_split(sections, ',') AS sections, string_split(equipment, ',') AS equipment, string_split(terms, ',') AS terms FROM ({plain(_CARDS)})),
    p AS (SELECT card, entry, 4 * list_contains(documents, file_name)::INT + 3 * list_contains(sections, section_type)::INT + 2 * list_contains(equipment, equipment_type)::INT + (contains(lower(text), 'ring') OR contains(lower(text), 'gear'))::INT AS points FROM c, e),
    r AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY points DESC, entry) AS place FROM p WHERE points > 0) SELECT card, entry, points::BIGINT AS points, place::INT AS place FROM r WHERE place <= 6"""
)
def card_evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best entries of evidence for each card."""
    entries = shaped(spark, sf_dir, _ENTRIES_SPARK).select("entry", F.col("file_name").alias("document"), F.col("section_type").alias("section"), "equipment_type", "text")
    wanted = shaped(spark, sf_dir, _CARDS).select("card", *(F.split(c, ",").alias(c) for c in ("documents", "sections", "equipment", "terms")))
    return card_evidence(wanted, entries, 6)


_WORDS_RE, _CLOSE_RE = "[A-Za-z0-9]+|[一-鿿]{2,}", r"[^a-z0-9一-鿿]+"


def _sql_similarity(a: str, b: str) -> str:
    bare = lambda c: rf"regexp_replace(lower({c}), '^\s*\d+(\.\d+)*\s*', '')"
    words = lambda c: f"list_distinct(regexp_extract_all({bare(c)}, '{_WORDS_RE}'))"
    close = lambda c: f"regexp_replace({bare(c)}, '{_CLOSE_RE}', '', 'g')"
    pairs = lambda c: f"list_distinct(CASE WHEN length({close(c)}) > 1 THEN list_transform(range(1, length({close(c)})), lambda i: substr({close(c)}, i, 2)) ELSE [{close(c)}] END)"
    jaccard = lambda x, y: f"coalesce(len(list_intersect({x}, {y})) / nullif(len({x}) + len({y}) - len(list_intersect({x}, {y})), 0), 0)"
    return f"greatest({jaccard(words(a), words(b))}, {jaccard(pairs(a), pairs(b))})"


@query(
    f"""WITH t AS (SELECT DISTINCT p_type AS title FROM part), g AS (SELECT n_nationkey AS section_id, (n_nationkey % 7)::VARCHAR || '.1 ' || lower(n_name) || ' polished steel' AS title FROM nation),
    s AS (SELECT t.title, g.section_id, round({_sql_similarity("t.title", "g.title")}, 6) AS score FROM t, g), r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY score DESC, section_id) AS k FROM s) SELECT title, section_id, score, score >= 0.55 AS covered, score < 0.34 AS missing FROM r WHERE k = 1"""
)
def outline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each title of a baseline the generated section that comes nearest, and whether it covers it."""
    wanted = table(spark, sf_dir, "part").select(F.col("p_type").alias("title")).distinct().withColumn("own", title_parts(F.col("title")))
    made = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("section_id"), F.concat((F.col("n_nationkey") % 7).cast("string"), F.lit(".1 "), F.lower("n_name"), F.lit(" polished steel")).alias("other")).withColumn("its", title_parts(F.col("other")))
    pairs = wanted.join(F.broadcast(made), F.lit(True))  # sections of one outline
    best = F.max(F.struct(F.round(parts_similarity(F.col("own"), F.col("its")), 6).alias("score"), (-F.col("section_id")).alias("order"))).alias("b")
    found = pairs.groupBy("title").agg(best).select("title", (-F.col("b.order")).alias("section_id"), F.col("b.score").alias("score"))
    return found.select("title", "section_id", "score", (F.col("score") >= 0.55).alias("covered"), (F.col("score") < 0.34).alias("missing"))


_ALIASED = "SELECT p_partkey AS id, p_name || ' 变频装置' || CAST(p_partkey % 40 AS STRING) || '(VFD' || CAST(p_partkey % 30 AS STRING) || ')，主回路' || CAST(p_partkey % 25 AS STRING) || '简称 MC' || CAST(p_partkey % 30 AS STRING) AS text FROM {part}"


@query(
    rf"""WITH RECURSIVE d AS (SELECT {plain(_ALIASED)[7:].replace("p_partkey AS id, ", "")}), m AS (SELECT regexp_extract_all(text, '([A-Za-z0-9一-鿿\-]{{2,32}})\s*[（(]([A-Z][A-Z0-9-]{{1,15}})[)）]', 1) AS a, regexp_extract_all(text, '([A-Za-z0-9一-鿿\-]{{2,32}})\s*[（(]([A-Z][A-Z0-9-]{{1,15}})[)）]', 2) AS b,
      regexp_extract_all(text, '([A-Za-z0-9一-鿿\-]{{2,32}})\s*[，,:：]?\s*(?:以下简称|下简称|简称|缩写为|又称|亦称)\s*([A-Z][A-Z0-9-]{{1,15}})', 1) AS c, regexp_extract_all(text, '([A-Za-z0-9一-鿿\-]{{2,32}})\s*[，,:：]?\s*(?:以下简称|下简称|简称|缩写为|又称|亦称)\s*([A-Z][A-Z0-9-]{{1,15}})', 2) AS e FROM d),
    p AS (SELECT DISTINCT lower(x) AS x, lower(y) AS y FROM (SELECT unnest(a) AS x, unnest(b) AS y FROM m UNION ALL SELECT unnest(c), unnest(e) FROM m) WHERE lower(x) <> lower(y)), q AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
    t AS (SELECT x AS term, x AS near FROM q UNION SELECT t.term, q.y FROM t JOIN q ON t.near = q.x) SELECT term, min(near) AS head FROM t GROUP BY 1"""
)
def term_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and abbreviations that texts put side by side, united over all their links."""
    pairs = shaped(spark, sf_dir, _ALIASED).select(F.explode(mined_aliases(F.col("text"))).alias("p")).select("p.long", "p.alias").distinct()
    return alias_groups(pairs)


#: From which similarity a title covers another, and below which it is missing.
COVERED, MISSING = 0.55, 0.34


def best_titles(baseline: DataFrame, generated: DataFrame) -> DataFrame:
    """(outline_id, title, section_id, score, covered, missing): for each title of a baseline (outline_id, title) the section (outline_id, section_id, title) of the same outline that comes nearest.

    Titles meet only within an outline, which is a short list. Equal scores go to the least id; a title whose outline has no
    section, or none that is like it at all, is missing with a score of 0.
    """
    c = F.col
    # titles are taken apart once each, before they meet
    wanted = baseline.select("outline_id", "title").distinct().withColumn("_own", title_parts(F.coalesce("title", F.lit(""))))
    pairs = wanted.join(generated.select("outline_id", "section_id", c("title").alias("_other"), title_parts(F.coalesce("title", F.lit(""))).alias("_its")), "outline_id", "left")
    score = F.round(F.coalesce(parts_similarity(c("_own"), c("_its")), F.lit(0.0)), 6)
    order = Window.partitionBy("outline_id", "title").orderBy(F.desc("score"), "section_id")
    scores = pairs.withColumn("score", F.when(c("_other").isNull(), F.lit(0.0)).otherwise(score)).drop("_own", "_its", "_other")
    best = scores.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return best.select("outline_id", "title", F.when(c("score") > 0, c("section_id")).alias("section_id"), "score", (c("score") >= COVERED).alias("covered"), (c("score") < MISSING).alias("missing"))


def coverage(matches: DataFrame) -> DataFrame:
    """(outline_id, n_titles, n_covered, n_missing, share) of each outline's matches."""
    found = matches.groupBy("outline_id").agg(F.count("*").alias("n_titles"), F.count_if("covered").alias("n_covered"), F.count_if("missing").alias("n_missing"))
    return found.withColumn("share", F.round(F.col("n_covered") / F.col("n_titles"), 4))


_BASELINE = "SELECT CAST(floor(doc_id / 12) AS BIGINT) AS outline_id, doc_id AS section_id, CAST(doc_id % 9 AS STRING) || '.' || CAST(doc_id % 4 AS STRING) || ' ' || substr(text, 1, 24) AS title FROM {documents} WHERE doc_id % 12 < 7"
_MADE = "SELECT CAST(floor(doc_id / 12) AS BIGINT) AS outline_id, doc_id AS section_id, CASE doc_id % 3 WHEN 0 THEN substr(text, 3, 20) ELSE '2.1 ' || source || ' ' || substr(text, 1, 18) END AS title FROM {documents} WHERE doc_id % 12 > 3 AND floor(doc_id / 12) % 10 <> 4"


@query(
    f"""WITH b AS (SELECT DISTINCT outline_id, title FROM ({plain(_BASELINE)})), g AS (SELECT * FROM ({plain(_MADE)})), p AS (SELECT b.outline_id, b.title, g.section_id, CASE WHEN g.title IS NULL THEN 0 ELSE round({_sql_similarity("b.title", "g.title")}, 6) END AS score FROM b LEFT JOIN g ON g.outline_id = b.outline_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY outline_id, title ORDER BY score DESC, section_id) AS n FROM p) SELECT outline_id, count(*) AS n_titles, count(*) FILTER (WHERE score >= 0.55) AS n_covered, count(*) FILTER (WHERE score < 0.34) AS n_missing, round(count(*) FILTER (WHERE score >= 0.55) / count(*), 4) AS share, sum(CASE WHEN score > 0 THEN section_id END)::BIGINT AS sections FROM r WHERE n = 1 GROUP BY 1"""
)
def outline_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each outline's baseline its sections cover, title by title within the outline."""
    matches = best_titles(shaped(spark, sf_dir, _BASELINE), shaped(spark, sf_dir, _MADE))
    chosen = matches.groupBy("outline_id").agg(F.sum("section_id").alias("sections"))
    return coverage(matches).join(chosen, "outline_id")


#: From which lexical points a card is considered without its section type, and without its equipment.
LEXICAL, LEXICAL_ALONE = 2, 3


def product_matches(requests: DataFrame, cards_: DataFrame, most: int = 3) -> DataFrame:
    """(request_id, card_id, points, place): the product cards that go with each request by its words, section type and equipment.

    requests: (request_id, bundle_id, query, section_type, equipment_type); cards_: (bundle_id, card_id, texts, sections, equipment,
    entry_count), sections and equipment arrays of struct<value, count>. Requests meet the cards of their own bundle, a short list.
    A card needs its section type or LEXICAL points, and where equipment is asked for that it has not, its section type or
    LEXICAL_ALONE points. Ties go to the larger entry count, then to the lesser id.
    """
    c = F.col
    pairs = requests.join(cards_, "bundle_id")
    words = F.aggregate(F.transform(F.coalesce("texts", F.array().cast("array<string>")), lambda t: text_match(F.coalesce(t, F.lit("")), c("query"))), F.lit(0), lambda s, n: s + n)
    rows = pairs.withColumns({"query": F.coalesce("query", F.lit("")), "_s": F.coalesce("section_type", F.lit("")), "_e": F.lower(F.coalesce("equipment_type", F.lit("")))})
    rows = rows.withColumns({"_words": words, "_section": distribution_count(c("sections"), "value", c("_s")), "_equipment": distribution_count(c("equipment"), "value", c("_e"))})
    asked = ~c("_e").isin("", "generic", "unknown")
    fits = (c("_section") > 0) | ((c("_words") >= LEXICAL) & ~(asked & (c("_equipment") <= 0) & (c("_words") < LEXICAL_ALONE)))
    found = rows.filter(fits).withColumn("points", c("_section") + c("_words") + c("_equipment"))
    order = Window.partitionBy("request_id").orderBy(F.desc("points"), F.desc("entry_count"), "card_id")
    return found.withColumn("place", F.row_number().over(order)).filter(c("place") <= most).select("request_id", "card_id", "points", "place")


_WANTS = "SELECT c_custkey AS request_id, CAST(floor(c_custkey / 120) AS INT) AS bundle_id, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'the red bolt x' ELSE 'Supplier ' || CAST(c_custkey % 90 AS STRING) || ' bolt ring' END AS query, CASE c_custkey % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'T1' WHEN 2 THEN 't2' ELSE '' END AS section_type, CASE c_custkey % 3 WHEN 0 THEN 'generic' WHEN 1 THEN 'lci' ELSE 'VFD' END AS equipment_type FROM {customer}"
_OFFERS = "SELECT CAST(floor(s_suppkey / 8) AS INT) AS bundle_id, s_suppkey AS card_id, CASE s_suppkey % 4 WHEN 0 THEN 'red  Bolt|ring' WHEN 1 THEN 'Supplier ' || CAST(s_suppkey AS STRING) WHEN 2 THEN '' ELSE 'ring|bolt|the' END AS texts, CASE s_suppkey % 3 WHEN 0 THEN 't1:3|T2:1' WHEN 1 THEN 't2:2|t2:5' ELSE '' END AS sections, CASE s_suppkey % 5 WHEN 0 THEN 'vfd:2' WHEN 1 THEN 'lci:4|generic:9' ELSE '' END AS equipment, s_nationkey AS entry_count FROM {supplier}"


def _sql_matches() -> str:
    flat = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'), ' ')"
    words = lambda x: f"list_distinct(regexp_extract_all({flat(x)}, '[a-z0-9_+-]{{2,}}|[一-鿿]{{2,}}'))"
    parts = lambda x: f"list_filter(string_split({x}, '|'), lambda v: v <> '')"
    count = lambda x, want: f"CASE WHEN lower({want}) IN ('', 'generic', 'unknown') THEN 0 ELSE coalesce(list_max(list_transform(list_filter({parts(x)}, lambda v: lower(string_split(v, ':')[1]) = lower({want})), lambda v: string_split(v, ':')[2]::DOUBLE)), 0) END::DOUBLE"
    lexical = f"list_sum(list_transform({parts('texts')} || [''], lambda t: CASE WHEN {flat('t')} = '' THEN 0 ELSE CASE WHEN contains({flat('query')}, {flat('t')}) THEN 3 ELSE 0 END + len(list_intersect({words('query')}, {words('t')})) END))"
    return f"""WITH p AS (SELECT *, {lexical} AS w, {count('sections', 'section_type')} AS s, {count('equipment', 'equipment_type')} AS e FROM ({plain(_WANTS)}) JOIN ({plain(_OFFERS)}) USING (bundle_id)),
    f AS (SELECT *, s + w + e AS points FROM p WHERE s > 0 OR (w >= 2 AND NOT (lower(equipment_type) NOT IN ('', 'generic', 'unknown') AND e <= 0 AND w < 3))), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY points DESC, entry_count DESC, card_id) AS place FROM f) SELECT request_id, card_id, points::DOUBLE AS points, place::INT AS place FROM r WHERE place <= 3"""


@query(_sql_matches())
def product_card_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product cards that go with each request."""
    items = lambda n: F.filter(F.split(n, "[|]"), lambda v: v != "")
    counted = lambda n: F.transform(items(n), lambda v: F.struct(F.split(v, ":")[0].alias("value"), F.split(v, ":")[1].alias("count")))
    offers = shaped(spark, sf_dir, _OFFERS).withColumns({"texts": items("texts"), "sections": counted("sections"), "equipment": counted("equipment")})
    return product_matches(shaped(spark, sf_dir, _WANTS), offers)


#: Items whose terms are part of one plan.
ITEM_BLOCK = 64
#: The fields of an entry in which terms are looked for.
FIELDS = ("heading_path", "source_heading", "summary", "content", "retrieval_text")


def evidence_for_terms(items: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """(item_id, entry, place): the first n entries, in their order, in one of whose fields stands a term of the item, whatever the case.

    items: (item_id, terms), a lexicon, taken in blocks whose terms go into the plan; entries: (entry, place, FIELDS). An entry that
    holds none of a block's terms gives no row, so no pair is made that does not match. Entries that occur again count once, after the cut.
    """
    c = F.col
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in FIELDS)))
    kind = items.schema["item_id"].dataType
    out = None
    for block in ranking.query_blocks(items.select(c("item_id").alias("query_id"), F.filter(F.transform("terms", lambda t: F.lower(F.trim(t))), lambda t: t != "").alias("terms")), ITEM_BLOCK):
        asked = F.array(*(F.struct(F.lit(r["query_id"]).cast(kind).alias("item_id"), F.array(*map(F.lit, r["terms"])).cast("array<string>").alias("terms")) for r in block.to_pylist()))
        rows = entries.select("entry", "place", hay.alias("_hay")).withColumn("_q", F.explode(F.filter(asked, lambda q: F.exists(q["terms"], lambda t: c("_hay").contains(t)))))
        found = rows.select("_q.item_id", "entry", "place")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return items.select("item_id", F.lit(None).alias("entry"), F.lit(0).alias("place")).limit(0)
    order = Window.partitionBy("item_id").orderBy("place", "entry")
    first = out.withColumn("_n", F.row_number().over(order)).filter(c("_n") <= n)
    return first.groupBy("item_id", "entry").agg(F.min("_n").alias("place"))


_TERMS_OF = "SELECT n_nationkey AS item_id, lower(substr(n_name, 1, 3)) || ',' || CASE n_nationkey % 4 WHEN 0 THEN ' Que ' WHEN 1 THEN 'der u' WHEN 2 THEN 'SRC' || CAST(n_nationkey % 5 AS STRING) ELSE '' END AS terms FROM {nation}"
_FIELDS = "SELECT doc_id % 400 AS entry, doc_id AS place, source AS heading_path, lang AS source_heading, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'type' END AS summary, text AS content, 'generic' AS retrieval_text FROM {documents}"


@query(
    f"""WITH i AS (SELECT item_id, list_filter(list_transform(string_split(terms, ','), lambda t: lower(trim(t))), lambda t: t <> '') AS terms FROM ({plain(_TERMS_OF)})), e AS (SELECT entry, place, lower(heading_path || ' ' || source_heading || ' ' || coalesce(summary, '') || ' ' || content || ' ' || retrieval_text) AS hay FROM ({plain(_FIELDS)})),
    m AS (SELECT item_id, entry, row_number() OVER (PARTITION BY item_id ORDER BY place, entry) AS n FROM i, e WHERE len(list_filter(terms, lambda t: contains(hay, t))) > 0) SELECT item_id, entry, min(n)::INT AS place FROM m WHERE n <= 600 GROUP BY 1, 2"""
)
def lexicon_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 600 places where terms of each item stand, each entry once."""
    items = shaped(spark, sf_dir, _TERMS_OF).withColumn("terms", F.split("terms", ","))
    return evidence_for_terms(items, shaped(spark, sf_dir, _FIELDS), 600)
