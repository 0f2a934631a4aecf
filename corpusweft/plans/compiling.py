"""A library of entries compiled into knowledge cards, pages and a manifest, step by step.

A step compares a hash of each document's entries with that of the step before. Cards depend on entries through their keys
alone, so only the keys of documents that came, went or changed, old keys and new ones, are built again; all other cards are
carried over. The result equals a compilation of everything. A step writes a generation of its own and marks it as done
last, so one that dies leaves the generation before in place, and a step without changes writes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import knowledge as K
from ..registry import plain, query, shaped
from ..sources.shared import checkpointed, shared_folder


@dataclass(frozen=True)
class Kind:
    """A category of cards: the column (or array of columns' values) of entries that is its key, and what a card lists: name -> (column, most)."""

    category: str
    key: str
    lists: dict[str, tuple[str, int]]


def file_key(name: Column) -> Column:
    """A file's name as it is compared: whatever its case and white space."""
    return F.regexp_replace(F.lower(name), r"\s+", "")


def merged(baseline: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Entries (document_id, file_name, ...) of both libraries; of a file that both have, those that were uploaded."""
    own = uploaded.withColumn("_file", file_key(F.col("file_name")))
    rest = baseline.withColumn("_file", file_key(F.col("file_name"))).join(own.select("_file").distinct(), "_file", "left_anti")
    return own.drop("_file").unionByName(rest.drop("_file"))


def keyed(entries: DataFrame, kind: Kind) -> DataFrame:
    """The entries with ``card_key``: once for each key they have; no key, no row."""
    keys = F.col(kind.key) if entries.schema[kind.key].dataType.simpleString().startswith("array") else F.array(F.col(kind.key).cast("string"))
    return entries.withColumn("card_key", F.explode(F.array_distinct(F.filter(keys, lambda k: F.trim(k) != ""))))


def built(entries: DataFrame, kinds: list[Kind], touched: DataFrame | None = None) -> DataFrame:
    """(category, card_key, entry_count, facts map<string, array<string>>) of all cards, or of those touched (category, card_key)."""
    out = []
    for kind in kinds:
        rows = keyed(entries, kind)
        if touched is not None:
            rows = rows.join(touched.filter(F.col("category") == kind.category).select("card_key"), "card_key", "left_semi")
        found = K.cards(rows, "card_key", kind.lists)
        facts = F.create_map(*(x for name in kind.lists for x in (F.lit(name), F.col(name).cast("array<string>"))))
        out.append(found.select(F.lit(kind.category).alias("category"), "card_key", "entry_count", facts.alias("facts")))
    return reduce(DataFrame.unionByName, out)


def fingerprints(entries: DataFrame) -> DataFrame:
    """(document_id, fingerprint): a hash of each document's entries, whatever their order."""
    names = [n for n in entries.columns if n != "document_id"]
    one = F.sha2(F.to_json(F.struct(*names)), 256)
    return entries.groupBy("document_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), ""), 256).alias("fingerprint"))  # one document's entries


def links(entries: DataFrame, kinds: list[Kind]) -> DataFrame:
    """(document_id, category, card_key): the cards that each document's entries are in."""
    return reduce(DataFrame.unionByName, (keyed(entries, k).select("document_id", F.lit(k.category).alias("category"), "card_key").distinct() for k in kinds))


def generation(spark: SparkSession, folder: str) -> int | None:
    """The last generation that is done."""
    try:
        done = spark.read.option("basePath", f"{folder}/done").parquet(f"{folder}/done")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return done.agg(F.max("generation")).first()[0]


def compiled(spark: SparkSession, folder: str) -> DataFrame:
    """The cards of the last generation."""
    return spark.read.parquet(f"{folder}/cards/generation={generation(spark, folder)}")


def step(entries: DataFrame, folder: str, kinds: list[Kind]) -> dict[str, int]:
    """Bring the cards in a folder up to date with the entries (document_id, ...); how many documents changed and cards were built."""
    spark = entries.sparkSession
    last = generation(spark, folder)
    fresh = checkpointed(fingerprints(entries))
    if last is None:
        changed = fresh.select("document_id")
    else:
        old = {name: spark.read.parquet(f"{folder}/{name}/generation={last}") for name in ("cards", "sources", "links")}
        was = old["sources"].withColumnRenamed("fingerprint", "was")
        changed = checkpointed(fresh.join(was, "document_id", "full").filter(~F.col("fingerprint").eqNullSafe(F.col("was"))).select("document_id"))
    n_changed = changed.count()
    if not n_changed and last is not None:
        return {"documents": 0, "cards": 0}
    now = links(entries.join(changed, "document_id", "left_semi"), kinds)
    touched = now if last is None else now.union(old["links"].join(changed, "document_id", "left_semi"))
    touched = checkpointed(touched.select("category", "card_key").distinct())
    cards = checkpointed(built(entries, kinds, touched))
    n_built = cards.count()
    if last is not None:
        cards = cards.unionByName(old["cards"].join(touched, ["category", "card_key"], "left_anti"))
        now = now.unionByName(old["links"].join(changed, "document_id", "left_anti"))
    number = 0 if last is None else last + 1
    for name, rows in (("cards", cards), ("sources", fresh), ("links", now)):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/generation={number}")
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/done/generation={number}")
    return {"documents": n_changed, "cards": n_built}


def pages(cards: DataFrame) -> DataFrame:
    """(path, title, category, content): a page for each card, and an index of all with how many entries each has."""
    line = lambda name, values: F.concat(F.lit("- "), name, F.lit(": "), F.array_join(values, ", "))
    listed = F.transform(F.array_sort(F.map_entries("facts")), lambda x: line(x["key"], x["value"]))
    body = F.concat_ws("\n", F.concat(F.lit("# "), "card_key"), F.concat(F.lit("entries: "), F.col("entry_count").cast("string")), F.array_join(listed, "\n"))
    path = F.concat("category", F.lit("/"), F.regexp_replace(F.lower("card_key"), r"[^0-9a-z一-鿿]+", "-"), F.lit(".md"))
    own = cards.select(path.alias("path"), F.col("card_key").alias("title"), "category", body.alias("content"))
    # one line a card and one index a category, so that no page grows with all of them
    n = F.row_number().over(Window.partitionBy("category").orderBy("card_key"))
    lines = cards.withColumn("n", n).groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "card_key", "entry_count"))), lambda x: F.concat(F.lit("- "), x["card_key"], F.lit(" ("), x["entry_count"].cast("string"), F.lit(")"))), "\n").alias("content"))
    return own.unionByName(lines.select(F.concat("category", F.lit("/index.md")).alias("path"), F.col("category").alias("title"), "category", "content"))


def manifest(cards: DataFrame) -> DataFrame:
    """(category, n_cards, n_entries)."""
    return cards.groupBy("category").agg(F.count("*").alias("n_cards"), F.sum("entry_count").alias("n_entries"))


_KINDS = [Kind("equipment", "equipment_type", {"top_headings": ("heading", 3), "source_documents": ("file_name", 2)}), Kind("templates", "section_type", {"common_headings": ("heading", 2)})]
_LIBRARY = """SELECT CAST(floor(p_partkey / 5) AS BIGINT) AS document_id, 'f' || CAST(CAST(floor(p_partkey / 5) AS BIGINT) % 40 AS STRING) AS file_name, p_brand AS equipment_type, CASE p_partkey % 9 WHEN 0 THEN '' ELSE 't' || CAST(p_size % 12 AS STRING) END AS section_type, p_type AS heading FROM {part}"""
_LAST = f"SELECT document_id, file_name, CASE WHEN document_id % 6 = 1 THEN 'new' ELSE equipment_type END AS equipment_type, section_type, heading FROM ({_LIBRARY}) WHERE document_id % 7 <> 3"


def _sql_kind(kind: Kind) -> str:
    parts = "; ".join(kind.lists)
    return f"SELECT '{kind.category}' AS category, {kind.key} AS card_key, entry_count, {' || chr(59) || '.join(kind.lists)} AS facts FROM ({K._sql_cards(f'SELECT * FROM ({plain(_LAST)}) WHERE trim({kind.key}) <> {chr(39) * 2}', kind.key, kind.lists)}) /* {parts} */"


@query(" UNION ALL ".join(_sql_kind(k) for k in _KINDS))
def incremental_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards after three steps: a library without some documents, one with all of them, and one with some changed and others gone."""
    folder = f"{shared_folder(spark)}/compiled-{spark.range(1).select(F.uuid()).first()[0]}"
    whole = shaped(spark, sf_dir, _LIBRARY)
    for entries in (whole.filter("document_id % 11 <> 2"), whole, shaped(spark, sf_dir, _LAST)):
        step(entries, folder, _KINDS)
    lists = {k.category: list(k.lists) for k in _KINDS}
    facts = reduce(lambda found, item: found.when(F.col("category") == item[0], F.concat_ws(";", *(F.array_join(F.col("facts")[n], "|") for n in item[1]))), list(lists.items())[1:], F.when(F.col("category") == "equipment", F.concat_ws(";", *(F.array_join(F.col("facts")[n], "|") for n in lists["equipment"]))))
    return compiled(spark, folder).select("category", "card_key", "entry_count", facts.alias("facts"))
