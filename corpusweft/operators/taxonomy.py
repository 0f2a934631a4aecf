"""Rules as data: registries of synonyms and rules, classification by keywords, evidence for terms, excerpts within a budget."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table

HEADING_POINTS, CONTENT_POINTS = 5, 1
#: Fixed value: what separates the parts of a term.
SEPARATORS = r"[/+|,_-]+"
TERMS = ["idiot", "scum", "stupid", "moron", "trash"]


@dataclass(frozen=True)
class Registry:
    """Synonym groups, rules (key, keywords) in order, words of content forms, and what each section type goes with.

    A registry is a configuration of some hundred rows that every expression needs whole, so it goes into plans as literals.
    """

    synonyms: tuple[tuple[str, ...], ...] = ()
    section_types: tuple[tuple[str, tuple[str, ...]], ...] = ()
    equipment_types: tuple[tuple[str, tuple[str, ...]], ...] = ()
    content_forms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    support_forms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    related_types: dict[str, tuple[str, ...]] = field(default_factory=dict)
    asset_hints: dict[str, tuple[str, ...]] = field(default_factory=dict)
    extractive: tuple[str, ...] = ()
    table_reference_only: tuple[str, ...] = ()

    def expanded(self, term: str) -> list[str]:
        """A term, its spelling without spaces or separators, its parts, and all synonyms of these and of aliases inside them, each once."""
        low = " ".join(term.lower().split())
        parts = [p.strip() for p in re.split(SEPARATORS, low) if len(p.strip()) >= 2]
        joined = re.sub(SEPARATORS, "", low).strip()
        out: dict[str, None] = {}
        for variant in dict.fromkeys([low, low.replace(" ", ""), *parts, *([joined] if len(joined) >= 2 else [])]):
            if not variant:
                continue
            out[variant] = None
            for group in self.synonyms:
                if any(alias in variant for alias in group):
                    out.update(dict.fromkeys(group))
        return list(out)


def read_registry(spark: SparkSession, folder: str) -> Registry:
    """A registry from synonyms.json, section_types.json, equipment_types.json and retrieval_policies.json of a folder; missing files count as empty."""
    from pyspark.errors import AnalysisException

    def rows(name: str, schema: str) -> dict:
        try:
            found = spark.read.schema(f"schema_version int, {schema}").option("multiLine", True).json(f"{folder}/{name}.json").first()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return {}
        if found is None:
            return {}
        if found["schema_version"] is None:
            raise ValueError(f"{name}.json has no schema_version")
        return found.asDict(recursive=True)

    words = lambda values: tuple(dict.fromkeys(v.strip().lower() for v in values or [] if v and v.strip()))
    rules = lambda items: tuple((r["key"].lower(), words(r["keywords"])) for r in items or [])
    of = lambda items, name: {r["key"].lower(): words(r[name]) for r in items or []}
    lists = lambda m: {k.lower(): words(v) for k, v in (m or {}).items()}
    syn = rows("synonyms", "synonym_groups array<struct<canonical:string,aliases:array<string>>>").get("synonym_groups")
    sections = rows("section_types", "section_types array<struct<key:string,label:string,keywords:array<string>,support_content_forms:array<string>,related_section_types:array<string>>>, content_form_terms map<string,array<string>>")
    equipment = rows("equipment_types", "equipment_types array<struct<key:string,label:string,keywords:array<string>>>").get("equipment_types")
    policies = rows("retrieval_policies", "section_type_groups map<string,array<string>>, mappings struct<section_asset_query_hints:map<string,array<string>>>")
    types, groups = sections.get("section_types"), lists(policies.get("section_type_groups"))
    return Registry(
        tuple(words([g["canonical"], *(g["aliases"] or [])]) for g in syn or []),
        rules(types),
        rules(equipment),
        lists(sections.get("content_form_terms")),
        of(types, "support_content_forms"),
        of(types, "related_section_types"),
        lists((policies.get("mappings") or {}).get("section_asset_query_hints")),
        groups.get("extractive_section_types", ()),
        groups.get("table_placeholder_reference_only_section_types", ()),
    )


def contains(registry: Registry, text: Column, term: str) -> Column:
    """Whether a text holds a term or one of its synonyms, whatever the case and white space."""
    low, close = F.lower(text), F.regexp_replace(F.lower(text), r"\s+", "")
    found = F.lit(False)
    for alias in registry.expanded(term):
        found = found | low.contains(alias) | close.contains(alias.replace(" ", ""))
    return found


def contains_any(registry: Registry, text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | contains(registry, text, term)
    return found


def best_rule(registry: Registry, rules: tuple[tuple[str, tuple[str, ...]], ...], heading: Column, content: Column, default: str) -> Column:
    """The first best rule: its keywords in the heading count HEADING_POINTS, in the content CONTENT_POINTS."""
    points = lambda words: F.when(contains_any(registry, heading, words), F.lit(HEADING_POINTS)).otherwise(F.lit(0)) + F.when(contains_any(registry, content, words), F.lit(CONTENT_POINTS)).otherwise(F.lit(0))
    if not rules:
        return F.lit(default)
    best = F.array_max(F.array(*(F.struct(points(words).alias("score"), F.lit(-n).alias("n"), F.lit(key).alias("key")) for n, (key, words) in enumerate(rules))))
    return F.when(best["score"] > 0, best["key"]).otherwise(F.lit(default))


def content_form(registry: Registry, text: Column, kind: Column, front: Column, needs_asset: Column, formula: Column, section_type: Column) -> Column:
    """The first that fits: page furniture, certificate, kinds of tables, formula, figure, else narrative."""
    of = lambda name: contains_any(registry, text, registry.content_forms.get(name, ()))
    interface = (section_type == "communication_interface") & of("interface")
    as_table = F.when(interface, F.lit("interface_table")).when(of("bom"), F.lit("bom_table")).when(of("interface"), F.lit("interface_table")).when(of("protection"), F.lit("protection_table")).otherwise(F.lit("parameter_table"))
    return F.when(front, F.lit("page_furniture")).when(of("certificate"), F.lit("certificate")).when(F.upper(kind) == "TABLE", as_table).when(interface, F.lit("narrative")).when(formula, F.lit("formula")).when(needs_asset & of("figure"), F.lit("figure")).otherwise(F.lit("narrative"))


def classified(registry: Registry, docs: DataFrame) -> DataFrame:
    """The rows (heading, text, kind, front, needs_asset, formula, ...) with section_type, equipment_type and content_form; of a text the first 2000 characters count, as everywhere where chunks are classified."""
    c = F.col
    content = F.substring("text", 1, 2000)
    typed = docs.withColumn("section_type", best_rule(registry, registry.section_types, c("heading"), content, "unknown")).withColumn("equipment_type", best_rule(registry, registry.equipment_types, c("heading"), content, "generic"))
    return typed.withColumn("content_form", content_form(registry, F.concat_ws("\n", "heading", content), c("kind"), c("front"), c("needs_asset"), c("formula"), c("section_type")))


def target(registry: Registry, section_type: Column, expected: Column, needs_table: Column) -> Column:
    """struct<preferred, support, related>: content forms and section types that go with what a section asks for."""
    lists = lambda m: F.create_map(*(x for k, v in m.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")))) if m else F.create_map().cast("map<string,array<string>>")
    want = lambda *names: F.arrays_overlap(F.transform(expected, lambda e: F.lower(e)), F.array(*map(F.lit, names)))
    commercial = section_type == "commercial_manual_only"
    preferred = F.array_compact(F.array(F.lit("narrative"), F.when(commercial | section_type.isin("bom_or_supply_list", "supply_scope"), F.lit("bom_table")), F.when(needs_table & ~commercial, F.lit("parameter_table")), F.when(want("interface", "communication"), F.lit("interface_table")), F.when(want("figure", "diagram"), F.lit("figure")), F.when(want("formula", "equation"), F.lit("formula"))))
    none = F.array().cast("array<string>")
    return F.struct(preferred.alias("preferred"), F.coalesce(F.try_element_at(lists(registry.support_forms), section_type), F.array(F.lit("narrative"))).alias("support"), F.coalesce(F.try_element_at(lists(registry.related_types), section_type), none).alias("related"))


def policy(registry: Registry, section_type: Column) -> Column:
    """struct<hints, extractive, table_reference_only> of a section type."""
    hints = F.array().cast("array<string>")
    for key, values in registry.asset_hints.items():
        hints = F.when(section_type == key, F.array(*map(F.lit, values))).otherwise(hints)
    return F.struct(hints.alias("hints"), section_type.isin(*registry.extractive).alias("extractive") if registry.extractive else F.lit(False).alias("extractive"), section_type.isin(*registry.table_reference_only).alias("table_reference_only") if registry.table_reference_only else F.lit(False).alias("table_reference_only"))


#: A registry for the test tables, whose invented texts hold no terms of any trade.
EXAMPLE = Registry(
    (("with", "avec", "mit"), ("that", "dass", "que"), ("scum", "trash")),
    (("communication_interface", ("avec", "th for")), ("supply_scope", ("dans", "der")), ("quality", ("que", "ción")), ("other", ("e",))),
    (("motor", ("idiot", "ring")), ("cabinet", ("scum",))),
    {"certificate": ("license",), "interface": ("@mail",), "bom": ("the ",), "protection": ("der ",), "figure": ("tion",)},
    {"quality": ("narrative", "figure"), "other": ("narrative",)},
    {"quality": ("other",), "supply_scope": ("quality",)},
    {"quality": ("diagram", "curve")},
    ("quality",),
    ("supply_scope",),
)
_HAS = lambda text, term: "(" + " OR ".join(f"contains(lower({text}), '{a}') OR contains(regexp_replace(lower({text}), '\\s+', '', 'g'), '{a.replace(' ', '')}')" for a in EXAMPLE.expanded(term)) + ")"
_ANY = lambda text, terms: "(" + " OR ".join(_HAS(text, t) for t in terms) + ")"
_RULES = lambda rules, default: f"(SELECT CASE WHEN score > 0 THEN key ELSE '{default}' END FROM (VALUES " + ", ".join(f"('{key}', {n}, CASE WHEN {_ANY('h', words)} THEN 5 ELSE 0 END + CASE WHEN {_ANY('b', words)} THEN 1 ELSE 0 END)" for n, (key, words) in enumerate(rules)) + ") v(key, n, score) ORDER BY score DESC, n LIMIT 1)"


@query(
    f"""WITH d AS (SELECT doc_id, source || ' ' || substr(text, 1, 30) AS h, substr(text, 1, 2000) AS b, CASE WHEN contains(text, '|') THEN 'TABLE' ELSE 'PLAIN' END AS kind, doc_id % 29 = 0 AS front, doc_id % 3 = 0 AS asset, contains(text, '=') AS formula FROM documents),
    t AS (SELECT *, {_RULES(EXAMPLE.section_types, "unknown")} AS section_type, {_RULES(EXAMPLE.equipment_types, "generic")} AS equipment_type, h || chr(10) || b AS w FROM d)
    SELECT doc_id, section_type, equipment_type, CASE WHEN front THEN 'page_furniture' WHEN {_ANY("w", ("license",))} THEN 'certificate' WHEN kind = 'TABLE' THEN CASE WHEN section_type = 'communication_interface' AND {_ANY("w", ("@mail",))} THEN 'interface_table' WHEN {_ANY("w", ("the ",))} THEN 'bom_table' WHEN {_ANY("w", ("@mail",))} THEN 'interface_table' WHEN {_ANY("w", ("der ",))} THEN 'protection_table' ELSE 'parameter_table' END
      WHEN section_type = 'communication_interface' AND {_ANY("w", ("@mail",))} THEN 'narrative' WHEN formula THEN 'formula' WHEN asset AND {_ANY("w", ("tion",))} THEN 'figure' ELSE 'narrative' END AS content_form,
    CASE section_type WHEN 'quality' THEN 'narrative,figure' ELSE 'narrative' END AS support, CASE section_type WHEN 'quality' THEN 'other' WHEN 'supply_scope' THEN 'quality' ELSE '' END AS related, CASE section_type WHEN 'quality' THEN 'diagram,curve' ELSE '' END AS hints, section_type = 'quality' AS extractive FROM t"""
)
def taxonomy_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section type, equipment type and content form of each document, and what its section type goes with."""
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "source", F.substring("text", 1, 30)).alias("heading"), "text", F.when(text.contains("|"), F.lit("TABLE")).otherwise(F.lit("PLAIN")).alias("kind"), (F.col("doc_id") % 29 == 0).alias("front"), (F.col("doc_id") % 3 == 0).alias("needs_asset"), text.contains("=").alias("formula"))
    found = classified(EXAMPLE, rows)
    goal, rule = target(EXAMPLE, F.col("section_type"), F.array(F.lit("figure")), F.lit(False)), policy(EXAMPLE, F.col("section_type"))
    joined = lambda c: F.array_join(c, ",")
    return found.select("doc_id", "section_type", "equipment_type", "content_form", joined(goal["support"]).alias("support"), joined(goal["related"]).alias("related"), joined(rule["hints"]).alias("hints"), rule["extractive"].alias("extractive"))


@query(
    f"""WITH t AS (SELECT unnest({TERMS!r}) AS term), m AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS rank FROM documents JOIN t ON contains(lower(text), term)) SELECT term, doc_id, rank::INT AS rank FROM m WHERE rank <= 3"""
)
def term_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents that hold each term; terms are a short list and meet each text in one expression."""
    held = F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.lower("text").contains(t))
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(held).alias("term"))
    return found.select("term", "doc_id", F.row_number().over(Window.partitionBy("term").orderBy("doc_id")).alias("rank")).filter("rank <= 3")


def excerpts(docs: DataFrame, max_chars: int, keywords: tuple[str, ...]) -> DataFrame:
    """(doc_id, excerpt): the best paragraphs that fit, in their order, with a mark where some are left out; the first always stays.

    10 points for each keyword and a half for more than 80 characters; of equal ones the earlier first. A fold over the
    paragraphs in order of points adds up what is left of the budget; null texts give an empty excerpt.
    """
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p, i: F.struct((-(10 * sum((F.lower(p).contains(k).cast("int") for k in keywords), F.lit(0)) + F.when(F.length(p) > 80, F.lit(0.5)).otherwise(F.lit(0.0)))).alias("points"), i.alias("i"), F.length(p).alias("size"), p.alias("p")))
    rows = docs.select("doc_id", parts.alias("parts"))
    first = F.get("parts", F.lit(0))
    start = F.struct((F.lit(max_chars) - first["size"]).alias("left"), F.array(first["i"]).alias("chosen"))
    step = lambda s, x: F.struct(F.when(x["size"] <= s["left"], s["left"] - x["size"]).otherwise(s["left"]).alias("left"), F.when(x["size"] <= s["left"], F.concat(s["chosen"], F.array(x["i"]))).otherwise(s["chosen"]).alias("chosen"))
    ordered = F.array_sort(F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1))))
    chosen = rows.select("doc_id", "parts", F.array_sort(F.aggregate(ordered, start, step, lambda s: s["chosen"])).alias("at"))
    gap = lambda i, j: F.when(j > i + 1, F.lit("...\n")).otherwise(F.lit(""))
    lines = F.transform("at", lambda x, n: F.concat(gap(F.when(n == 0, F.lit(-1)).otherwise(F.get("at", F.greatest(n - 1, F.lit(0)))), x), F.get("parts", x)["p"]))
    end = F.when(F.element_at("at", -1) < F.size("parts") - 1, F.lit("\n...")).otherwise(F.lit(""))
    return chosen.select("doc_id", F.concat(F.array_join(lines, "\n"), end).alias("excerpt"))


_KEYS = ("that", "dans", "der", "que")


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), p AS (SELECT doc_id, i, x[i] AS p, length(x[i]) AS size, {" + ".join(f"10 * contains(lower(x[i]), '{k}')::INT" for k in _KEYS)} + CASE WHEN length(x[i]) > 80 THEN 0.5 ELSE 0 END AS points FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM d)),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i > 1, points DESC, i) AS k FROM p), s AS (SELECT doc_id, k, 1200 - size AS room, [i] AS chosen FROM o WHERE k = 1
      UNION ALL SELECT o.doc_id, o.k, CASE WHEN size <= room THEN room - size ELSE room END, CASE WHEN size <= room THEN list_append(chosen, i) ELSE chosen END FROM s JOIN o ON o.doc_id = s.doc_id AND o.k = s.k + 1),
    f AS (SELECT doc_id, list_sort(arg_max(chosen, k)) AS spots FROM s GROUP BY 1) SELECT doc_id, array_to_string(list_transform(spots, lambda v, n: CASE WHEN v > coalesce(spots[n - 1], 0) + 1 THEN '...' || chr(10) ELSE '' END || x[v]), chr(10)) || CASE WHEN spots[-1] < len(x) THEN chr(10) || '...' ELSE '' END AS excerpt FROM f JOIN d USING (doc_id)"""
)
def requirement_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of at most some 1200 characters."""
    return excerpts(table(spark, sf_dir, "documents"), 1200, _KEYS)
