import pytest
from pyspark.sql import functions as F

from corpusweft.operators import reuse as R
from corpusweft.operators import taxonomy

NAMES = {"base": "double", "result_type": "string", "heading": "string", "content": "string", "section_class": "string", "front": "boolean", "needs_asset": "boolean", "asset_required": "boolean", "form": "string", "section_type": "string", "equipment_type": "string", "specificity": "string", "parameter_sensitive": "boolean", "target_section": "string", "target_equipment": "string"}
NAMES |= dict.fromkeys((*R._LISTS, *R._CARDS), "array<string>")
REGISTRY = taxonomy.Registry(synonyms=(("vfd", "变频器"),))


def score(spark, **given):
    df = spark.createDataFrame([tuple(given.get(n) for n in NAMES)], ", ".join(f"{n} {t}" for n, t in NAMES.items())).withColumn("k", F.lit(1))
    return R.scored(df, ["k"], REGISTRY, commercial={"manual_only_terms": ("培训",)}).first()


def test_empty_pairs_and_bounds(spark):
    assert tuple(score(spark))[1:] == (0.0, 0.0, [])
    assert score(spark, base=9.0).score == 1.2 and score(spark, base=-1.0).score == 0.0


def test_words_match_through_synonyms(spark):
    row = score(spark, base=0.5, heading="变频器 选型", content="电压等级", query_terms=["vfd", "电流"])
    assert row.reasons == ["keyword_overlap=1", "heading_match"] and row.score == pytest.approx(0.5 + 0.11 + 0.12)
    assert score(spark, base=0.5, query_terms=["zzz"]).reasons == ["keyword_mismatch_penalty"]


def test_texts_that_are_not_commercial_are_capped_before_the_cards_count(spark):
    cards = {"product_texts": ["变频器选型"], "product_terms": [], "module_texts": [], "module_terms": ["电压等级"], "product_sections": ["quality"], "product_equipment": ["motor"]}
    given = dict(base=0.9, heading="变频器 选型", content="电压等级", target_section="commercial_manual_only", section_type="quality", related_types=["quality"], equipment_type="motor", **cards)
    row = score(spark, **given)
    assert row.score == pytest.approx(0.18 + 0.13) and row.prior == 0.13 and "commercial_manual_cross_type_score_cap" in row.reasons
    assert score(spark, **(given | {"content": "培训 电压等级"})).score > 0.9
    assert score(spark, **(given | {"related_types": [], "content": "培训 电压等级"})).prior == 0  # fits neither section nor equipment
    assert score(spark, **(given | dict.fromkeys(cards))).prior == 0


@pytest.mark.parametrize("want, target", [(True, ("unknown", "generic")), (True, ("a", "generic")), (True, ("b", "x")), (False, ("c", "generic")), (True, ("c", "m")), (False, ("overall_solution", "x"))])
def test_what_fits_a_section(spark, want, target):
    df = spark.createDataFrame([(*target, "a", "m", ["a"] if target[0] == "b" else [])], "s string, e string, x string, y string, r array<string>")
    c = F.col
    assert df.select(R.is_relevant(c("s"), c("e"), c("x"), c("y"), c("r")).alias("ok")).first().ok is want


def test_preferred_documents_come_first_and_ties_keep_their_order(spark):
    items = spark.createDataFrame([(1, n, names, 0.5 - n / 10, ["x"]) for n, names in ((1, ["A"]), (2, ["b.DOCX "]), (3, None), (4, ["c", "B .docx"]))] + [(2, 9, ["b.docx"], 0.1, [])], "section int, place int, names array<string>, score double, reasons array<string>")
    wanted = spark.createDataFrame([(1, "B.docx"), (1, " "), (1, None)], "section int, document string")
    out = R.preferred_documents(items.withColumn("id", F.col("place")), wanted, ["section"]).orderBy("section", "place").collect()
    assert [(r.section, r.id, r.score) for r in out] == [(1, 2, 0.54), (1, 1, 0.4), (1, 4, 0.34), (1, 3, pytest.approx(0.2)), (2, 9, 0.1)]
    assert out[0].reasons == ["x", "knowledge_wiki_source_document_prior"]
