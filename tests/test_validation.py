import pytest
from pyspark.sql import functions as F

from corpusweft.operators import drafts as D
from corpusweft.operators import similar, validation as V

CARD = "project_id string, blockers array<struct<field:string,status:string>>, params map<string,string>"
SECTION = "project_id string, section_id string, title string, mandatory boolean, evidence_types array<string>, needs_review boolean, parameter_sensitive boolean, specificity string, asset_required boolean"
DRAFT = "project_id string, section_id string, title string, text string, citations array<struct<evidence_id:string,source_doc_id:string,source_title:string>>, assumptions array<string>, params map<string,string>, assets array<struct<asset_id:string,asset_type:string,role:string,risk:string>>, figure_confirmed boolean, banned array<string>, hints map<string,string>, must_replace array<string>, block_ids array<string>, gate struct<status:string,score:double>, retrieval struct<mode:string,path:string,blocks:array<map<string,double>>,sections:array<map<string,double>>>"
BUNDLE = "project_id string, evidence_ids array<string>, quality double, fallback_count int, fallback_top double"


def inputs(spark, cards, sections, drafts, bundles, reuse=None):
    return V.Inputs(*(spark.createDataFrame(rows, schema) for rows, schema in ((cards, CARD), (sections, SECTION), (drafts, DRAFT), (bundles, BUNDLE))), reuse)


def draft(section, title, text, citations=(), assets=(), banned=(), **more):
    return ("p", section, title, text, list(citations), more.get("assumptions", []), more.get("params", {}), list(assets), more.get("confirmed", False), list(banned), more.get("hints", {}), more.get("must", []), more.get("blocks", []), more.get("gate"), more.get("retrieval"))


def codes(found):
    return {r.code for r in found.collect()}


def test_one_project_with_many_faults(spark):
    text = "当前方案待确认系统拓扑，使用 [Company_A] 占位，并引用旧项目A 的拓扑描述，补充了足够多的技术说明文字用于测试。\n\n[[ASSET:FIGURE:asset-001]]"
    sections = [("p", "1", "技术架构", True, ["section"], True, False, "medium", True), ("p", "2", "实施计划", True, [], False, False, "medium", False)]
    drafts = [draft("1", "技术架构", text, [("ev_001", "doc_1", "历史方案A")], [("asset-001", "figure", None, "high")], ["旧项目A"], params={"total_power": "5200kW"})]
    found = V.findings(inputs(spark, [("p", [], {"total_power": "5000kW"})], sections, drafts, [("p", ["ev_001"], 0.5, 0, 0.0)]))
    rows = {r.code: r for r in found.collect()}
    assert {k for k, r in rows.items() if r.kind == "error"} == {"VAL002", "VAL003", "VAL006", "VAL007", "VAL008"}
    assert {k for k, r in rows.items() if r.kind == "warning"} == {"VAL101", "VAL102", "VAL103"}
    assert rows["VAL003"].details == ["total_power", "5000kW", "5200kW"] and rows["VAL006"].details == ["asset-001"] and rows["VAL007"].details == ["[Company_A]"]
    none = found.select(F.lit(None).cast("string").alias("signature")).limit(0)
    tasks = D.review_tasks(found.withColumns({"param": F.get("details", F.lit(0)), "draft_version": F.lit(3)}), none).collect()
    assert {t.signature for t in tasks} == {"figure_confirm:3:1:VAL006", "param_conflict:3:-:VAL003:total_power", "content_review:3:1:VAL101", "content_review:3:1:VAL102", "content_review:3:-:VAL103"}
    cards = spark.createDataFrame([("p",), ("q",)], "project_id string")
    assert {r.project_id: r.status for r in V.status_of(found, cards, cards.filter("project_id = 'p'")).collect()} == {"p": "blocked", "q": "passed"}


def test_reuse_and_replacements(spark):
    block = "硬件配置清单如下：本方案配置高压变频器 2台，电压等级 6kV，采用站控层、间隔层和网络层的分层架构，配套原有控制柜和辅助系统，适用于历史项目的标准交付边界。"
    sections = [("p", "4", "硬件配置清单", True, ["section"], False, True, "medium", False)]
    drafts = [draft("4", "硬件配置清单", block, [("ev", "d", "t")], hints={"voltage_level": "10kV", "quantity": "3台"}, must=["voltage_level", "quantity"])]
    reuse = similar.reuse_similarity(spark.createDataFrame([("4", block)], "section_id string, text string"), spark.createDataFrame([("4", 0, "b", "B", block)], "section_id string, place int, block_id string, source_title string, text string")).withColumn("project_id", F.lit("p"))
    given = inputs(spark, [("p", None, {"voltage_level": "10kV"})], sections, drafts, [("p", ["ev"], 0.88, 0, 0.0)], reuse)
    assert codes(V.findings(given)) == {"VAL009", "VAL105"}
    some = [draft("4", "硬件配置清单", block + " 10 KV", [("ev", "d", "t")], hints={"voltage_level": "10kV", "quantity": "3台"}, must=["voltage_level", "quantity"])]
    found = V.findings(inputs(spark, [], sections, some, [("p", ["ev"], 0.88, 0, 0.0)]))
    assert {(r.code, tuple(r.details)) for r in found.collect()} == {("VAL106", ("quantity",))}


def test_only_wanted_codes_and_an_empty_project(spark):
    given = inputs(spark, [], [], [], [])
    assert V.findings(given).collect() == []
    nulls = inputs(spark, [(None, None, None)], [("p", "1", None, None, None, None, None, None, None)], [("p", "1", None, None, *[None] * 11)], [("p", None, None, None, None)])
    assert codes(V.findings(nulls)) == {"VAL101", "VAL103"}
    assert codes(V.findings(nulls, ("VAL103",))) == {"VAL103"}


@pytest.mark.parametrize("text, want", [("待确认 x", True), ("# 待确认事项\n待确认 x", False), ("# 待确认事项\n# 其他\n待确认 x", True), ("| 待确认 |", False), ("| TBD |", True), ("注：待确认", False), ("按最终待确认", False), ("", False), ("# TBD\nTBD", True), ("plain", False)])
def test_implicit_assumptions(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(V.implicit_assumption(F.col("t")).alias("x")).first().x is want


def test_quantities_and_placeholders(spark):
    row = spark.createDataFrame([("3 台, 2.5套 and 3台; 7 kg", "[A_b] {{x y}} [Ab] {{}} [A_b] [1_a] [B_c_2]")], "q string, p string").select(V.quantity_pairs(F.col("q")).alias("q"), V.placeholders(F.col("p")).alias("p")).first()
    assert row.q == ["2.5套", "3台"] and row.p == ["[A_b]", "[B_c_2]", "{{x y}}"]


def test_retrieval_traces(spark):
    kind = "struct<mode:string,path:string,blocks:array<map<string,double>>,sections:array<map<string,double>>>"
    rows = [(("full_section", None, None, None), ["missing_structured_trace"]), (("x", "p", None, None), []), (("x", "extractive_reuse_a", [{"final": 0.5, "semantic": 0.4}], None), ["low_final_score", "low_semantic_and_rerank"]), (("x", "", [{"hybrid": 0.6, "dense": 0.4, "rerank": 0.5}], None), []), (None, [])]
    df = spark.createDataFrame([(a, b) for a, b in rows], f"r {kind}, want array<string>")
    assert all(r.got == r.want for r in df.select("want", V.trace_weakness(F.col("r")).alias("got")).collect())
