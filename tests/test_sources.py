import json

from corpusweft.operators import evaluation as E
from corpusweft.sources import json_strings as J


def plain_fragments(value, keys):
    """The strings of a JSON value as the rule tells them."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [s for x in value for s in plain_fragments(x, keys)]
    if isinstance(value, dict):
        return [s for k, x in value.items() if k in keys or isinstance(x, (dict, list)) for s in plain_fragments(x, keys)]
    return []


NESTED = {"title": "a \"title\": \"b\"", "skip": "no", "items": [{"summary": ["x", ["y", {"title": "z\\n"}]], "n": 1}, "free", None, True, [[]], {}], "heading_path": {"other": "no", "deep": {"q": {"w": {"e": {"r": {"t": {"title": "seven"}}}}}}}, "summary": 5}


def test_fragments_of_any_depth(spark):
    texts = [("a.json", json.dumps(NESTED)), ("b.JSON", '"top"'), ("c.json", "not json {"), ("d.md", "# x\ny"), ("e.json", "[]"), ("f.json", None), ("g.txt", ""), ("h.json", '["é\\u4e00", "é\\u4e00"]')]
    out = {}
    for r in J.fragments(spark.createDataFrame(texts, "path string, text string")).collect():
        out.setdefault(r.path, []).append((r.place, r.fragment))
    assert sorted(f for _, f in out["a.json"]) == sorted(plain_fragments(NESTED, J.TEXT_KEYS))
    assert {k: [f for _, f in sorted(v)] for k, v in out.items() if k != "a.json"} == {"b.JSON": ["top"], "c.json": ["not json {"], "d.md": ["# x\ny"], "g.txt": [""], "h.json": ["é一", "é一"]}
    assert len({tuple(p) for p, _ in out["a.json"]}) == len(out["a.json"])
    assert J.fragments(spark.createDataFrame([], "path string, text string")).collect() == []


def test_evidence_scalars_keep_the_order_of_the_text(spark):
    text = '{"reason": " r ", "other": {"title": ["t", ["u", 3]], "skip": "title"}, "title": "\\"reason\\": \\"no\\"", "file_name": 2.5, "heading_path": {"x": "no"}, "source_title": null, "section_title": "r"}'
    df = spark.createDataFrame([(1, text), (2, None), (3, "bad"), (4, "[" * 400 + "]" * 400)], "id long, j string")
    out = {r.id: r.strings for r in J.evidence_scalars(df, "id", "j").collect()}
    assert out == {1: ["r", "t", "u", "3", '"reason": "no"', "2.5"], 2: [], 3: [], 4: []}


def greedy(rows, limit):
    """The rule as it is told, over (section_id, path, kind) in order."""
    taken = []
    for most in (1, 2, limit):
        for section, path, kind in rows:
            if len(taken) < limit and path not in {p for _, p, _ in taken} and sum(k == kind for _, _, k in taken) < most:
                taken.append((section, path, kind))
    return [s for s, _, _ in taken]


def test_holdout_sections_are_of_many_types(spark):
    text = "a text that is long enough"
    rows = [(n, f"p{n % 6}", f"t{n % 3}" if n % 5 else "other", 40 - n) for n in range(20)]
    df = spark.createDataFrame([(1, n, p, "T", k, "lci", 1, True, text + "x" * more) for n, p, k, more in rows] + [(2, 99, None, None, "a", None, None, None, text), (2, 98, None, "only title", "a", None, None, None, text), (2, 97, "p", "T", "unknown", None, 1, True, text), (2, 96, "p", "T", "b", None, 1, True, "short")], "document_id long, section_id long, path string, title string, section_type string, equipment_type string, level int, is_leaf boolean, text string")
    for limit in (1, 4, 8):
        out = E.holdout_sections(df, limit).orderBy("document_id", "place").collect()
        assert [r.section_id for r in out if r.document_id == 1] == greedy([(n, p, k) for n, p, k, _ in rows], limit)
        assert [r.section_id for r in out if r.document_id == 2] == [98]


def test_registry_is_read_from_its_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusweft.operators import taxonomy

    write = lambda name, value: (tmp_path / f"{name}.json").write_text(json.dumps(value), encoding="utf-8")
    write("synonyms", {"schema_version": 1, "synonym_groups": [{"canonical": "VFD", "aliases": ["变频器", " vfd "]}, {"canonical": "LCI", "aliases": None}]})
    write("section_types", {"schema_version": 1, "section_types": [{"key": "Control", "label": "x", "keywords": ["控制", "Logic"], "support_content_forms": ["figure"], "related_section_types": ["other"]}], "content_form_terms": {"Certificate": ["License"]}})
    write("retrieval_policies", {"schema_version": 1, "section_type_groups": {"extractive_section_types": ["control"]}, "mappings": {"section_asset_query_hints": {"control": ["diagram"]}}})
    r = taxonomy.read_registry(spark, str(tmp_path))
    assert r.synonyms == (("vfd", "变频器"), ("lci",)) and r.section_types == (("control", ("控制", "logic")),) and r.equipment_types == ()
    assert (r.content_forms, r.support_forms, r.related_types, r.extractive) == ({"certificate": ("license",)}, {"control": ("figure",)}, {"control": ("other",)}, ("control",))
    df = spark.createDataFrame([("control",), ("x",)], "s string")
    out = {row.s: row.p for row in df.select("s", taxonomy.policy(r, F.col("s")).alias("p")).collect()}
    assert (out["control"].hints, out["control"].extractive, out["x"].hints, out["x"].extractive) == (["diagram"], True, [], False)
    write("equipment_types", {"equipment_types": []})
    import pytest

    with pytest.raises(ValueError):
        taxonomy.read_registry(spark, str(tmp_path))


def test_channels_keep_their_dimension_and_keys_their_numbers(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusweft.operators import cases, materials

    vectors = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "a", [1.0]), (3, "b", [1.0]), (4, "b", None), (5, "a", [3.0, 4.0])], "id int, channel string, vector array<double>")
    assert {r.id for r in materials.channel_tables(vectors).collect()} == {1, 3, 5}
    ids = spark.createDataFrame([(x,) for x in ("3.10", "3.9", "3", "x", "3.9.1")], "s string")
    assert [r.s for r in ids.orderBy(materials.natural_key(F.col("s"))).collect()] == ["3", "3.9", "3.9.1", "3.10", "x"]
    near = lambda *a: spark.range(1).select(cases.neighbour_score(*map(F.lit, a)).alias("s")).first().s
    assert round(near(1, False, True, True, False, False, 0.1), 6) == round(0.38 - 0.04 + 0.05 + 0.22 + 0.1, 6)
    assert round(near(20, True, False, False, False, True, 0.0), 6) == round(0 - 0.18 - 0.04, 6) and round(near(0, False, False, False, True, False, 0.0), 6) == 0.48
