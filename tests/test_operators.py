import json

from pyspark.sql import functions as F

from corpusweft.functions import scores, text
from corpusweft.operators import evidence, joins, masking, ranking
from corpusweft.plans import retrieval
from corpusweft.sources import json_library
from corpusweft.streaming import replay


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scores(spark):
    assert one(spark, scores.rule_score(F.array(F.lit("high"), F.lit("medium"), F.lit("low")))) == 0.55
    assert one(spark, scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0
    assert one(spark, scores.blend(dense=F.lit(1.0), sparse=F.lit(1.0))) == 1
    assert one(spark, scores.safe_ratio(F.lit(1.0), F.lit(0.0))) is None


def test_text(spark):
    assert one(spark, text.slug(F.lit("  A b/C! "))) == "a-b-c"
    assert one(spark, text.slices(F.lit("abcdefg"), 3)) == ["abc", "def", "g"]
    assert one(spark, text.slices(F.lit(""), 3)) == []
    assert one(spark, text.estimated_tokens(F.lit("abcde"))) == 2
    assert one(spark, text.starts_path(F.array(F.lit("A")), F.array(F.lit("AB"), F.lit("x")))) is False


def test_masking_round_trip(spark):
    texts = ["write to a.b@mail.example.com or c@d.org", "again a.b@mail.example.com from 10.0.0.1, $1,200", None, "none", ""]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, texts[1])], "session_id long, seq long, text string")
    got = {(r.session_id, r.seq): r for r in masking.masked(rows).collect()}
    assert got[1, 0].masked == "write to [Email_1] or [Email_2]"
    assert got[1, 1].masked == "again [Email_1] from [Network_1], $1,200"
    assert got[2, 0].masked.startswith("again [Email_1]") and got[1, 2].masked is None
    assert all(masking.restore(r.masked, r.mapping) == (texts[s] if i == 1 else texts[1]) for (i, s), r in got.items())


def test_masking_of_names_numbers_and_companies(spark):
    text = "甲方上海电气集团，联系人张三，合同金额500万元，身份证号310101199001011234，联系电话13800138000，项目编号：AB-12 and 上海电气集团, 项目由国家电网公司负责。"
    found = {(e, text[a:b]) for a, b, e in masking.spans(text)}
    assert found >= {("COMPANY", "上海电气集团"), ("COMPANY", "国家电网公司"), ("PERSON", "张三"), ("AMOUNT", "500万元"), ("ID_CARD", "310101199001011234"), ("PHONE", "13800138000"), ("PROJECT_CODE", "AB-12")}
    for t, name in {"本合同由上海电气集团签订。": "上海电气集团", "请联系上海电气集团项目组。": "上海电气集团", "项目由国家电网公司负责。": "国家电网公司"}.items():
        assert [t[a:b] for a, b, e in masking.spans(t) if e == "COMPANY"] == [name]
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate([text, "再付500万元和600万元, 上海电气集团", None])], "session_id string, seq int, text string")
    got = {r.seq: r for r in masking.masked(rows).collect()}
    assert "[Company_A]" in got[0].masked and "[Company_B]" in got[0].masked and got[1].masked == "再付[Amount_1]和[Amount_2], [Company_A]" and got[2].masked is None
    back = masking.masked(rows).select("seq", masking.restored(F.col("masked"), F.col("mapping")).alias("t")).collect()
    assert {r.seq: r.t for r in back} == {r.seq: r.text for r in rows.collect()}
    assert [one(spark, masking.letters(F.lit(n))) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"] and replay.token("COMPANY", 703) == "AAA" and replay.token("PHONE", 3) == "3"


def test_dense_search_edges(spark):
    points = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [2.0, 0.0])], "id string, vector array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("n", None)], "query_id string, vector array<float>")
    rows = sorted(ranking.dense_top_k(points, asked, 9).collect(), key=lambda r: r.rank)
    assert [(r.query_id, r.id) for r in rows] == [("q", "a"), ("q", "b"), ("q", "e"), ("q", "d")] and rows[-1].score == 0


def test_dense_search_in_blocks_gives_the_same(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, vector array<float>")
    wanted = points.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "vector")
    key = lambda rows: sorted((r.query_id, r.rank, r.id) for r in rows)
    whole = key(ranking.dense_top_k(points, wanted, 3).collect())
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 2)
    assert key(ranking.dense_top_k(points, wanted, 3).collect()) == whole
    assert ranking.dense_top_k(points, wanted.limit(0), 3).count() == 0


def test_hybrid_plan(spark):
    docs = spark.createDataFrame([(1, "red apple pie", [1.0, 0.0]), (2, "green pear", [0.0, 1.0]), (3, "apple", [0.5, 0.5])], "id long, text string, vector array<float>")
    asked = spark.createDataFrame([(9, "apple pie", [1.0, 0.0])], "query_id long, text string, vector array<float>")
    rows = sorted(retrieval.hybrid(docs, asked, 2).collect(), key=lambda r: r.rank)
    assert [r.id for r in rows] == [1, 3] and rows[0].final_score == 1


def test_diff_counts_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None, 1), (2, "x", 1), (3, "y", 2)], "k int, s string, n int")
    b = spark.createDataFrame([(1, None, 1), (2, None, 1), (4, "y", 2)], "k int, s string, n int")
    assert sorted(map(tuple, joins.diff(a, b, "k", ["s", "n"]).collect())) == [(2, "changed", "s"), (3, "removed", ""), (4, "added", "")]


def test_repeated_paragraphs_match_a_plain_version(spark):
    from difflib import SequenceMatcher

    from corpusweft.operators import drafts

    base = "the controller starts the motor after the cooling system reports that it is ready to run at full load "
    parts = [base, base.replace("motor", "blower"), "short one", base * 2, "quite another paragraph about the delivery of documents and the training of staff on site", base.upper() + "!"]
    text = "\n\n".join(parts)
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "draft_id long, text string")
    flat = [" ".join(p.lower().split()) for p in parts]
    want = [(1, i + 1, j + 1) for i in range(len(flat)) for j in range(i + 1, len(flat)) if min(len(flat[i]), len(flat[j])) >= 40 and SequenceMatcher(None, flat[i], flat[j]).ratio() >= 0.78]
    assert [tuple(r)[:3] for r in drafts.repeated_paragraphs(rows, 99).collect()] == want
    assert len(drafts.repeated_paragraphs(rows).collect()) == 2


def test_chunks_sections_and_anchors(spark):
    from corpusweft.operators import chunking

    docs = spark.createDataFrame([(1, "# 1 Scope\n\nfirst\n\n# 2 Control\n\nsecond\n\n| a |\n| b |\n\nthird\n\n# 1 Scope\n\nagain"), (2, None), (3, "")], "doc_id long, text string")
    chunks = chunking.chunked(docs)
    rows = sorted(chunks.collect(), key=lambda r: r.chunk_index)
    assert [(r.chunk_type, r.heading_path) for r in rows] == [("PLAIN", "1 Scope"), ("PLAIN", "2 Control"), ("TABLE", "2 Control"), ("PLAIN", "2 Control"), ("PLAIN", "1 Scope")]
    sections = spark.createDataFrame([(1, 0, "1", "1 Scope", "1 Scope"), (1, 1, "2", "2 Control", "2 Control"), (1, 2, "3", "3 Scope", "3 Scope")], "doc_id long, place int, section_id string, title string, path string")
    found = {r.chunk_index: r.section_id for r in chunking.matched_sections(chunks, sections).collect()}
    assert found == {0: "1", 1: "2", 2: None, 3: None, 4: "3"}
    anchors = {r.chunk_index: (r.section_id, r.match) for r in chunking.section_anchors(chunks, sections).collect()}
    assert anchors[0] == ("1", "exact") and anchors[2] == ("2", "exact")
    trees = spark.createDataFrame([(1, [("A", [("B", [("C", None)]), ("D", None)]), ("E", None)])], "id long, sections array<struct<title:string,children:array<struct<title:string,children:array<struct<title:string,children:array<struct<title:string>>>>>>>>")
    flat = chunking.flattened(trees, "id").orderBy("order").collect()
    assert [(r.title, r.level) for r in flat] == [("A", 1), ("B", 2), ("C", 3), ("D", 2), ("E", 1)]


def test_vector_and_layer_writes(spark, tmp_path):
    from corpusweft.operators import knowledge, materials

    vectors = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "a", [1.0]), (3, "b", [1.0])], "id long, channel string, vector array<float>")
    materials.write_channels(vectors, str(tmp_path / "v"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "v")).collect()) == [1, 3]
    items = spark.createDataFrame([(1, "auto_approved", True), (2, "rejected", False), (3, "review_required", False)], "id long, status string, ok boolean")
    knowledge.write_layers(items, F.col("ok"), str(tmp_path / "w"))
    assert sorted((r.layer, r.id) for r in spark.read.parquet(str(tmp_path / "w")).collect()) == [("draft", 1), ("draft", 2), ("draft", 3), ("published", 1), ("rejected", 2)]


def test_snapshots_of_a_folder(spark, tmp_path):
    for i, n in enumerate((5, 6)):
        (tmp_path / f"s{i}.json").write_text(json.dumps({"project": {"id": f"p{i}"}, "summary": {"health": "healthy", "total_sections": n}}))
    assert json_library.snapshots(spark, str(tmp_path)).count() == 2


def test_json_library(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"entries": [{"sample_id": "s", "heading_count": 2, "top_level_titles": ["t"]}, {"file_name": "f"}]}))
    rows = json_library.entries(spark, str(tmp_path / "a.json"), json_library.OUTLINE).collect()
    assert len(rows) == 2 and rows[0].source == "" and rows[0].top_level_titles == ["t"]
    assert json_library.entries(spark, str(tmp_path / "none.json"), json_library.OUTLINE).count() == 0


def run_stream(spark, frame, name, tmp_path):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_restorer_waits_for_a_split_placeholder(spark, tmp_path):
    schema = "session_id long, seq long, text string"
    spark.createDataFrame([(1, 0, "mail [Ema"), (1, 1, "il_1] and [x"), (1, 2, None)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    mappings = spark.createDataFrame([(1, {"[Email_1]": "a@b.cd"})], "session_id long, mapping map<string,string>")
    rows = run_stream(spark, replay.restored_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), mappings), "restored", tmp_path)
    assert "".join(r.text for r in sorted(rows, key=lambda r: r.seq)) == "mail a@b.cd and [x"


def test_sessions_keep_their_numbers(spark, tmp_path):
    schema = "session_id long, entity string, value string"
    spark.createDataFrame([(1, "EMAIL", "a@b.cd"), (1, "EMAIL", "a@b.cd"), (1, "EMAIL", "e@f.gh"), (2, "EMAIL", "e@f.gh")], schema).coalesce(1).write.json(str(tmp_path / "in"))
    rows = run_stream(spark, replay.allocated_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), 30), "allocated", tmp_path)
    assert sorted({tuple(r) for r in rows}) == [(1, "EMAIL", "a@b.cd", "[Email_1]"), (1, "EMAIL", "e@f.gh", "[Email_2]"), (2, "EMAIL", "e@f.gh", "[Email_1]")]


def test_preceding_context_holds_all_prior_turns_whole(spark):
    from corpusweft.streaming.replay import preceding_context

    texts = [f"turn {i} " + "long text " * 10 for i in range(6)] + ["", None, "end"]
    rows = [(1, i, t, f"t{i}" if i != 2 else None) for i, t in enumerate(texts)] + [(2, 0, "other", "t")]
    got = {(r.conv_id, r.turn): (r.context, r.topics) for r in preceding_context(spark.createDataFrame(rows, "conv_id long, turn long, text string, topic string"), 3, " etc.").collect()}
    assert got[1, 8] == ("\n".join(texts[:6]), "t0、t1、t3 etc.")
    assert got[1, 3] == ("\n".join(texts[:3]), "t0、t1")
    assert got[1, 0] == got[2, 0] == ("", "")


def test_digits_are_those_of_the_double(spark):
    values = [k / 1e6 for k in (*range(500, 1_000_000, 1000), 1, 999_999, 1_000_000)] + [0.4375, 0.0625, 2.5, 1e-9, -0.1235, 123456.7895, 1e17]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.fixed(F.col("v"), 3).alias("three"), text.fixed(F.col("v"), 4).alias("four")).collect()
    assert [(r.three, r.four) for r in rows] == [(f"{r.v:.3f}", f"{r.v:.4f}") for r in rows]


ATTEMPT = "request_id long, industry string, names array<string>"


def test_first_answers_and_their_counts(spark):
    requests = spark.createDataFrame([(1, "steel", ["a", "a", "b"]), (2, "wood", ["a"]), (3, "", ["zz"]), (4, "glass", []), (5, None, ["c", None])], ATTEMPT)
    hits = spark.createDataFrame([(1, "steel", "a"), (2, "steel", "b"), (3, "other", "a"), (4, None, "c"), (5, "glass", None)], "hit long, hit_industry string, hit_name string")
    attempts = evidence.search_attempts(requests)
    counts = {r.request_id: (r.strategy, r.n_hits, r.first_hit) for r in evidence.answer_counts(attempts, hits).collect()}
    assert counts == {1: ("case_first", 2, 1), 2: ("case_first_relaxed_industry", 2, 1), 3: ("case_first_fallback_global", 5, 1), 4: ("global_fallback", 1, 5), 5: ("case_first", 1, 4)}
    found = {}
    for r in evidence.first_answers(attempts, hits).collect():
        found.setdefault(r.request_id, []).append(r.hit)
    assert {k: sorted(v) for k, v in found.items()} == {1: [1, 2], 2: [1, 3], 3: [1, 2, 3, 4, 5], 4: [5], 5: [4]}
    plan = evidence.answer_counts(attempts, hits)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and " OR " not in plan  # no request meets the hits one by one


def test_versions_at_one_place_do_not_hang_on_the_order_of_rows(spark):
    from corpusweft.operators import records

    rows = [(1, "a", 5, 3), (1, "a", 5, 1), (1, "a", 5, None), (1, "a", 2, 0)]
    of = lambda some: sorted((r.place, r.next_version) for r in records.draft_versions(spark.createDataFrame(some, "project_id long, section_id string, place long, version int").coalesce(1)).collect())
    assert of(rows) == of(rows[::-1]) == [(2, 1), (5, 1), (5, 2), (5, 4)]
