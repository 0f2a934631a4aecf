from corpusweft.plans import compiling as P

KINDS = [P.Kind("equipment", "equipment_type", {"headings": ("heading", 2), "files": ("file_name", 9)}), P.Kind("modules", "modules", {"headings": ("heading", 3)})]
SCHEMA = "document_id long, file_name string, equipment_type string, modules array<string>, heading string"


def entries(spark, changes=0, gone=()):
    rows = [(d, f"File {d}", f"e{d % 4}", [f"m{d % 3}", f"m{k}", " "], f"h{(d * k) % 5}") for d in range(12) if d not in gone for k in range(3)]
    rows = [(d, f, "moved" if d < changes else e, m if d >= changes else [*m, "extra"], h) for d, f, e, m, h in rows]
    return spark.createDataFrame([*rows, (90, "empty", None, None, None)], SCHEMA).repartition(3)


def rows(df):
    return sorted((r.category, r.card_key, r.entry_count, sorted((k, tuple(v)) for k, v in r.facts.items())) for r in df.collect())


def test_steps_equal_a_full_rebuild(spark, tmp_path):
    folder = str(tmp_path / "wiki")
    seen = []
    for given in (entries(spark, gone=(3, 5)), entries(spark), entries(spark, changes=2), entries(spark, changes=2), entries(spark, changes=1, gone=(7,)), entries(spark, gone=range(12))):
        seen.append(P.step(given, folder, KINDS))
        assert rows(P.compiled(spark, folder)) == rows(P.built(given, KINDS))
    assert seen[3] == {"documents": 0, "cards": 0} and P.generation(spark, folder) == 4
    assert seen[1]["documents"] == 2 and seen[1]["cards"] < len(rows(P.built(entries(spark), KINDS)))


def test_a_step_that_died_leaves_the_generation_before(spark, tmp_path):
    folder = str(tmp_path / "wiki")
    P.step(entries(spark), folder, KINDS)
    before = rows(P.compiled(spark, folder))
    P.built(entries(spark, changes=3), KINDS).write.parquet(f"{folder}/cards/generation=1")  # written, but never marked as done
    assert rows(P.compiled(spark, folder)) == before
    P.step(entries(spark, changes=3), folder, KINDS)
    assert rows(P.compiled(spark, folder)) == rows(P.built(entries(spark, changes=3), KINDS))


def test_uploaded_files_take_the_place_of_baseline_ones(spark):
    base = spark.createDataFrame([(1, "A b.docx"), (2, "c.docx")], "document_id long, file_name string")
    up = spark.createDataFrame([(3, "a B .DOCX"), (3, "a B .DOCX"), (4, None)], "document_id long, file_name string")
    assert sorted(r.document_id for r in P.merged(base, up).collect()) == [2, 3, 3, 4]


def test_pages_and_manifest(spark):
    cards = P.built(entries(spark), KINDS)
    found = {r.path: r for r in P.pages(cards).collect()}
    assert found["equipment/e1.md"].content.startswith("# e1\nentries: 9\n- files: File 1, File 5, File 9\n- headings: ")
    assert found["equipment/index.md"].content.split("\n")[0] == "- e0 (9)" and len(found["modules/index.md"].content.split("\n")) == 3
    assert {(r.category, r.n_cards, r.n_entries) for r in P.manifest(cards).collect()} == {("equipment", 4, 36), ("modules", 3, sum(len({d % 3, k}) for d in range(12) for k in range(3)))}
