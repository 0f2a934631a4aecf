import pytest
from pyspark.sql import functions as F

from corpusweft.streaming import index_sink as I

SCHEMA = "doc_id long, version long, text string, deleted boolean"


def lines(docs):
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))


def state(spark, folder):
    out = {}
    for r in I.current(spark, folder).collect():
        out.setdefault((r.doc_id, r.version), []).append((r.place, r.line))
    return {k: [x for _, x in sorted(v)] for k, v in out.items()}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "index")
    first = spark.createDataFrame([(1, 1, "a\nb", False), (2, 1, "c", None), (None, 1, "x", False), (3, None, None, False), (2, 0, "old", False)], SCHEMA)
    second = spark.createDataFrame([(1, 2, "d", False), (2, 2, None, True), (4, 1, "e", False)], SCHEMA)
    I.write_batch(first, 0, folder, lines)
    assert state(spark, folder) == {(1, 1): ["a", "b"], (2, 1): ["c"]}
    I.write_batch(second, 1, folder, lines)
    after = {(1, 2): ["d"], (4, 1): ["e"]}
    assert state(spark, folder) == after
    for number, batch in ((1, second), (0, first), (1, second)):
        I.write_batch(batch, number, folder, lines)
        assert state(spark, folder) == after
    I.write_batch(spark.createDataFrame([(1, 1, "late", False), (4, 1, "again", False)], SCHEMA), 2, folder, lines)
    assert state(spark, folder) == {(1, 2): ["d"], (4, 1): ["again"]}
    I.compacted(spark, folder, str(tmp_path / "new"))
    assert state(spark, str(tmp_path / "new")) == state(spark, folder)


def test_a_batch_that_dies_in_between_is_not_seen_and_heals(spark, tmp_path):
    folder = str(tmp_path / "index")
    I.write_batch(spark.createDataFrame([(1, 1, "a", False)], SCHEMA), 0, folder, lines)
    batch = spark.createDataFrame([(1, 2, "b\nc", False), (2, 1, "d", False)], SCHEMA)

    class Dies(Exception):
        pass

    real = I.newest

    def dying(rows):
        docs = real(rows)
        chunks = lines(docs.filter("not deleted"))
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch=1")  # the chunks are there, then the executor is lost
        raise Dies

    I.newest = dying
    try:
        with pytest.raises(Dies):
            I.write_batch(batch, 1, folder, lines)
    finally:
        I.newest = real
    assert state(spark, folder) == {(1, 1): ["a"]}
    I.write_batch(batch, 1, folder, lines)
    assert state(spark, folder) == {(1, 2): ["b", "c"], (2, 1): ["d"]}


def test_stream_restarts_where_it_was(spark, tmp_path):
    folder, source = str(tmp_path / "index"), str(tmp_path / "in")
    text = "# Scope\n\nThe controller starts the motor after the cooling system reports that it is ready to run at full load."
    for k in range(2):
        spark.createDataFrame([(k, 1, text.replace("motor", f"motor {k}"), False)], SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        I.index_stream(stream, folder).trigger(availableNow=True).start().awaitTermination()
    found = I.current(spark, folder).collect()
    assert {r.doc_id for r in found} == {0, 1} and all("cooling" in r.content for r in found)
