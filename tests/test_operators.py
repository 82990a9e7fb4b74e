from pyspark.sql import functions as F

from hearthlog.operators import diagnostics, merge, search
from hearthlog.streaming import ingest


def test_first_and_last_win(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "id string, seq int, v string")
    assert {tuple(r) for r in merge.first_wins(df, ["id"], ["seq"]).collect()} == {("a", 1, "y"), ("b", 1, None)}
    assert {tuple(r) for r in merge.last_wins(df, ["id"], ["seq"]).collect()} == {("a", 2, "x"), ("b", 1, None)}
    assert merge.first_wins(df.limit(0), ["id"], ["seq"]).count() == 0


def test_ten_thousand_inserts_of_half_as_many_ids(spark):
    df = spark.range(10_000).select((F.col("id") % 5000).alias("id"), F.col("id").alias("seq"))
    assert merge.first_wins(df, ["id"], ["seq"]).agg(F.count("*"), F.max("seq")).first()[:] == (5000, 4999)


def test_match_parts(spark):
    e = spark.createDataFrame([(1, "x"), (2, "y")], "expected_id int, fingerprint string")
    f = spark.createDataFrame([(10, "x"), (11, "x"), (12, "z")], "found_id int, fingerprint string")
    got = {(r["expected_id"], r["found_id"], r["outcome"]) for r in merge.match_parts(e, f).collect()}
    assert got == {(1, 10, "matched"), (None, 11, "duplicate"), (None, 12, "unexpected"), (2, None, "missing")}


def test_search(spark):
    docs = spark.createDataFrame(
        [("post", "1", "lake trip", "we went", None, "2024"), ("post", "2", "other", "a trip to the lake, trip", None, "2023"), ("post", "3", None, "nothing here", "café 東京", None)],
        "entity_type string, entity_id string, title string, body string, context string, created_at string",
    )
    ids = lambda df: [r["entity_id"] for r in df.collect()]
    assert ids(search.top_hits(docs, "lake")) == ["1", "2"]  # the title outweighs the body
    assert ids(search.ranked(docs, "trip-to")) == ["2"] and ids(search.ranked(docs, "lake nothing")) == []
    assert ids(search.ranked(docs, "東京")) == ["3"] and ids(search.ranked(docs, "  ")) == [] and ids(search.ranked(docs, "!!!")) == []
    assert "[[H]]lake[[/H]]" in search.top_hits(docs, "lake").filter("entity_id = '2'").first()["snippet"]
    assert ids(search.like_hits(docs, "LAKE").orderBy("entity_id")) == ["1", "2"] and ids(search.like_hits(docs, " ")) == []


def test_states(spark):
    s = spark.createDataFrame([("a", "pending", 0), ("b", "complete", 0)], "part_id string, status string, seq int")
    u = spark.createDataFrame([("a", "importing", 1), ("b", "failed", 1), ("a", "complete", 2)], "part_id string, status string, seq int")
    now = ingest.transition(s, u)
    assert {r["part_id"]: r["status"] for r in now.collect()} == {"a": "complete", "b": "complete"}
    assert ingest.session_state(now, 5).first()["complete"] and not ingest.session_state(now, 0).first()["complete"]


def test_stream_replays_to_the_same_rows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(i, "x") for i in range(20)], "id int, v string").repartition(4).write.parquet(src)
    stream = lambda: spark.readStream.schema("id int, v string").option("maxFilesPerTrigger", 1).parquet(src)
    ingest.run_available(stream(), out, str(tmp_path / "c1"))
    spark.createDataFrame([(i, "y") for i in range(15, 25)], "id int, v string").write.mode("append").parquet(src)
    ingest.run_available(stream(), out, str(tmp_path / "c1"))  # takes the new file only
    rows = {r["id"]: r["v"] for r in ingest.committed(spark, out, ["id"]).collect()}
    assert len(rows) == 25 and rows[16] == "x" and rows[24] == "y"


def test_report_is_private(spark):
    parts = spark.createDataFrame([("Jane Doe export.zip",)], "filename string")
    warnings = spark.createDataFrame([("Unsafe media reference", "secret/jane.JSON"), ("whatever", "x")], "message string, path string")
    text = diagnostics.report(parts, warnings).first()["report"]
    assert "ane" not in text and "<file>.zip" in text and "<session>" in text and "unsafe-path" in text
