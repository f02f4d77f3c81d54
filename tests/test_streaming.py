"""Files that come in are indexed once, and again when they change."""

from pyspark.sql import functions as F

from lodestar.operators.parse import parse_files, symbols_of
from lodestar.streaming.ingest import compact, current_symbols, file_stream, index_files, status_stream


def test_incremental_index(spark, tmp_path):
    root, target, state = tmp_path / "repo", str(tmp_path / "table"), str(tmp_path / "state")
    root.mkdir()
    (root / "a.py").write_text("def f():\n    pass\n")
    index_files(file_stream(spark, str(root), "r"), target, state, once=True).awaitTermination(60)
    (root / "b.py").write_text("class B:\n    pass\n")
    index_files(file_stream(spark, str(root), "r"), target, state, once=True).awaitTermination(60)
    again = spark.createDataFrame([("r", "a.py", "python", "def other():\n    pass\n")], "repository_id string, path string, language string, content string")
    symbols_of(parse_files(again)).drop("ordinal").write.parquet(f"{target}/batch=7")  # the file in a later batch
    for _ in range(2):
        assert {(r["file_path"], r["qualified_name"]) for r in current_symbols(spark, target).collect()} == {("a.py", "other"), ("b.py", "B")}
        compact(spark, target)
    assert spark.read.parquet(target).select("batch").distinct().count() == 1


def test_status_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    q = status_stream(events, "user_id", "event_type", "ts").writeStream.format("memory").queryName("statuses").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("statuses").agg(F.sum("events")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_texts_that_arrive_are_searched(spark, tmp_path):
    from lodestar.operators import lexical, postings, segments
    from lodestar.streaming.ingest import index_texts

    schema = "id string, text string, repository string, seq long"
    parts = [
        [("a", "alpha beta", "r", 1), ("b", "beta gamma", "r", 2), ("c", "gamma", "s", 3)],
        [("a", "old words", "r", 4), ("a", "alpha delta", "r", 5), ("d", "delta delta beta", "s", 6), (None, "no id", "r", 7)],
        [("b", None, "r", 8), ("e", "epsilon beta", "r", 9)],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    index = segments.SegmentedIndex(spark, str(tmp_path / "index"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index_texts(stream, index, str(tmp_path / "state"), "id", "text", "repository", once=True).awaitTermination()
    left = spark.createDataFrame([("a", "alpha delta"), ("c", "gamma"), ("d", "delta delta beta"), ("e", "epsilon beta")], "id string, text string")
    asked = spark.createDataFrame([("q", w) for w in ("beta", "delta", "gamma", "old")], "query_id string, term string")
    want = lexical.search(lexical.build_index(left, "id", F.col("text")), asked)
    shown = lambda df: sorted((r["id"], round(r["score"], 6), r["rank"]) for r in df.collect())
    assert shown(postings.search(index.view(), asked).rows) == shown(want)
    assert {r["id"] for r in index.documents().collect()} == {"a", "c", "d", "e"}
