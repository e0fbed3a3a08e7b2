from pyspark.sql import functions as F

from spanwise.streaming import journal


def test_stream_counts_equal_the_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/proxy_sources_manifest.parquet").select("event_id", "ts", "type")
    events.orderBy("ts").repartition(3).write.parquet(str(tmp_path / "in"))
    late = events.agg(F.max("ts")).first()[0]
    far = spark.createDataFrame([(10**9, late.replace(year=late.year + 1), "end")], "event_id long, ts timestamp, type string")
    far.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, type string").parquet(str(tmp_path / "in"))
    journal.into_table(journal.counted(stream, "ts", "type", late="400 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["start"], r["type"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["type"], r["n"]) for r in journal.counted(events, "ts", "type").collect()}
    assert got <= want


def test_new_lines_against_items(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([("a", text)], "item string, text string")
    spark.createDataFrame([(1, text.upper()), (2, "other"), (3, None)], "line long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line long, text string").parquet(str(tmp_path / "in"))
    journal.into_table(journal.new_lines(stream, items), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 8 and out.select("line").distinct().first()[0] == 1


def test_latest_per_key(spark, tmp_path):
    spark.sql("select 'k' id, timestamp'2024-01-01' ts, 1 v union all select 'k', timestamp'2024-01-02', 2").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ts timestamp, v int").parquet(str(tmp_path / "in"))
    journal.latest_per_key(stream, "id", "ts", str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    assert [r["v"] for r in spark.read.parquet(str(tmp_path / "t/v0")).collect()] == [2]
