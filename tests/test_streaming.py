from datetime import datetime, timedelta

from tidemark.streaming.micro_batches import EVENT_STATE, STATE, Versions, alerting, daily_counts, upserting

T0 = datetime(2024, 1, 1)
ROWS = "source_id string, item_id long, batch timestamp, seq long, title string, url string"


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_upserts_of_two_batches(spark, tmp_path):
    src, root, log = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "log")
    for k in range(2):
        feed(spark, src, [("s", 1, T0 + timedelta(hours=k), k, f"title {k}", "u")], ROWS)
        stream = spark.readStream.schema(ROWS).parquet(str(src))
        q = upserting(stream, root).option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()
    row = Versions(spark, root, STATE).latest().collect()
    assert [(r["title"], r["crawl_count"], r["first_time"], r["last_time"]) for r in row] == [("title 1", 2, T0, T0 + timedelta(hours=1))]


def test_alerts_cool_down_over_batches(spark, tmp_path):
    schema = "event_key string, level string, seen_at timestamp, seq long"
    src, root, log = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "log")
    sent = []
    for k, (level, minutes) in enumerate([("alert", 0), ("alert", 100), ("urgent", 110), ("alert", 500)]):
        feed(spark, src, [("k", level, T0 + timedelta(minutes=minutes), k)], schema)
        stream = spark.readStream.schema(schema).parquet(str(src))
        q = alerting(stream, root, lambda df, n: sent.append([r["action"] for r in df.collect()])).option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sent == [["allow_new"], [], ["allow_escalation"], ["allow_new"]]
    assert Versions(spark, root, EVENT_STATE).latest().count() == 1


def test_daily_counts_close_with_the_watermark(spark, tmp_path):
    schema = "ts timestamp, source_id string, rank long"
    feed(spark, tmp_path / "in", [(T0, "s", 5), (T0, "s", 3), (T0 + timedelta(days=5), "s", 1)], schema)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = daily_counts(stream).writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "log")).start()
    q.awaitTermination()
    assert [(r["n"], r["best"]) for r in spark.sql("SELECT * FROM days").collect()] == [(2, 3)]
