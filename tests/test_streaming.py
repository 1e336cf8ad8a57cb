import datetime as dt

from pyspark.sql import functions as F

from gleaner.streaming.lifecycle import PostingTable, daily_usage, posting_stream, sliding_count

STORED = "source string, ext_id string, title string, content_hash long, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp"
LISTING = "source string, ext_id string, title string, content_hash long, listed_at timestamp, complete boolean"
EVENTS = "/root/testdata/sf0.001/events.parquet"


def day(n):
    return dt.datetime(2024, 1, n)


def test_batches_make_versions(spark, tmp_path):
    feed, table = tmp_path / "feed", PostingTable(spark, str(tmp_path / "table"), STORED)
    batches = [
        [("g", "a", "A", 1, day(1), True), ("g", "b", "B", 1, day(1), True), ("h", "c", "C", 1, day(1), True)],
        [("g", "a", "A2", 2, day(2), True), ("h", "d", "D", 1, day(2), False)],
        [("g", "b", "B", 1, day(3), True), ("g", "b", "old", 9, day(2), True)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LISTING).coalesce(1).write.mode("append").parquet(str(feed))
        posting_stream(spark.readStream.schema(LISTING).parquet(str(feed)), table, str(tmp_path / "checkpoint")).awaitTermination()
    rows = {r.ext_id: (r.title, r.content_hash, r.first_seen_at, r.last_seen_at, r.closed_at) for r in table.read(2).collect()}
    assert rows == {
        "a": ("A2", 2, day(1), day(2), day(3)),  # the third listing lacks it
        "b": ("B", 1, day(1), day(3), None),  # closed by the second, reopened by the third
        "c": ("C", 1, day(1), day(1), None),  # the second listing of h was partial
        "d": ("D", 1, day(2), day(2), None),
    }
    posting_stream(spark.readStream.schema(LISTING).parquet(str(feed)), table, str(tmp_path / "checkpoint")).awaitTermination()
    assert {r.ext_id for r in table.read(2).collect()} == set(rows)  # nothing new: no further version


def run(spark, frame, name):
    query = frame.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def stream(spark, tmp_path, name):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / name))
    return events, spark.readStream.schema(events.schema).parquet(str(tmp_path / name))


def test_daily_usage_equals_the_batch(spark, tmp_path):
    events, live = stream(spark, tmp_path, "a")
    want = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    assert run(spark, daily_usage(live), "daily") == sorted(map(tuple, want.collect()), key=str)


def test_sliding_count_equals_the_batch(spark, tmp_path):
    events, live = stream(spark, tmp_path, "b")
    want = events.groupBy("user_id", F.window("ts", "24 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.end").alias("until"), "n")
    assert run(spark, sliding_count(live, step="6 hours"), "sliding") == sorted(map(tuple, want.collect()), key=str)
