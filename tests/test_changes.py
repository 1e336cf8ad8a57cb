import datetime as dt

from pyspark.sql import functions as F

from gleaner.operators.merge import classify
from gleaner.streaming.changes import replayed

LISTING = "source string, ext_id string, content_hash long, listed_at timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day - 1, hours=hour)


def feed(spark, path, batches):
    """Each batch as a file of its own, read in turn."""
    for rows in batches:
        spark.createDataFrame(rows, LISTING).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def test_late_repeated_and_expired_rows(spark, tmp_path):
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    first = [
        [("g", "a", 1, at(1)), ("g", "b", 1, at(1)), ("g", "b", 1, at(1)), (None, "z", 5, at(1))],
        [("g", "a", 2, at(2)), ("g", "a", 9, at(1, 5)), ("g", "b", 1, at(2))],  # the older of two listings of a batch says nothing
        [("g", "a", 2, at(2)), ("g", "c", 7, at(3))],  # a repeated listing
        [("h", "x", 1, at(6))],  # time goes on: a and b are missing
        [("h", "x", 1, at(7)), ("g", "a", 2, at(6, 12)), ("g", "b", 3, at(1, 2))],  # a comes back, b's listing is too late
    ]
    feed(spark, path, first[:3])
    replayed(spark, stream(spark, path), out)
    for rows in first[3:]:  # a restart from the checkpoint for each further batch
        feed(spark, path, [rows])
        replayed(spark, stream(spark, path), out)
    feed(spark, path, [[("h", "x", 1, at(60))], [("g", "b", 1, at(60, 1)), ("g", "a", 2, at(60, 2))]])
    got = replayed(spark, stream(spark, path), out)
    rows = sorted((r.source or "", r.ext_id, r["at"], r.change, r.content_hash) for r in got.collect())
    assert [r for r in rows if r[1] == "a"] == [("g", "a", at(1), "new", 1), ("g", "a", at(2), "changed", 2), ("g", "a", at(5), "missing", 2), ("g", "a", at(6, 12), "reopened", 2), ("g", "a", at(9, 12), "missing", 2), ("g", "a", at(60, 2), "new", 2)]
    assert [r[2:] for r in rows if r[1] == "b"] == [(at(1), "new", 1), (at(2), "unchanged", 1), (at(5), "missing", 1), (at(60, 1), "new", 1)]  # forgotten after 30 days
    assert [r[3] for r in rows if r[1] == "c"] == ["new", "missing"] and [r[3] for r in rows if r[1] == "z"] == ["new", "missing"]
    assert [r[2:4] for r in rows if r[1] == "x"] == [(at(6), "new"), (at(7), "unchanged"), (at(10), "missing"), (at(60), "new")]


def test_stream_equals_the_batch_classification(spark, tmp_path):
    """Two whole listings out of the order table, as a stream and by the batch operator."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    key = F.col("o_orderkey")
    rows = orders.select(F.concat(F.lit("board"), (key % 3).cast("string")).alias("source"), key.cast("string").alias("ext_id"), (key % 97).alias("content_hash"))
    stored = rows.where(key % 5 > 0)
    listed = rows.where(key % 7 > 0).withColumn("content_hash", F.col("content_hash") + (F.col("content_hash") % 4 == 0).cast("long"))
    path = str(tmp_path / "feed")
    for i, frame in enumerate((stored, listed)):
        frame.withColumn("listed_at", F.lit(at(1 + i))).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("end", "end", 1, at(20)), ("end", "end", 1, at(21))], LISTING).coalesce(1).write.mode("append").parquet(path)
    got = replayed(spark, stream(spark, path), str(tmp_path / "out"), close_after="12 hours", delay="0 seconds")
    second = got.where((F.col("at") == at(2)) | ((F.col("at") == at(1, 12)) & (F.col("change") == "missing"))).where("source <> 'end'")
    # the posting that a listing lacks closes half a day after the first one; so does every other before it is listed again
    closed = {(r.source, r.ext_id) for r in second.where("change = 'missing'").collect()}
    stream_says = {(r.source, r.ext_id): r.change for r in second.where("change <> 'missing'").collect()}
    batch = {(r.source, r.ext_id): r.change for r in classify(stored.withColumn("closed_at", F.lit(None).cast("timestamp")), listed, ["source", "ext_id"]).collect()}
    assert closed == {(r.source, r.ext_id) for r in stored.collect()}
    assert {k: "unchanged" if v == "reopened" else v for k, v in stream_says.items()} == {k: v for k, v in batch.items() if v != "missing"}
    assert {k for k in closed if k not in stream_says} == {k for k, v in batch.items() if v == "missing"}
