import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.operators.merge import upsert
from gleaner.streaming.buckets import BucketTable, posting_table
from gleaner.streaming.lifecycle import posting_stream

SCHEMA = "k long, v string"


def table(spark, tmp_path):
    made = BucketTable(spark, str(tmp_path / "t"), SCHEMA, (("k", 8),))
    made.rewrite(spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    return made


def merged(stored, staged):
    return upsert(stored, staged, ["k"])


def test_a_merge_rewrites_touched_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path)
    before = t.manifest(0)
    assert len(before) == 8 and t.version() == 0
    assert t.merge(spark.createDataFrame([(3, "new"), (1000, "more")], SCHEMA), merged) == 1
    after = t.manifest(1)
    touched = {str(r[0]) for r in spark.createDataFrame([(3,), (1000,)], "k long").select(t.bucket()).collect()}
    assert {b for b in after if after[b] != before.get(b)} == touched
    rows = {r.k: r.v for r in t.read().collect()}
    assert rows == {**{i: "old" for i in range(200)}, 3: "new", 1000: "more"}
    assert {r.k for r in t.read(0).collect()} == set(range(200))  # the version before is whole


def test_a_failed_merge_is_invisible(spark, tmp_path):
    t = table(spark, tmp_path)
    broken = lambda stored, staged: upsert(stored, staged, ["k"]).withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        t.merge(spark.createDataFrame([(3, "new")], SCHEMA), broken)
    assert t.version() == 0 and t.read().where("v <> 'old'").count() == 0
    strays = lambda stored, staged: spark.range(50).select(F.col("id").alias("k"), F.lit("stray").alias("v"))
    with pytest.raises(ValueError, match="no staged row touches"):
        t.merge(spark.createDataFrame([(3, "new")], SCHEMA), strays)
    assert t.version() == 0 and t.merge(spark.createDataFrame([(3, "new")], SCHEMA), merged) == 1


def test_a_repeated_batch_counts_once_and_old_versions_expire(spark, tmp_path):
    t = table(spark, tmp_path)
    counted = lambda stored, staged: upsert(stored, staged, ["k"], {"v": F.concat("old.v", F.lit("+"))})
    one = spark.createDataFrame([(3, "x")], SCHEMA)
    assert t.merge(one, counted, version=7) == 7 and t.merge(one, counted, version=7) == 7
    assert t.read().where("k = 3").first().v == "old+"
    keep, gone = t.manifest(7), t.expire(keep=1)
    assert gone == 1 and t.manifest(7) == keep and t.read().count() == 200 and t.version() == 7
    with pytest.raises(Exception, match="0.json"):
        t.manifest(0)


def test_an_emptied_bucket_and_an_empty_table(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "e"), SCHEMA, (("k", 4),))
    assert t.read().count() == 0 and t.version() == -1
    t.merge(spark.createDataFrame([(1, "a")], SCHEMA), merged)
    t.merge(spark.createDataFrame([(1, "a")], SCHEMA), lambda stored, staged: stored.limit(0))
    assert t.read().count() == 0 and t.manifest(1) == {}


def test_the_posting_stream_touches_the_buckets_of_its_sources(spark, tmp_path):
    stored = "source string, ext_id string, title string, content_hash long, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp"
    listing = "source string, ext_id string, title string, content_hash long, listed_at timestamp, complete boolean"
    day = lambda n: dt.datetime(2024, 1, n)
    feed, t = str(tmp_path / "feed"), posting_table(spark, str(tmp_path / "postings"), stored)
    batches = [[("g", str(i), "T", 1, day(1), True) for i in range(40)] + [("h", "c", "C", 1, day(1), True)], [("g", str(i), "T", 1 + i % 2, day(2), True) for i in range(30)], [("h", "d", "D", 1, day(3), False)]]
    manifests = []
    for rows in batches:
        spark.createDataFrame(rows, listing).coalesce(1).write.mode("append").parquet(feed)
        posting_stream(spark.readStream.schema(listing).parquet(feed), t, str(tmp_path / "checkpoint")).awaitTermination()
        manifests.append(t.manifest(t.version()))
    assert t.version() == 2
    rows = {(r.source, r.ext_id): r for r in t.read().collect()}
    assert len(rows) == 42 and sum(r.closed_at == day(2) for r in rows.values()) == 10 and rows["h", "c"].closed_at is None
    assert rows["g", "1"].content_hash == 2 and rows["g", "0"].last_seen_at == day(2) and rows["g", "0"].first_seen_at == day(1)
    own = {str(r[0]) for r in spark.createDataFrame([("h", "d")], "source string, ext_id string").select(t.bucket()).collect()}
    assert {b for b in manifests[2] if manifests[2][b] != manifests[1].get(b)} == own  # a partial listing touches its postings' buckets only
