"""Board snapshots as a stream: each micro-batch of listings makes the next version of the posting table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.merge import save_listing
from gleaner.streaming.buckets import BucketTable


class PostingTable:
    """A posting table in versioned Parquet folders: one writer, and readers see only whole versions.

    Version n is what batch n left. A batch that is run again after a failure starts from the version before it and
    writes the same rows, so every listing counts once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self, version: int) -> DataFrame:
        """The rows after batch ``version``; none for a negative one."""
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={version}")

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/version={version}")


def posting_stream(listings: DataFrame, table: PostingTable | BucketTable, checkpoint: str) -> StreamingQuery:
    """Run listings (source, ext_id, title, content_hash, listed_at, complete) into ``table`` until the input is used up.

    In a batch the newest listing of a posting counts. A source's postings that its complete listing lacks are
    closed; a source without a complete listing in the batch closes nothing. Of a table in buckets, a batch rewrites those
    of its postings, and all of a source that it lists completely; other tables are written anew.
    """
    content = [c for c in listings.columns if c not in ("source", "ext_id", "listed_at", "complete")]

    def merge(batch: DataFrame, version: int) -> None:
        batch = batch.persist()
        try:
            latest = batch.groupBy("source", "ext_id").agg(F.max(F.struct("listed_at", *content)).alias("n")).select("source", "ext_id", *[f"n.{c}" for c in content])
            now = batch.agg(F.max("listed_at")).scalar()
            whole = batch.groupBy("source").agg(F.bool_and("complete").alias("complete")).where("complete").select(F.col("source").alias("_source"))

            def change(stored: DataFrame, staged: DataFrame) -> DataFrame:
                known = stored.join(whole, F.col("source") == F.col("_source"), "left").withColumn("_whole", F.col("_source").isNotNull()).drop("_source")
                return save_listing(known, staged, now, complete=F.col("old._whole")).drop("_whole")

            if isinstance(table, BucketTable):
                table.merge(latest, change, version, parts=None if whole.isEmpty() else 1)
            else:
                stored = table.read(version - 1)
                table.write(change(stored, latest).select(*stored.columns), version)
        finally:
            batch.unpersist()

    return listings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_usage(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream's events a day and kind, in event time; what comes later than ``delay`` is left out."""
    watched = events.withWatermark("ts", delay)
    return watched.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "cents")


def sliding_count(events: DataFrame, length: str = "24 hours", step: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events of each user in every window of ``length`` that ends on a ``step``."""
    watched = events.withWatermark("ts", delay)
    return watched.groupBy("user_id", F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.end").alias("until"), "n")


def settled(counts: DataFrame) -> DataFrame:
    """What a streaming aggregation gives once its input is used up, kept in the shared checkpoint folder.

    The groups are written after each batch, whole; those of the last batch are the result.
    """
    spark = counts.sparkSession
    folder = shared_folder(spark) + f"/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    live = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    live.start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/out")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset and everything runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="gleaner-stream-")
