"""What changes on boards, as a stream with state: each posting's last listing is kept by key, and no table is rewritten.

State is one row a posting. Timers in event time close a posting that its board has not listed for a while and forget it
later on, so state does not outgrow what is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "content_hash long, at long, open boolean"
CHANGES = "source string, ext_id string, change string, content_hash long, at long"
#: The store that keeps state by key and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Listings(StatefulProcessor):
    """Changes of one posting; times are milliseconds.

    Of a batch the newest listing counts, whatever the order of its rows, so memory does not grow with them; one that is
    not newer than what is known says nothing, whether it comes late or again.
    """

    def __init__(self, close_after: int, forget_after: int):
        self.close_after, self.forget_after = close_after, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, digest = max((r.at, r.content_hash) for frame in rows for r in frame.itertuples(index=False))
        before = self.known.get() if self.known.exists() else None
        if before is not None and at <= before[1]:
            return
        if before is not None and at > before[1] + self.close_after:  # the timer may not have come yet: rows of a batch come first
            if before[2]:
                yield self._row(key, "missing", before[0], before[1] + self.close_after)
            before = (before[0], before[1], False) if at <= before[1] + self.close_after + self.forget_after else None
        change = "new" if before is None else "changed" if digest != before[0] else "unchanged" if before[2] else "reopened"
        self._keep(int(digest), int(at), True, int(at) + self.close_after)
        yield self._row(key, change, digest, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.known.exists():
            return
        digest, at, is_open = self.known.get()
        if is_open:
            self._keep(digest, at, False, at + self.close_after + self.forget_after)
            yield self._row(key, "missing", digest, at + self.close_after)
        else:
            self.known.clear()

    def _keep(self, digest: int, at: int, is_open: bool, timer: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.known.update((digest, at, is_open))
        self.handle.registerTimer(timer)

    @staticmethod
    def _row(key, change: str, digest: int, at: int) -> pd.DataFrame:
        return pd.DataFrame({"source": [key[0]], "ext_id": [key[1]], "change": [change], "content_hash": [int(digest)], "at": [int(at)]})

    def close(self) -> None:
        pass


def listing_changes(listings: DataFrame, close_after: str = "3 days", forget_after: str = "30 days", delay: str = "1 day") -> DataFrame:
    """A stream (source, ext_id, change, content_hash, at) of what listings (source, ext_id, content_hash, listed_at) change.

    new, changed, reopened and unchanged at the time of a listing; missing ``close_after`` the last one, as soon as
    everything before that, up to ``delay``, has come. A posting that is not listed again within ``forget_after`` of its
    end is forgotten, and would then be new. Listings that come later than ``delay`` are left out; null keys are keys,
    null times are left out.
    """
    spark = listings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    millis = [int(pd.Timedelta(x).total_seconds() * 1000) for x in (close_after, forget_after)]
    rows = listings.where("listed_at IS NOT NULL").withWatermark("listed_at", delay).select("source", "ext_id", "content_hash", "listed_at", F.unix_millis("listed_at").alias("at"))
    changes = rows.groupBy("source", "ext_id").transformWithStateInPandas(Listings(*millis), CHANGES, "Append", "EventTime")
    return changes.withColumn("at", F.timestamp_millis("at"))


def replayed(spark: SparkSession, listings: DataFrame, path: str, **times: str) -> DataFrame:
    """All changes of ``listings``, a stream, until its input is used up; changes and checkpoint are kept under ``path``, from which a further run goes on."""
    changes = listing_changes(listings, **times)
    query = changes.writeStream.format("parquet").option("path", f"{path}/changes").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{path}/changes")
