"""Topics whose latest events expire: state of one row a key, with a timer.

The newest event of a key, by time and then by id, is kept and sent on; older ones that
come late change nothing. When the watermark passes the time to live of what is kept, the
key is forgotten and an expiry is sent. A key has one timer at most: a renewed event leaves it as
it is, and when it comes due it is put off to the time of what is kept then. Folding what was sent gives the snapshot at any time;
a subscriber replays the snapshot and then follows the stream, see :func:`orrery.streaming.progress.replay`.
State and timers are in the checkpoint, so a restarted stream goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from orrery.streaming.progress import TTL_SECONDS

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
SENT = "key string, ts timestamp, event_id long, payload string, kind string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Latest(StatefulProcessor):
    """Keeps (ts in microseconds, event_id, payload) of a key."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("latest", "us long, event_id long, payload string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max(((r["us"], r["event_id"], r["payload"]) for r in rows), key=lambda e: e[:2])
        old = self.kept.get()
        if old is not None and best[:2] <= (old[0], old[1]):
            return
        self.kept.update(best)
        if old is None:
            self.handle.registerTimer(best[0] // 1000 + self.ttl_ms)
        yield self._row(key, best, "set")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.kept.get()
        if old is None:
            return
        end = old[0] // 1000 + self.ttl_ms
        if end <= timerValues.getCurrentWatermarkInMs():
            self.kept.clear()
            yield self._row(key, old, "expired")
        else:
            self.handle.registerTimer(end)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, event: tuple, kind: str) -> Row:
        return Row(key=key[0], ts=EPOCH + timedelta(microseconds=event[0]), event_id=event[1], payload=event[2], kind=kind)


def latest_with_expiry(events: DataFrame, ttl_seconds: int = TTL_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """What is sent for a stream of (key string, ts, event_id, payload): ``set`` and ``expired`` events.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    timed = events.withWatermark("ts", delay).select("key", "ts", "event_id", "payload", F.unix_micros("ts").alias("us"))
    return timed.groupBy("key").transformWithState(statefulProcessor=Latest(ttl_seconds), outputStructType=SENT, outputMode="Append", timeMode="EventTime")


def snapshot(sent: DataFrame) -> DataFrame:
    """The live events: of each key the last that was sent, unless that is its expiry."""
    rank = F.struct("ts", "event_id", (F.col("kind") == "expired").cast("int").alias("e"))
    last = sent.groupBy("key").agg(F.max_by(F.struct("ts", "event_id", "payload", "kind"), rank).alias("x")).select("key", "x.*")
    return last.where("kind = 'set'").drop("kind")


def run_to_end(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Writes what a stream sends until its input is read, and gives all that was sent so far."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.read.parquet(path)
