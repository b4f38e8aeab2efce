"""Progress topics: the latest event of each key, as a stream and as a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_SECONDS = 3600


def latest_states(events: DataFrame, key: str = "key", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest event of each key. On a stream (update mode) it keeps one row of state a key."""
    columns = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(ts, tie)).alias("e")).select(key, "e.*")


def unexpired(states: DataFrame, now: Column, ts: str = "ts", ttl: int = TTL_SECONDS) -> DataFrame:
    return states.where(F.unix_timestamp(now) - F.unix_timestamp(ts) < ttl)


def replay(states: DataFrame, live: DataFrame) -> DataFrame:
    """A subscriber's view: the snapshot, then what came after it."""
    seen = states.select("key", F.col("ts").alias("_seen"))
    later = live.join(seen, "key", "left").where(F.col("_seen").isNull() | (F.col("ts") > F.col("_seen"))).drop("_seen")
    return states.unionByName(later.select(*states.columns))
