"""Configuration versions: what their workers acknowledged, and which version is in force.

A version is applied once all its workers said ok, failed once the publisher or a worker said
anything else, and timed out if neither came within the limit; until then it is pending.
The version in force is the newest applied one: a version that fails or times out is rolled
back to the one before it, and a pending one doesn't hold yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIMEOUT_SECONDS = 30


def folded_acks(acks: DataFrame) -> DataFrame:
    """(config, version, ok, failed, reason, last_ack) from acks (config, version, worker, result, ts).

    On a stream it is an aggregation in update mode with one row of state a version. A worker counts
    once: its acknowledgements are in a set of names, as many as a version has workers.
    """
    good = F.col("result") == "ok"
    return acks.groupBy("config", "version").agg(
        F.size(F.collect_set(F.when(good, F.col("worker")))).cast("long").alias("ok"),
        F.count_if(~good).alias("failed"),
        F.min_by(F.when(~good, F.col("result")), F.when(~good, F.struct("ts", "worker"))).alias("reason"),
        F.max("ts").alias("last_ack"),
    )


def version_states(versions: DataFrame, folded: DataFrame, now: Column, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """(config, version, published_at, state, acked, reason) of versions (config, version, published_at, api, workers).

    ``api`` is what the publisher itself made of it, null or ok if it went well.
    """
    rows = versions.join(folded, ["config", "version"], "left")
    own = F.coalesce(F.col("api"), F.lit("ok"))
    late = F.unix_timestamp(now) - F.unix_timestamp("published_at") > timeout
    state = F.when((own != "ok") | (F.coalesce("failed", F.lit(0)) > 0), "error").when(F.coalesce("ok", F.lit(0)) >= F.col("workers"), "applied").when(late, "timed_out").otherwise("pending")
    reason = F.when(own != "ok", own).otherwise(F.col("reason"))
    return rows.select("config", "version", "published_at", state.alias("state"), F.coalesce("ok", F.lit(0)).cast("long").alias("acked"), F.when(F.col("state") == "error", reason).alias("reason"))


def in_force(states: DataFrame) -> DataFrame:
    """Each version with ``active``, the version in force once it was decided, and ``rolled_back``; null if none was applied before."""
    order = Window.partitionBy("config").orderBy("version")  # the versions of one configuration
    active = F.last(F.when(F.col("state") == "applied", F.col("version")), ignorenulls=True).over(order)
    return states.withColumn("active", active).withColumn("rolled_back", F.col("state").isin("error", "timed_out"))


def current(states: DataFrame) -> DataFrame:
    """(config, active): the version in force now, by one aggregation."""
    return states.groupBy("config").agg(F.max(F.when(F.col("state") == "applied", F.col("version"))).alias("active"))
