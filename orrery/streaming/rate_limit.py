"""Token buckets: each key may burst ``rpm`` requests and gains rpm / 60 a second."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _take(tokens: float, gap: float, rpm: float) -> tuple[bool, float]:
    tokens = min(float(rpm), tokens + gap * rpm / 60.0)
    return (True, tokens - 1.0) if tokens >= 1.0 else (False, tokens)


def limited(requests: DataFrame, rpm: float) -> DataFrame:
    """``requests`` (key long, seconds double, request_id long) with ``allowed``, in one pass.

    Keys are dealt over tasks and each task reads its rows in order with the state of
    one key at a time, so a key with very many requests needs no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tokens, last = None, float(rpm), 0.0
        for batch in batches:
            out = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("seconds").to_pylist(), strict=True):
                if k != key:
                    key, tokens, last = k, float(rpm), t
                ok, tokens = _take(tokens, t - last, rpm)
                last = t
                out.append(ok)
            yield batch.append_column("allowed", pa.array(out, pa.bool_()))

    rows = requests.select("key", "seconds", "request_id").where("key IS NOT NULL AND seconds IS NOT NULL")
    return rows.repartition("key").sortWithinPartitions("key", "seconds", "request_id").mapInArrow(run, "key long, seconds double, request_id long, allowed boolean")


def limited_stream(requests: DataFrame, rpm: float) -> DataFrame:
    """The same on a stream: the bucket of a key is its state between batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["seconds", "request_id"], kind="stable")
        tokens, last = state.get if state.exists else (float(rpm), float(rows["seconds"].iloc[0]))
        out = []
        for t in rows["seconds"]:
            ok, tokens = _take(tokens, max(0.0, t - last), rpm)
            last = max(last, t)
            out.append(ok)
        state.update((tokens, last))
        yield rows.assign(allowed=out)[["key", "seconds", "request_id", "allowed"]]

    return requests.groupBy("key").applyInPandasWithState(run, "key long, seconds double, request_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def requests_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("long").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), F.col("event_id").cast("long").alias("request_id"))
