"""Vectors of texts without a model to download: hashed TF-IDF, projected at random.

A word falls into one of BUCKETS by its CRC-32. How many texts have a word of a bucket is counted over
all of them, an array of fixed size for each task; a word weighs 1 + ln(times), times the
bucket's inverse frequency. A bucket's direction has random signs, from the seed
alone, so every worker makes the same ones; the sum of a text's directions is normalised. Cosines of
such vectors are those of the weighted words, up to an error that falls with the square root of the width.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
WIDTH = 256
#: Texts that are Python values at a time.
RUN = 256


def buckets_of(text: str | None) -> Counter:
    return Counter(zlib.crc32(w.encode()) % BUCKETS for w in (text or "").lower().split())


@dataclass
class TextEmbedder:
    """Inverse frequencies of the buckets, and what the directions are made from."""

    weights: np.ndarray
    width: int = WIDTH
    seed: int = 5

    def directions(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 2, (BUCKETS, self.width), np.int8) * np.int8(2) - np.int8(1)

    def embed(self, rows: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        """``rows`` with the vector of a text column; a text without words has a null one."""
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        sent = rows.sparkSession.sparkContext.broadcast(self)  # one number for each bucket

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            signs = own.directions()
            for batch in batches:
                made: list = []
                for at in range(0, batch.num_rows, RUN):
                    for value in batch.column(text).slice(at, RUN).to_pylist():
                        counts = buckets_of(value)
                        if not counts:
                            made.append(None)
                            continue
                        places = np.fromiter(counts, np.int64)
                        weight = own.weights[places] * (1 + np.log(np.fromiter(counts.values(), np.float64)))
                        vector = weight @ signs[places]
                        norm = np.sqrt(vector @ vector)
                        made.append((vector / norm).astype(np.float32) if norm else None)
                yield batch.append_column(out, pa.array(made, pa.list_(pa.float32())))

        return rows.mapInArrow(run, f"{fields}, `{out}` array<float>")


def fitted(texts: DataFrame, text: str = "text", width: int = WIDTH, seed: int = 5) -> TextEmbedder:
    """An embedder with the frequencies of all ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                for value in batch.column(0).slice(at, RUN).to_pylist():
                    have[list(buckets_of(value))] += 1
                    n += 1
        used = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used], pa.int64()), pa.array([n, *have[used]], pa.int64())], ["bucket", "n"])

    have, n = np.zeros(BUCKETS, np.int64), 0
    for r in texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        if r["bucket"] < 0:
            n = r["n"]
        else:
            have[r["bucket"]] = r["n"]
    return TextEmbedder(np.log((n + 1) / (have + 1)) + 1, width, seed)
