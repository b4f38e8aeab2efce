"""Tables kept as numbered snapshots, and the JSON form of the BM25 corpus."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbered(spark: SparkSession, root: str) -> tuple[list[int], list[int]]:
    """(finished versions, all that were begun)."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = jvm_path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return [], []
    every = [s.getPath() for s in fs.listStatus(path) if re.fullmatch(r"v\d+", s.getPath().getName())]
    return sorted(int(p.getName()[1:]) for p in every if fs.exists(jvm_path(p, "_SUCCESS"))), sorted(int(p.getName()[1:]) for p in every)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The finished versions: a directory without its success marker is never read."""
    return _numbered(spark, root)[0]


def commit(df: DataFrame, root: str, partition_by: str | None = None) -> int:
    """Writes ``df`` as the next version, past all that were begun; readers see it once it is whole."""
    version = max(_numbered(df.sparkSession, root)[1], default=0) + 1
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{root}/v{version}")
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v{max(versions(spark, root))}")


def corpus_of_json(rows: DataFrame) -> DataFrame:
    """(collection_id, chunk_id, document_id, text) from (collection_id, entries), a JSON list of lists.

    Invalid JSON gives no rows, and entries of fewer than three parts are skipped.
    """
    parsed = rows.select("collection_id", F.explode(F.from_json("entries", "array<array<string>>")).alias("e")).where(F.size("e") >= 3)
    return parsed.select("collection_id", F.col("e")[0].alias("chunk_id"), F.col("e")[1].alias("document_id"), F.col("e")[2].alias("text"))


def append_corpus(corpus: DataFrame, chunks: DataFrame) -> DataFrame:
    return corpus.unionByName(chunks.select(*corpus.columns))
