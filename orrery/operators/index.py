"""Corpus statistics kept by version: counted once, then brought up to date from what changed.

A kept table has rows (collection_id, term, df, words, mean_raw). The row of no term counts the
chunks and words of a collection, and has the mean of the raw inverse frequencies of all its
terms, so a search reads only the rows of its own words and one more. It is found by the
version of what it was made from: that of a table of :mod:`orrery.sources.tables`, or a
digest of the files of a folder. A version that isn't kept yet follows from an older one by the
statistics of the rows that came, less those of the rows that went.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.retrieval import corpus_statistics, exact_mean, raw_frequency
from orrery.sources import tables
from orrery.sources.shared import shared_path, shared_root, stored


def version_of(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files at a path."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    every, out = fs.listFiles(place, True), []
    while every.hasNext():
        s = every.next()
        out.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(out)).encode()).hexdigest()[:24]


def with_means(counted: DataFrame) -> DataFrame:
    """Kept statistics from (collection_id, term, df, words), a stored table."""
    whole = counted.where("term IS NULL").select("collection_id", F.col("df").alias("n"))
    raw = counted.where("term IS NOT NULL").join(F.broadcast(whole), "collection_id").groupBy("collection_id").agg(exact_mean(raw_frequency()).alias("mean_raw"))
    sums = counted.where("term IS NULL").join(raw, "collection_id", "left")
    columns = ["collection_id", "term", "df", "words", "mean_raw"]
    return counted.where("term IS NOT NULL").withColumn("mean_raw", F.lit(None).cast("double")).select(*columns).unionByName(sums.select(*columns))


def _put(spark: SparkSession, made: DataFrame, path: str) -> None:
    """``made`` at ``path``, whole or not at all."""
    staged = f"{path}.staged-{hashlib.sha256(shared_path(spark, 's').encode()).hexdigest()[:12]}"
    made.write.parquet(staged)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place(path)) or not fs.rename(place(staged), place(path)):
        fs.delete(place(staged), True)  # another came first


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def kept_statistics(spark: SparkSession, version: str, corpus: Callable[[], DataFrame]) -> DataFrame:
    """Statistics of the corpus of a version, for the life of the session: counted the first time, read after that."""
    path = f"{shared_root(spark)}/statistics-{version}"
    if not _exists(spark, path):
        _put(spark, with_means(stored(corpus_statistics(corpus()), "counted")), path)
    return spark.read.parquet(path)


def table_statistics(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """Statistics of a table (collection_id, chunk_id, text) in one of its versions, kept beside it.

    They follow from the newest kept version before it, if what changed since can be told.
    """
    now = tables.state(spark, root, version)["version"]
    path = f"{root}/statistics/{name}-{now:012d}"
    if not _exists(spark, path):
        older = [v for v in tables.numbers(spark, root) if v < now and _exists(spark, f"{root}/statistics/{name}-{v:012d}")]
        moved = tables.changes(spark, root, name, older[-1], now) if older else None
        if moved:
            old = spark.read.parquet(f"{root}/statistics/{name}-{older[-1]:012d}").drop("mean_raw")
            came, went = (corpus_statistics(rows) for rows in moved)
            signed = old.unionByName(came).unionByName(went.withColumns({c: -F.col(c) for c in ("df", "words")}))
            counted = signed.groupBy("collection_id", "term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")).where("df > 0")
        else:
            counted = corpus_statistics(tables.read(spark, root, name, now))
        _put(spark, with_means(stored(counted, "counted")), path)
    return spark.read.parquet(path)
