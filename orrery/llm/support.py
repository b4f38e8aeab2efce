"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the six ASCII blanks that separate words, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ensure_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most: a worker holds one and what it makes of it, and texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut.

    The folder is the one that ``spark.checkpoint.dir`` names; only where it is
    unset, as in tests on one machine, a temporary folder is used.
    """
    _ensure_folder(df.sparkSession)
    return df.checkpoint()


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null or blank: empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANK_RUN))).cast("long")


def unit_hash(*cols: Column | str) -> Column:
    """A double in [0, 1) from the upper 53 bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(2**53))


def values(column: pa.Array, run: int = 256) -> Iterator:
    """Python values of an Arrow column, made a run at a time, so that a batch of texts isn't held twice."""
    for at in range(0, len(column), run):
        yield from column.slice(at, run).to_pylist()


def sampled(rows: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """Of n rows about ``most``, drawn by 53 bits of a hash of the id, so that any share can be drawn."""
    return rows.where(unit_hash("doc_id", F.lit(seed)) < F.lit(most / n)) if n > most else rows


#: A set of ids is broadcast up to so many (8 bytes each), and shuffled beyond.
BROADCAST_IDS = 1_000_000


def by_ids(rows: DataFrame, ids: DataFrame, how: str, on: str | list[str] = "doc_id") -> DataFrame:
    """``rows`` joined with ``ids`` (already materialised): broadcast if their counted number allows it."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


#: Edges up to which what is known of their nodes (16 bytes each, two nodes at most for an edge) is broadcast, and the partitions that each step then has.
BROADCAST_EDGES, SMALL_PARTS = 500_000, 16


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component has its smallest node's id.

    Alternates large-star and small-star steps until nothing changes, which takes
    about log2 of the longest chain. Minima are aggregated with a partial step, so a
    hub's neighbours are never gathered. Counted edges of up to BROADCAST_EDGES have
    minima that can be broadcast; beyond, minima are written before they are joined,
    and so not fused with the join, which Spark can then split at a hub. Steps are
    written as tables: a checkpoint carries the constraints of its plan along, which
    multiply from step to step.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(2**40 - 1))).first()
        if now == before or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = now
        few = now[0] <= BROADCAST_EDGES
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        least = F.broadcast(least.coalesce(SMALL_PARTS)) if few else written(least, "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.coalesce(SMALL_PARTS) if few else written(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        least = least.coalesce(SMALL_PARTS) if few else written(least, "least")
        small = large.join(F.broadcast(least) if few else least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = small.unionByName(least.withColumnRenamed("m", "b")).distinct()
        e = written(step.coalesce(SMALL_PARTS) if few else step, "edges")


def joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of ``found`` after further edges (a, b): only components that an edge connects are worked on."""
    ends = edges.join(found.toDF("a", "ca"), "a", "left").join(found.toDF("b", "cb"), "b", "left")
    new = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    moved = found.join(new.toDF("component", "c"), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    return cut(moved.unionByName(new).distinct())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    _ensure_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like :func:`cut`, for large tables, as it is compressed."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
