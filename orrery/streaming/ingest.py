"""Ingestion: files as they arrive become chunks and corpus rows, once each."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from orrery.functions.text import prompt_text, stale
from orrery.operators.catalog import text_of
from orrery.operators.tags import parse_suggestions, rank_suggestions
from orrery.sources import files as source
from orrery.sources import tables

STALE_SECONDS = 1800 + 60
RETRIES, BACKOFF_SECONDS = 3, 1.0
#: Files that a Python worker is sent at a time, instead of the many that Spark puts into one Arrow batch.
FILES_AT_A_TIME = 16


def runnable(jobs: DataFrame, now: Column, limit: int = STALE_SECONDS) -> DataFrame:
    """Jobs to take up: not done, and not being worked on unless that began too long ago."""
    busy = (F.col("status") == "processing") & ~stale(F.col("processing_started_at"), now, limit)
    return jobs.where((F.col("status") != "done") & ~busy)


def phases(job: Column) -> Column:
    """The progress events of one document, in order."""
    return F.transform(F.array(*[F.lit(p) for p in ("parsing", "embedding", "storing", "done")]), lambda p: F.struct(job.alias("document_id"), p.alias("phase")))


def suggested_tags(chunks: DataFrame, suggest: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """(document_id, tags): names that a model suggests for the beginning of each document's text with at least this confidence.

    ``suggest`` turns (id, prompt) into (id, reply).
    """
    texts = text_of(chunks, "document_id").select(F.col("document_id").alias("id"), prompt_text(F.col("text")).alias("prompt"))
    parsed = parse_suggestions(suggest(texts).select("id", "reply"))
    ranked = rank_suggestions(parsed, parsed.select("id", "name").limit(0), least)
    return ranked.groupBy("id").agg(F.collect_list("name").alias("tags")).withColumnRenamed("id", "document_id")


@contextmanager
def _few_at_a_time(spark: SparkSession, rows: int = FILES_AT_A_TIME) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is planned meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, rows if int(old) <= 0 else min(rows, int(old)))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def ingest(
    spark: SparkSession,
    new: DataFrame,
    root: str,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    *,
    parsers: Mapping[str, source.Parser] | None = None,
    effective: DataFrame | None = None,
    suggest: Callable[[DataFrame], DataFrame] | None = None,
    least_confidence: float = 0.7,
    batch: str | None = None,
) -> int:
    """Parses files and commits their chunks in place of earlier ones, as one version of the tables in ``root``.

    Tables (:mod:`orrery.sources.tables`): ``chunks``, ``documents`` (with the number of chunks),
    ``rejected`` (with the reason) and ``progress`` (the phases that each document went through). A
    document that gives no chunks any more loses its earlier ones. Files are parsed once, FILES_AT_A_TIME
    of them sent to Python together, into a folder that is deleted after the commit; what is written is in proportion to the files of the
    batch. A batch is committed once, however often it is tried.

    ``effective`` (document_id, tags) are inherited tags that are folded into the chunks;
    ``suggest`` adds tags by a model, see :func:`suggested_tags`.
    """
    if batch is not None and batch in (known := tables.state(spark, root)["batches"]):
        return known[batch]
    staged = f"{root}/staged-{uuid.uuid4().hex}"
    try:
        with _few_at_a_time(spark):
            source.parsed(source.with_document_id(new), parsers=parsers).write.parquet(staged)
        rows = spark.read.parquet(staged)
        chunks = source.chunks_of(rows)
        tags = [t for t in (effective, suggested_tags(chunks, suggest, least_confidence) if suggest else None) if t is not None]
        if tags:
            each = reduce(DataFrame.unionByName, [t.select("document_id", F.explode("tags").alias("name")) for t in tags])
            folded = each.groupBy("document_id").agg(F.sort_array(F.collect_set("name")).alias("tags"))
            chunks = chunks.join(folded, "document_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        ids = rows.select("document_id")
        documents = rows.select("document_id", "path", "filename", "parser", F.when(F.col("reason").isNull(), F.size(F.flatten("pieces"))).otherwise(0).alias("chunk_count"), F.when(F.col("reason").isNull(), "done").otherwise("failed").alias("job_status"))
        went = rows.where("reason IS NULL").select(F.explode(phases(F.col("document_id"))).alias("p")).select("p.*", F.lit(batch).alias("batch"))
        changes = {"chunks": embed(chunks) if embed else chunks, "documents": documents, "rejected": source.rejected_of(rows)}
        return tables.commit(spark, root, {k: tables.Change(v, ids, "document_id") for k, v in changes.items()} | {"progress": tables.Change(went)}, batch)
    finally:
        tables.drop_folder(spark, staged)


def retried(work: Callable[[], object], retries: int = RETRIES, backoff: float = BACKOFF_SECONDS) -> object:
    """The result of ``work``, tried again after a failure, up to ``retries`` times, with a pause that doubles."""
    for attempt in range(retries + 1):
        try:
            return work()
        except Exception:
            if attempt == retries:
                raise
            time.sleep(backoff * 2**attempt)


def ingest_stream(
    spark: SparkSession,
    inbox: str,
    root: str,
    checkpoint: str,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    *,
    retries: int = RETRIES,
    backoff: float = BACKOFF_SECONDS,
    **options,
) -> DataStreamWriter:
    """A stream over a folder; the checkpoint remembers which files are done. A batch that fails is tried
    again here, and after that when the stream starts again, and is committed once. Further options are those of :func:`ingest`."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(inbox)
    content = F.when(F.col("length") <= source.MAX_FILE_BYTES, F.col("content")).alias("content")
    shaped = arriving.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), content)

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            retried(lambda: ingest(spark, rows, root, embed, batch=f"{checkpoint}:{number}", **options), retries, backoff)

    return shaped.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
