"""Catalogue queries: listings with counts, trees, latest jobs, index status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active() -> Column:
    """A document that isn't being deleted."""
    return F.col("status").isNull()


def collections_with_counts(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Each collection with its active documents, 0 included."""
    counts = documents.where(active()).groupBy("collection_id").agg(F.count("*").alias("document_count"))
    return collections.join(counts, "collection_id", "left").fillna(0, ["document_count"])


def workspaces_with_counts(workspaces: DataFrame, collections: DataFrame) -> DataFrame:
    counts = collections.groupBy("workspace_id").agg(F.count("*").alias("collection_count"))
    return workspaces.join(counts, "workspace_id", "left").fillna(0, ["collection_count"])


def workspace_tree(workspaces: DataFrame, collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Each workspace with its document total and its collections as a sorted array of structs."""
    counted = collections_with_counts(collections, documents)
    nested = counted.groupBy("workspace_id").agg(
        F.sum("document_count").alias("document_count"),
        F.array_sort(F.collect_list(F.struct("collection_id", "document_count"))).alias("collections"),  # a workspace's collections, not its documents
    )
    return workspaces.join(nested, "workspace_id", "left").fillna(0, ["document_count"])


def latest_jobs(jobs: DataFrame, key: str = "document_id") -> DataFrame:
    """The newest job of each document; equal times go to the larger job id.

    One aggregate with a partial step, not a window: a document with very many jobs is no hot task.
    """
    columns = [c for c in jobs.columns if c != key]
    newest = jobs.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("created_at", "job_id")).alias("job"))
    return newest.select(key, "job.*")


def documents_with_jobs(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    newest = latest_jobs(jobs).select("document_id", F.col("status").alias("job_status"), F.col("job_id"))
    return documents.where(active()).join(newest, "document_id", "left")


def indexed_documents(corpus: DataFrame) -> DataFrame:
    return corpus.select("document_id").distinct()


def with_indexed_flag(documents: DataFrame, corpus: DataFrame) -> DataFrame:
    return documents.join(indexed_documents(corpus).withColumn("indexed", F.lit(True)), "document_id", "left").fillna(False, ["indexed"])


def index_status(documents: DataFrame, jobs: DataFrame, corpus: DataFrame) -> DataFrame:
    """(workspace_id, collection_id, total, indexed, unindexed, pending, failed) of active documents."""
    rows = with_indexed_flag(documents_with_jobs(documents, jobs), corpus)
    return rows.groupBy("workspace_id", "collection_id").agg(
        F.count("*").alias("total"),
        F.count_if("indexed").alias("indexed"),
        F.count_if(~F.col("indexed")).alias("unindexed"),
        F.count_if(F.col("job_status").isin("pending", "processing")).alias("pending"),
        F.count_if(F.col("job_status") == "failed").alias("failed"),
    )


def documents_of_chunks(chunks: DataFrame) -> DataFrame:
    """(document_id, filename, parser, chunk_count) from the chunk store."""
    return chunks.groupBy("document_id", "filename", "parser").agg(F.count("*").alias("chunk_count"))


def documents_of_chunks_by_id(chunks: DataFrame) -> DataFrame:
    """As :func:`documents_of_chunks`, one row for each document with the filename and parser of its first chunk."""
    first = F.min_by(F.struct("filename", "parser"), "chunk_index")
    return chunks.groupBy("document_id").agg(first.alias("f"), F.count("*").alias("chunk_count")).select("document_id", "f.filename", "f.parser", "chunk_count")


def text_of(chunks: DataFrame, *keys: str, order: str = "chunk_index", separator: str = "\n") -> DataFrame:
    """The texts of each key joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))  # the chunks of one document
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), separator).alias("text"), F.count("*").alias("parts"))


def acknowledgements(acks: DataFrame, expected: DataFrame) -> DataFrame:
    """(version_id, status, acked) from acks (version_id, worker, result) and expected (version_id, api, workers)."""
    got = acks.groupBy("version_id").agg(F.count_if(F.col("result") == "ok").alias("ok"), F.bool_or(F.col("result") != "ok").alias("failed"), F.count("*").alias("acked"))
    all_ = expected.join(got, "version_id", "left").fillna(0, ["ok", "acked"]).fillna(False, ["failed"])
    status = F.when((F.coalesce("api", F.lit("ok")) != "ok") | F.col("failed"), "error").when(F.col("ok") >= F.col("workers"), "applied").otherwise("pending")
    return all_.select("version_id", status.alias("status"), "acked")


def reading_order(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Numbers the rows of each key from 0."""
    return rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def listing(rows: DataFrame, *order: Column, within: str | None = None) -> DataFrame:
    """``rows`` with ``position`` from 1 in a listing's order, which ends in a unique key; ``within`` each parent, or over all.

    For lists that people look at: workspaces, the collections and tags of one. A list of any length is
    written with ``orderBy`` instead.
    """
    over = Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))
    return rows.withColumn("position", F.row_number().over(over.orderBy(*order)))
