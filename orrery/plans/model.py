"""The driver's tables as catalogue, chunks, corpus, tags and jobs.

A language is a workspace, a language and source a collection, a text a document
of one chunk. Labels are tags of documents and mark those that are being deleted
(quality 0); events are jobs of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import chunk_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, collection_id, workspace_id, filename, language, status; no text is read."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    gone = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct().withColumn("status", F.lit("deleting"))
    named = rows.join(gone, "doc_id", "left")
    return named.select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("document_id"),
        F.concat_ws("_", F.lit("col"), "lang", "source").alias("collection_id"),
        F.concat(F.lit("ws_"), F.col("lang")).alias("workspace_id"),
        F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("filename"),
        F.col("lang").alias("language"),
        "status",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each text: chunk_id, document_id, collection_id, filename, parser, chunk_index, language, text, doc_id."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text").withColumn("document_id", F.concat(F.lit("doc_"), F.col("doc_id")))
    return rows.select(
        chunk_id(F.col("document_id"), F.lit(0)).alias("chunk_id"),
        "document_id",
        F.concat_ws("_", F.lit("col"), "lang", "source").alias("collection_id"),
        F.concat("document_id", F.lit(".txt")).alias("filename"),
        F.lit("txt").alias("parser"),
        F.lit(0).alias("chunk_index"),
        F.col("lang").alias("language"),
        "text",
        "doc_id",
    )


def vectors(spark: SparkSession, sf_dir: str, by: str = "lang") -> DataFrame:
    """Chunks that have a vector, keyed by doc_id as chunk_id: collection_id (the ``by`` column), chunk_id, language, filename, embedding."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select(
        F.col(by).alias("collection_id"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("language"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("document_id"), F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("filename"), "source", "embedding"
    )


def corpus(spark: SparkSession, sf_dir: str, by: str = "lang") -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col(by).alias("collection_id"), F.col("doc_id").alias("chunk_id"), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (query_vector, query_text): the vector of id 7."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 7").select(F.col("embedding").alias("query_vector"), F.lit(QUERY_TEXT).alias("query_text"))


QUERY_TEXT = "the of and the"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query_vector, query_text): every row whose id is divisible by EVERY, its vector and its document's text, if it has one."""
    vectors = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    texts = table(spark, sf_dir, "documents").where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    return vectors.join(texts, "query_id", "left")


EVERY = 20

TAGS = {"high quality": "quality = 1", "toxic": "toxic = 1"}


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tag_id, workspace_id, name, color: of each workspace its language, its sources, and the labels."""
    rows = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    names = rows.select("lang", F.explode(F.array(F.concat(F.lit("lang "), "lang"), F.col("source"), *[F.lit(t) for t in TAGS])).alias("name")).distinct()
    return names.select(F.concat_ws("_", F.lit("tag"), "lang", "name").alias("tag_id"), F.concat(F.lit("ws_"), "lang").alias("workspace_id"), "name", F.lit("#6366f1").alias("color"))


def workspace_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang").distinct()
    return rows.select(F.concat(F.lit("ws_"), "lang").alias("entity_id"), F.concat(F.lit("tag_"), "lang", F.lit("_lang "), "lang").alias("tag_id"))


def collection_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return rows.select(F.concat_ws("_", F.lit("col"), "lang", "source").alias("entity_id"), F.concat_ws("_", F.lit("tag"), "lang", "source").alias("tag_id"))


def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    names = F.filter(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in TAGS.items()]), lambda x: x.isNotNull())
    return rows.select(F.concat(F.lit("doc_"), "doc_id").alias("entity_id"), "lang", F.explode(names).alias("name")).select("entity_id", F.concat_ws("_", F.lit("tag"), "lang", "name").alias("tag_id")).distinct()


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return rows.select(F.concat_ws("_", F.lit("col"), "lang", "source").alias("collection_id"), F.concat(F.lit("ws_"), "lang").alias("workspace_id"))


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("ws_"), "lang").alias("workspace_id")).distinct()


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, document_id, status, created_at: a click is pending work, a purchase done, an error failed."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return rows.select(F.col("event_id").alias("job_id"), F.concat(F.lit("doc_"), "user_id").alias("document_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))


#: The same model in SQL, as common table expressions.
SQL = {
    "documents": """docs AS (
  SELECT 'doc_' || d.doc_id AS document_id, 'col_' || lang || '_' || source AS collection_id, 'ws_' || lang AS workspace_id,
         'doc_' || d.doc_id || '.txt' AS filename, lang AS language, g.status
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, 'deleting' AS status FROM labels WHERE quality = 0) g ON d.doc_id = g.doc_id)""",
    "tags": """tags AS (
  SELECT DISTINCT 'tag_' || lang || '_' || name AS tag_id, 'ws_' || lang AS workspace_id, name, '#6366f1' AS color
  FROM (SELECT lang, unnest(['lang ' || lang, source, 'high quality', 'toxic']) AS name FROM documents))""",
    "links": """wt AS (SELECT DISTINCT 'ws_' || lang AS entity_id, 'tag_' || lang || '_lang ' || lang AS tag_id FROM documents),
ct AS (SELECT DISTINCT 'col_' || lang || '_' || source AS entity_id, 'tag_' || lang || '_' || source AS tag_id FROM documents),
dt AS (
  SELECT DISTINCT 'doc_' || d.doc_id AS entity_id, 'tag_' || lang || '_' || name AS tag_id
  FROM (SELECT doc_id, 'high quality' AS name FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1) l
  JOIN documents d ON d.doc_id = l.doc_id)""",
    "jobs": """jobs AS (SELECT event_id AS job_id, 'doc_' || user_id AS document_id, event_type AS status, ts AS created_at FROM events)""",
}
