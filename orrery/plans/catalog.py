"""Catalogue, tag, graph and mutation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import catalog as C
from orrery.operators import mutations as M
from orrery.operators import tags as T
from orrery.plans import model


def collection_doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collections_with_counts(model.collections(spark, sf_dir), model.documents(spark, sf_dir))


def workspace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.workspaces_with_counts(model.workspaces(spark, sf_dir), model.collections(spark, sf_dir))


def workspace_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = C.workspace_tree(model.workspaces(spark, sf_dir), model.collections(spark, sf_dir), model.documents(spark, sf_dir))
    return tree.select("workspace_id", "document_count", F.explode("collections").alias("c")).select("workspace_id", "document_count", "c.collection_id", F.col("c.document_count").alias("collection_documents"))


def latest_job_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest_jobs(model.jobs(spark, sf_dir)).select("document_id", "job_id", "status")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector are those that are indexed."""
    return model.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc_"), "vec_id").alias("document_id"))


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = model.jobs(spark, sf_dir).withColumn("status", F.when(F.col("status") == "click", "pending").when(F.col("status") == "error", "failed").otherwise("done"))
    return C.index_status(model.documents(spark, sf_dir), jobs, _corpus(spark, sf_dir))


def indexed_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_indexed_flag(model.documents(spark, sf_dir), _corpus(spark, sf_dir)).select("document_id", "indexed")


def documents_from_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.documents_of_chunks(model.chunks(spark, sf_dir))


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.effective_tags(model.documents(spark, sf_dir), model.tags(spark, sf_dir), model.workspace_tags(spark, sf_dir), model.collection_tags(spark, sf_dir), model.document_tags(spark, sf_dir))


def effective_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effective(spark, sf_dir).select("document_id", F.array_join("tags", "|").alias("tags"))


def docs_with_all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_all_tags(model.document_tags(spark, sf_dir), model.tags(spark, sf_dir), ["High  Quality", "toxic"])


def tag_usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.usage_counts(model.tags(spark, sf_dir), model.workspace_tags(spark, sf_dir), model.collection_tags(spark, sf_dir), model.document_tags(spark, sf_dir)).drop("color")


def tag_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tag_items("tag_en_toxic", model.collections(spark, sf_dir), model.documents(spark, sf_dir), model.collection_tags(spark, sf_dir), model.document_tags(spark, sf_dir))


def tags_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.tags_by_entity(model.document_tags(spark, sf_dir), model.tags(spark, sf_dir))
    return found.select("entity_id", F.array_join(F.col("tags.tag_id"), "|").alias("tags"))


def tag_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.graph_nodes(model.documents(spark, sf_dir), model.tags(spark, sf_dir), model.document_tags(spark, sf_dir))
    return found.withColumn("heat_pct", F.round("heat_pct", 9))


def tag_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.graph_edges(model.documents(spark, sf_dir), model.document_tags(spark, sf_dir))


def tag_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.neighbours(tag_graph_edges(spark, sf_dir))


def merge_tags_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.merge_tags(model.document_tags(spark, sf_dir), "tag_en_toxic", "tag_en_high quality")


def soft_delete_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table when the documents that are being deleted are gone."""
    documents, chunks, jobs = model.documents(spark, sf_dir), model.chunks(spark, sf_dir).select("chunk_id", "document_id", "collection_id"), model.jobs(spark, sf_dir)
    left = M.hard_delete(documents, chunks, chunks, jobs)
    out = None
    for name, rows in left.items():
        counted = rows.agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents")).select(F.lit(name).alias("name"), "n", "documents")
        out = counted if out is None else out.unionByName(counted)
    return out


def corpus_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All collections of one workspace made anew from their chunks; only active documents stay in them."""
    chunks = model.chunks(spark, sf_dir).select("collection_id", "chunk_id", "document_id")
    which = model.collections(spark, sf_dir).where("workspace_id = 'ws_en'")
    made = M.reindex(chunks, chunks, model.documents(spark, sf_dir), which)
    return made.groupBy("collection_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"))


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of indexed documents are replaced by ones with another parser."""
    chunks = model.chunks(spark, sf_dir).select("chunk_id", "document_id", "parser")
    new = chunks.join(_corpus(spark, sf_dir), "document_id", "left_semi").withColumn("parser", F.lit("markdown"))
    return M.upsert(chunks, new, "chunk_id")


def chunk_tags_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective tags written into chunks."""
    chunks = model.chunks(spark, sf_dir).select("chunk_id", "document_id").withColumn("tags", F.array().cast("array<string>"))
    return M.set_document_tags(chunks, _effective(spark, sf_dir)).select("chunk_id", F.size("tags").alias("n_tags"), F.array_join("tags", "|").alias("tags"))


def cascade_delete_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting a workspace takes its collections, documents and links along."""
    tables = {"workspaces": model.workspaces(spark, sf_dir), "collections": model.collections(spark, sf_dir), "documents": model.documents(spark, sf_dir), "links": model.document_tags(spark, sf_dir)}
    gone = tables["workspaces"].where("workspace_id = 'ws_de'")
    chain = [("workspaces", "workspace_id", "collections", "workspace_id"), ("collections", "collection_id", "documents", "collection_id"), ("documents", "document_id", "links", "entity_id")]
    left = M.delete_cascading(tables, gone, "workspace_id", chain)
    out = None
    for name, rows in left.items():
        counted = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        collection_doc_counts, workspace_counts, workspace_tree, latest_job_per_document, index_status, indexed_flag, documents_from_chunks, effective_tags, docs_with_all_tags, tag_usage_counts, tag_items,
        tags_by_entity, tag_graph_nodes, tag_graph_edges, tag_neighbors, merge_tags_result, soft_delete_cleanup, corpus_reindex, upsert_chunks, chunk_tags_synced, cascade_delete_workspace,
    )
}


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(model.SQL[n] for n in names)


_EFFECTIVE = """, eff AS (
  SELECT docs.document_id, coalesce(string_agg(name, '|' ORDER BY name), '') AS tags, count(name) AS n FROM docs LEFT JOIN (
    SELECT DISTINCT document_id, name FROM (
      SELECT document_id, tag_id FROM docs JOIN wt ON wt.entity_id = workspace_id UNION ALL
      SELECT document_id, tag_id FROM docs JOIN ct ON ct.entity_id = collection_id UNION ALL
      SELECT document_id, tag_id FROM docs JOIN dt ON dt.entity_id = document_id) a JOIN tags USING (tag_id)) x USING (document_id) GROUP BY docs.document_id)"""
_EDGES = ", edges AS (SELECT entity_id AS source, tag_id AS target FROM dt JOIN docs ON document_id = entity_id WHERE status IS NULL)"
_CHUNK = "sha256('doc_' || doc_id || ':0')"

SQL = {
    "collection_doc_counts": _with("documents") + " SELECT collection_id, workspace_id, count(*) FILTER (WHERE status IS NULL) AS document_count FROM docs GROUP BY ALL",
    "workspace_counts": _with("documents") + " SELECT workspace_id, count(DISTINCT collection_id) AS collection_count FROM docs GROUP BY workspace_id",
    "workspace_tree": _with("documents")
    + """ SELECT workspace_id, CAST(sum(n) OVER (PARTITION BY workspace_id) AS BIGINT) AS document_count, collection_id, n AS collection_documents
FROM (SELECT workspace_id, collection_id, count(*) FILTER (WHERE status IS NULL) AS n FROM docs GROUP BY ALL)""",
    "latest_job_per_document": _with("jobs") + " SELECT document_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs) WHERE rn = 1",
    "index_status": _with("documents", "jobs")
    + """, newest AS (SELECT document_id, CASE status WHEN 'click' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'done' END AS job
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs) WHERE rn = 1)
SELECT workspace_id, collection_id, count(*) AS total, count(vec_id) AS indexed, count(*) - count(vec_id) AS unindexed,
  count(*) FILTER (WHERE job = 'pending') AS pending, count(*) FILTER (WHERE job = 'failed') AS failed
FROM docs LEFT JOIN newest USING (document_id) LEFT JOIN embeddings ON document_id = 'doc_' || vec_id WHERE status IS NULL GROUP BY ALL""",
    "indexed_flag": _with("documents") + " SELECT document_id, EXISTS (SELECT 1 FROM embeddings WHERE 'doc_' || vec_id = document_id) AS indexed FROM docs",
    "documents_from_chunks": "SELECT 'doc_' || doc_id AS document_id, 'doc_' || doc_id || '.txt' AS filename, 'txt' AS parser, count(*) AS chunk_count FROM documents GROUP BY ALL",
    "effective_tags": _with("documents", "tags", "links") + _EFFECTIVE + " SELECT document_id, tags FROM eff",
    "docs_with_all_tags": _with("tags", "links") + " SELECT entity_id FROM dt JOIN tags USING (tag_id) WHERE name IN ('high quality', 'toxic') GROUP BY entity_id HAVING count(DISTINCT name) = 2",
    "tag_usage_counts": _with("tags", "links")
    + """ SELECT tag_id, workspace_id, name, (SELECT count(DISTINCT entity_id) FROM wt WHERE wt.tag_id = tags.tag_id) AS workspace_count,
  (SELECT count(DISTINCT entity_id) FROM ct WHERE ct.tag_id = tags.tag_id) AS collection_count, (SELECT count(DISTINCT entity_id) FROM dt WHERE dt.tag_id = tags.tag_id) AS document_count FROM tags""",
    "tag_items": _with("documents", "links")
    + """ SELECT DISTINCT 'collection' AS kind, entity_id AS id FROM ct WHERE tag_id = 'tag_en_toxic'
UNION ALL SELECT 'document', document_id FROM docs WHERE status IS NULL AND document_id IN (SELECT entity_id FROM dt WHERE tag_id = 'tag_en_toxic')""",
    "tags_by_entity": _with("tags", "links") + " SELECT entity_id, string_agg(tag_id, '|' ORDER BY name) AS tags FROM dt JOIN tags USING (tag_id) GROUP BY entity_id",
    "tag_graph_nodes": _with("documents", "tags", "links")
    + _EDGES
    + """, h AS (SELECT target, count(DISTINCT source) AS heat FROM edges GROUP BY target)
SELECT document_id AS id, filename AS label, 'file' AS kind, 0 AS heat, 0.0::DOUBLE AS heat_pct, (SELECT count(*) FROM edges WHERE source = document_id) AS degree FROM docs WHERE status IS NULL
UNION ALL SELECT target, name, 'tag', heat, round(heat::DOUBLE / max(heat) OVER (), 9), heat FROM h JOIN tags ON tag_id = target""",
    "tag_graph_edges": _with("documents", "links") + _EDGES + " SELECT source, target FROM edges",
    "tag_neighbors": _with("documents", "links") + _EDGES + " SELECT id, count(DISTINCT other) AS neighbours FROM (SELECT source AS id, target AS other FROM edges UNION ALL SELECT target, source FROM edges) GROUP BY id",
    "merge_tags_result": _with("links") + " SELECT DISTINCT entity_id, CASE tag_id WHEN 'tag_en_toxic' THEN 'tag_en_high quality' ELSE tag_id END AS tag_id FROM dt",
    "soft_delete_cleanup": _with("documents", "jobs")
    + """, alive AS (SELECT document_id FROM docs WHERE status IS NULL), gone AS (SELECT document_id FROM docs WHERE status IS NOT NULL)
SELECT 'documents' AS name, count(*) AS n, count(DISTINCT document_id) AS documents FROM alive UNION ALL SELECT 'chunks', count(*), count(DISTINCT document_id) FROM alive
UNION ALL SELECT 'corpus', count(*), count(DISTINCT document_id) FROM alive
UNION ALL SELECT 'jobs', count(*), count(DISTINCT document_id) FROM jobs WHERE document_id NOT IN (SELECT document_id FROM gone)""",
    "corpus_reindex": _with("documents")
    + """ SELECT collection_id, count(*) AS n, min(c) AS first, max(c) AS last FROM (SELECT *, sha256(document_id || ':0') AS c FROM docs)
WHERE workspace_id <> 'ws_en' OR status IS NULL GROUP BY collection_id""",
    "upsert_chunks": f"SELECT {_CHUNK} AS chunk_id, 'doc_' || doc_id AS document_id, CASE WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 'markdown' ELSE 'txt' END AS parser FROM documents",
    "chunk_tags_synced": _with("documents", "tags", "links") + _EFFECTIVE + " SELECT sha256(document_id || ':0') AS chunk_id, CAST(n AS INTEGER) AS n_tags, tags FROM eff",
    "cascade_delete_workspace": _with("documents", "links")
    + """ SELECT 'workspaces' AS name, count(DISTINCT workspace_id) AS n FROM docs WHERE workspace_id <> 'ws_de' UNION ALL SELECT 'collections', count(DISTINCT collection_id) FROM docs WHERE workspace_id <> 'ws_de'
UNION ALL SELECT 'documents', count(*) FROM docs WHERE workspace_id <> 'ws_de' UNION ALL SELECT 'links', count(*) FROM dt JOIN docs ON document_id = entity_id WHERE workspace_id <> 'ws_de'""",
}
