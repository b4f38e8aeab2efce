"""Queries of listings and of changes to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.operators import catalog as C
from orrery.operators import mutations as M
from orrery.operators import retrieval as R
from orrery.operators import tags as T
from orrery.plans import model
from orrery.streaming import ingest


def _created(spark: SparkSession, sf_dir: str, key: str, *columns: str) -> DataFrame:
    """Workspaces or collections with the time of their first document, here its number."""
    rows = model.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("ws_"), "lang").alias("workspace_id"), F.concat_ws("_", F.lit("col"), "lang", "source").alias("collection_id"))
    return rows.groupBy(key, *columns).agg(F.lpad(F.min("doc_id").cast("string"), 12, "0").alias("created_at"))


def listing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspaces newest first, trees oldest first, collections by age, tags by name."""
    workspaces, collections = _created(spark, sf_dir, "workspace_id"), _created(spark, sf_dir, "collection_id", "workspace_id")
    kinds = {
        "workspaces": C.listing(workspaces, F.desc("created_at"), F.col("workspace_id")).select("workspace_id", F.col("workspace_id").alias("id"), "position"),
        "trees": C.listing(workspaces, F.col("created_at"), F.col("workspace_id")).select("workspace_id", F.col("workspace_id").alias("id"), "position"),
        "collections": C.listing(collections, F.col("created_at"), F.col("collection_id"), within="workspace_id").select("workspace_id", F.col("collection_id").alias("id"), "position"),
        "tags": C.listing(model.tags(spark, sf_dir), F.col("name"), F.col("tag_id"), within="workspace_id").select("workspace_id", F.col("tag_id").alias("id"), "position"),
    }
    out = None
    for kind, rows in kinds.items():
        rows = rows.select(F.lit(kind).alias("kind"), "workspace_id", "id", "position")
        out = rows if out is None else out.unionByName(rows)
    return out


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = T.graph_edges(model.documents(spark, sf_dir), model.document_tags(spark, sf_dir))
    found = T.tag_count_map(T.tag_counts(edges, model.tags(spark, sf_dir)))
    return found.select("workspace_id", "max_heat", F.explode("tag_counts").alias("name", "heat"))


def emptied_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of collections of a hundred documents and one language, those that lose all of them with the low quality ones, or are French and labelled."""
    rows = model.documents(spark, sf_dir).withColumn("collection_id", F.concat_ws("_", F.floor(F.regexp_extract("document_id", r"\d+", 0).cast("long") / 10), "language"))
    collections = rows.select("collection_id").distinct()
    labelled = model.table(spark, sf_dir, "labels").select(F.concat(F.lit("doc_"), "doc_id").alias("document_id")).distinct()
    gone = rows.where("status IS NOT NULL").unionByName(rows.where("status IS NULL").join(labelled, "document_id", "left_semi"))
    left = M.delete(rows, gone, "document_id")
    return M.emptied(collections, left, gone)


def merged_tag_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables after a merge: the source tag is gone, its links are the target's."""
    tags, links = M.merge_tag(model.tags(spark, sf_dir), {"document": model.document_tags(spark, sf_dir), "collection": model.collection_tags(spark, sf_dir)}, "tag_en_toxic", "tag_en_high quality")
    out = tags.select(F.lit("tag").alias("kind"), F.col("workspace_id").alias("entity_id"), "tag_id")
    for kind, rows in links.items():
        out = out.unionByName(rows.select(F.lit(kind).alias("kind"), "entity_id", "tag_id"))
    return out


def _new_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag for each part and language: many of one name, some of names that exist."""
    names = F.when(F.col("p_partkey") % 5 == 0, "toxic").otherwise(X.normalize_tag(F.col("p_brand")))
    workspace = F.concat(F.lit("ws_"), F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "xx")]), (F.col("p_partkey") % 3 + 1).cast("int")))
    return model.table(spark, sf_dir, "part").select(workspace.alias("workspace_id"), names.alias("name"), F.format_string("new_%08d", "p_partkey").alias("tag_id"))


def created_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag that was asked for: created, or in conflict with one that exists or with another of the request."""
    new = _new_tags(spark, sf_dir)
    table, conflicts = M.insert_unique(model.tags(spark, sf_dir).select("workspace_id", "name", "tag_id"), new, ["workspace_id", "name"], ["tag_id"])
    created = table.join(new.select("tag_id"), "tag_id", "left_semi").withColumn("conflict", F.lit("none"))
    return created.unionByName(conflicts).select("workspace_id", "name", "tag_id", "conflict")


def tags_got_or_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = M.get_or_create(model.tags(spark, sf_dir).select("workspace_id", "name", "tag_id"), _new_tags(spark, sf_dir))
    return table.select("workspace_id", "name", F.when(F.col("tag_id").startswith(F.concat(F.lit("tag_"), F.substring("workspace_id", 4, 9))), "old").otherwise(F.substring("tag_id", 1, 8)).alias("id"))


def updated_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates: only values that are given replace the old ones."""
    rows = model.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = rows.where("c_custkey % 3 < 2").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, "NONE").alias("c_mktsegment"))
    return M.update(rows, "c_custkey", changes, ["c_name", "c_mktsegment"])


def links_assigned_and_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents get their high quality twice and lose the mark of being toxic, those without it too."""
    links = model.document_tags(spark, sf_dir)
    toxic = links.where(F.col("tag_id").endswith("_toxic"))
    new = toxic.withColumn("tag_id", F.regexp_replace("tag_id", "_toxic$", "_high quality"))
    gone = links.withColumn("tag_id", F.regexp_replace("tag_id", "_high quality$", "_toxic"))
    return M.unassign(M.assign(M.assign(links, new), new), gone.distinct())


def reindexed_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus in which one document's rows were wrong, made anew from its chunks."""
    chunks = model.chunks(spark, sf_dir).select("chunk_id", "document_id", "text")
    wrong = chunks.unionByName(chunks.where("document_id = 'doc_7'").withColumn("chunk_id", F.lit("old"))).withColumn("text", F.when(F.col("document_id") == "doc_7", "wrong").otherwise(F.col("text")))
    return M.reindex_document(wrong, chunks, "doc_7").select("chunk_id", "document_id", F.md5("text").alias("text_md5"))


def jobs_moved_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose status changed, and those that can be taken up: not done, and not begun too short a time before noon of the second of January."""
    rows = model.table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("processing_started_at"))
    changes = rows.where("job_id % 4 < 2").select("job_id", F.when(F.col("job_id") % 4 == 0, "done").otherwise("processing").alias("status"))
    moved = M.set_job_status(rows, changes)
    free = ingest.runnable(moved, F.lit("2024-01-02 12:00:00").cast("timestamp")).select("job_id", F.lit(True).alias("runnable"))
    return moved.join(free, "job_id", "left").select("job_id", "status", F.coalesce("runnable", F.lit(False)).alias("runnable"))


def acknowledged_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledgements of a version by its workers: applied, pending or an error."""
    events = model.table(spark, sf_dir, "events").select((F.floor(F.col("event_id") / 5)).alias("version_id"), F.col("user_id").alias("worker"), "event_type", "event_id")
    acks = events.where("event_type <> 'view' AND version_id % 7 <> 0").select("version_id", "worker", F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("result"))
    expected = events.groupBy("version_id").agg(F.when(F.max("event_id") % 11 == 0, "down").alias("api"), (F.count("*") - F.count_if(F.col("event_type") == "view")).alias("workers"))
    return C.acknowledgements(acks, expected)


def more_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    names = F.element_at(F.array(*[F.lit(x) for x in ("a.py", "B.TSX", "c.d/e.rs", "noext", "x.java.go", ".js", "y.mjs")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    secret = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 8 == 0, "")
    return rows.select(
        "o_orderkey",
        X.language_of(names).alias("language"),
        X.breadcrumb(F.array("o_orderpriority", "o_orderstatus")).alias("path"),
        X.masked(secret).alias("shown"),
        X.unmasked(F.when(F.col("o_orderkey") % 2 == 0, X.masked(secret)).otherwise(F.lit("new")), secret).alias("stored"),
        F.length(X.prompt_text(F.repeat("o_orderpriority", (F.col("o_orderkey") % 900).cast("int")))).alias("prompt_chars"),
        X.stale(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")), F.lit("1996-01-01 00:00:00").cast("timestamp"), 3600).alias("is_stale"),
    )


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as they are understood: the mode, the clamped number of results, the pool of candidates."""
    rows = model.table(spark, sf_dir, "nation").select("n_nationkey")
    modes, out = {k: R.search_mode(m, h) for k, (m, h) in enumerate([(None, True), (None, False), ("bm25", True), ("semantic", False)])}, None
    for k, mode in modes.items():
        own = rows.where(F.col("n_nationkey") % 4 == k).withColumn("mode", F.lit(mode))
        out = own if out is None else out.unionByName(own)
    sizes = F.element_at(F.create_map(*[F.lit(x) for k in range(25) for x in (k, R.clamped_top_k(2 * k - 10))]), F.col("n_nationkey"))
    pools = F.element_at(F.create_map(*[F.lit(x) for k in range(25) for x in (k, R.pool_size(5, k - 3))]), F.col("n_nationkey"))
    return out.select("n_nationkey", "mode", sizes.alias("top_k"), pools.alias("pool"))


QUERIES = {
    f.__name__: f
    for f in (
        listing_orders, tag_counts, emptied_collections, merged_tag_tables, created_tags, tags_got_or_created, updated_customers, links_assigned_and_not, reindexed_document, jobs_moved_on, acknowledged_versions, more_scalar_functions, search_requests,
    )
}


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(model.SQL[n] for n in names)


_NEW = """new AS (
  SELECT 'ws_' || ['en', 'de', 'xx'][CAST(p_partkey % 3 + 1 AS BIGINT)] AS workspace_id, CASE WHEN p_partkey % 5 = 0 THEN 'toxic' ELSE lower(p_brand) END AS name, 'new_' || lpad(p_partkey::VARCHAR, 8, '0') AS tag_id FROM part)"""

SQL = {
    "listing_orders": "WITH w AS (SELECT 'ws_' || lang AS workspace_id, min(doc_id) AS t FROM documents GROUP BY lang), c AS (SELECT 'ws_' || lang AS workspace_id, 'col_' || lang || '_' || source AS id, min(doc_id) AS t FROM documents GROUP BY lang, source),\n"
    + model.SQL["tags"]
    + """ SELECT 'workspaces' AS kind, workspace_id, workspace_id AS id, CAST(row_number() OVER (ORDER BY t DESC) AS INTEGER) AS position FROM w
UNION ALL SELECT 'trees', workspace_id, workspace_id, row_number() OVER (ORDER BY t) FROM w
UNION ALL SELECT 'collections', workspace_id, id, row_number() OVER (PARTITION BY workspace_id ORDER BY t) FROM c
UNION ALL SELECT 'tags', workspace_id, tag_id, row_number() OVER (PARTITION BY workspace_id ORDER BY name) FROM tags""",
    "tag_counts": _with("documents", "tags", "links")
    + """, edges AS (SELECT entity_id AS source, tag_id FROM dt JOIN docs ON document_id = entity_id WHERE status IS NULL),
h AS (SELECT workspace_id, name, count(DISTINCT source) AS heat FROM edges JOIN tags USING (tag_id) GROUP BY ALL)
SELECT workspace_id, name, heat, max(heat) OVER (PARTITION BY workspace_id) AS max_heat FROM h""",
    "emptied_collections": """
WITH d AS (SELECT (doc_id // 10) || '_' || lang AS collection_id, doc_id IN (SELECT doc_id FROM labels) AS gone FROM documents)
SELECT collection_id FROM d GROUP BY collection_id HAVING bool_and(gone)""",
    "merged_tag_tables": _with("tags", "links")
    + """ SELECT 'tag' AS kind, workspace_id AS entity_id, tag_id FROM tags WHERE tag_id <> 'tag_en_toxic'
UNION ALL SELECT DISTINCT 'document', entity_id, CASE tag_id WHEN 'tag_en_toxic' THEN 'tag_en_high quality' ELSE tag_id END FROM dt
UNION ALL SELECT DISTINCT 'collection', entity_id, tag_id FROM ct""",
    "created_tags": _with("tags")
    + ",\n"
    + _NEW
    + """ SELECT workspace_id, name, tag_id, CASE WHEN EXISTS (SELECT 1 FROM tags t WHERE t.workspace_id = new.workspace_id AND t.name = new.name) THEN 'exists'
  WHEN row_number() OVER (PARTITION BY workspace_id, name ORDER BY tag_id) > 1 THEN 'repeated' ELSE 'none' END AS conflict FROM new""",
    "tags_got_or_created": _with("tags")
    + ",\n"
    + _NEW
    + """ SELECT workspace_id, name, 'old' AS id FROM tags
UNION ALL SELECT workspace_id, name, 'tag_' || substr(sha256(workspace_id || ':' || name), 1, 4) FROM (SELECT DISTINCT workspace_id, name FROM new) n WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.workspace_id = n.workspace_id AND t.name = n.name)""",
    "updated_customers": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 < 2 AND c_custkey % 2 = 0 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "links_assigned_and_not": _with("links") + " SELECT DISTINCT entity_id, regexp_replace(tag_id, '_toxic$', '_high quality') AS tag_id FROM dt",
    "reindexed_document": "SELECT sha256('doc_' || doc_id || ':0') AS chunk_id, 'doc_' || doc_id AS document_id, md5(text) AS text_md5 FROM documents",
    "jobs_moved_on": """
SELECT event_id AS job_id, s AS status, s <> 'done' AND NOT (s = 'processing' AND epoch(TIMESTAMP '2024-01-02 12:00:00') - floor(epoch(ts)) < 1860) AS runnable
FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'processing' ELSE event_type END AS s FROM events)""",
    "acknowledged_versions": """
WITH e AS (SELECT event_id // 5 AS version_id, event_id, event_type FROM events),
a AS (SELECT version_id, count(*) FILTER (WHERE event_type <> 'error') AS ok, bool_or(event_type = 'error') AS failed, count(*) AS acked FROM e WHERE event_type <> 'view' AND version_id % 7 <> 0 GROUP BY version_id),
x AS (SELECT version_id, max(event_id) % 11 = 0 AS down, count(*) FILTER (WHERE event_type <> 'view') AS workers FROM e GROUP BY version_id)
SELECT version_id, CASE WHEN down OR coalesce(failed, false) THEN 'error' WHEN coalesce(ok, 0) >= workers THEN 'applied' ELSE 'pending' END AS status, coalesce(acked, 0) AS acked FROM x LEFT JOIN a USING (version_id)""",
    "more_scalar_functions": """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority WHEN o_orderkey % 8 = 0 THEN '' END AS secret FROM orders)
SELECT o_orderkey, ['python', 'tsx', 'rust', NULL, 'go', 'javascript', 'javascript'][CAST(o_orderkey % 7 + 1 AS BIGINT)] AS language, o_orderpriority || ' > ' || o_orderstatus AS path,
  CASE WHEN secret <> '' THEN '********' ELSE secret END AS shown, CASE WHEN o_orderkey % 2 = 0 THEN secret ELSE 'new' END AS stored,
  CAST(least(6000, length(o_orderpriority) * (o_orderkey % 900)) AS INTEGER) AS prompt_chars, o_orderkey % 3 <> 0 AND o_orderdate <= TIMESTAMP '1995-12-31 23:00:00' AS is_stale FROM o""",
    "search_requests": """
SELECT n_nationkey, ['hybrid', 'semantic', 'bm25', 'semantic'][n_nationkey % 4 + 1] AS mode, CAST(greatest(1, least(2 * n_nationkey - 10, 20)) AS INTEGER) AS top_k, CAST(5 * greatest(1, least(n_nationkey - 3, 10)) AS INTEGER) AS pool FROM nation""",
}
