"""Queries of topics, configuration versions, propagated tags, kept statistics, and work that is queued."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import index, reload, tag_sync
from orrery.operators import mutations as M
from orrery.operators import tags as T
from orrery.plans import model
from orrery.sources import tables
from orrery.sources.shared import shared_path, stored
from orrery.streaming import topics

TTL = 6 * 3600


def topics_with_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live events of all users after a stream in four batches: those that weren't renewed for six hours have expired."""
    path = shared_path(spark, "topic")
    events = model.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("payload"))
    span = events.agg(F.min("ts").alias("first"), (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts")) + 1).alias("width"))
    quarter = F.floor((F.unix_micros("ts") - F.unix_micros("first")) * 4 / F.col("width"))
    dealt = stored(events.join(F.broadcast(span)).select(*events.columns, quarter.alias("quarter")), "quarters")  # one row
    for i in range(4):
        dealt.where(F.col("quarter") == i).drop("quarter").coalesce(1).write.mode("append").parquet(f"{path}/in")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    sent = topics.run_to_end(spark, topics.latest_with_expiry(arriving, TTL), f"{path}/out", f"{path}/check")
    return topics.snapshot(sent).select("key", "event_id", "payload")


def config_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of configurations, one for each five events, with what their workers said: their state, and which version was in force."""
    events = model.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).alias("version"), "event_id", "ts", "user_id", "event_type")
    rows = events.withColumn("config", F.concat(F.lit("c"), F.col("version") % 10))
    acks = rows.where("event_type <> 'view'").select("config", "version", F.col("user_id").alias("worker"), F.when((F.col("event_type") == "error") & (F.col("version") % 3 == 0), "refused").otherwise("ok").alias("result"), "ts")
    versions = rows.groupBy("config", "version").agg(F.min("ts").alias("published_at"), F.when(F.col("version") % 13 == 5, "down").alias("api"), F.when(F.col("version") % 4 == 1, 5).otherwise(2).alias("workers"))
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    states = reload.in_force(reload.version_states(versions, reload.folded_acks(acks), now, 3600))
    return states.select("config", "version", "state", "acked", "reason", "active", "rolled_back")


def _tag_states(spark: SparkSession, sf_dir: str) -> tuple[tag_sync.TagState, tag_sync.TagState]:
    tags = model.tags(spark, sf_dir)
    links = {"workspace": model.workspace_tags(spark, sf_dir), "collection": model.collection_tags(spark, sf_dir), "document": model.document_tags(spark, sf_dir)}
    old = tag_sync.TagState(tags, links)
    renamed = tags.withColumn("name", F.when(F.col("tag_id") == "tag_fr_toxic", "harmful").otherwise(F.col("name"))).withColumn("color", F.lit("#000000"))
    web = links["collection"].where("entity_id = 'col_en_web'").withColumn("tag_id", F.lit("tag_en_toxic"))
    changed = {
        "workspace": links["workspace"].where("entity_id <> 'ws_de'"),
        "collection": links["collection"].unionByName(web),
        "document": links["document"].where("NOT (tag_id = 'tag_es_high quality' AND entity_id LIKE '%7')"),
    }
    return old, tag_sync.TagState(renamed, changed)


def tags_synced_by_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks after changes of links and names on three levels, written as a delta of what the changes concern."""
    old, new = _tag_states(spark, sf_dir)
    documents, root = model.documents(spark, sf_dir), shared_path(spark, "tagged")
    before = T.effective_tags(documents, old.tags, *(old.links[k] for k in tag_sync.LEVELS))
    tables.commit(spark, root, {"chunks": tables.Change(model.chunks(spark, sf_dir).select("chunk_id", "document_id").join(before, "document_id"))})
    delta = tag_sync.synced(tables.read(spark, root, "chunks"), documents, old, new)
    version = tables.commit(spark, root, {"chunks": tables.Change(delta, delta, "chunk_id")})
    came, _ = tables.changes(spark, root, "chunks", version - 1)
    rewritten = came.select("chunk_id", F.lit(True).alias("is_rewritten"))
    out = tables.read(spark, root, "chunks").join(rewritten, "chunk_id", "left")
    return out.select("document_id", F.array_join("tags", "|").alias("tags"), F.coalesce("is_rewritten", F.lit(False)).alias("is_rewritten"))


def statistics_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a corpus after documents came, changed and went, brought up to date from those of the version before."""
    root = shared_path(spark, "corpus")
    rows = model.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("collection_id"), F.col("doc_id").alias("chunk_id"), "text")
    kind = F.pmod("doc_id", F.lit(10))
    tables.commit(spark, root, {"corpus": tables.Change(rows.where(kind < 8))})
    index.table_statistics(spark, root, "corpus")
    new = rows.where(kind.isin(0, 8, 9)).withColumn("text", F.when(kind == 0, F.concat(F.lit("changed "), "text")).otherwise(F.col("text")))
    tables.commit(spark, root, {"corpus": tables.Change(new, rows.where(kind.isin(0, 1)), "doc_id")})
    return index.table_statistics(spark, root, "corpus").select("collection_id", "term", "df", "words", F.round("mean_raw", 6).alias("mean_raw"))


def queued_and_rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and jobs that are written in one version; a deletion whose job couldn't be queued is taken back with its version."""
    root = shared_path(spark, "queue")
    documents = model.documents(spark, sf_dir).select("document_id", "collection_id", F.lit(None).cast("string").alias("status"))
    jobs = documents.select(F.concat(F.lit("job_"), "document_id").alias("job_id"), "document_id", F.lit("pending").alias("status"))
    first = tables.commit(spark, root, {"documents": tables.Change(documents), "jobs": tables.Change(jobs)})
    for ending, queued in (("3", True), ("4", False)):
        gone = F.col("document_id").endswith(ending)
        marked = M.soft_delete(tables.read(spark, root, "documents"), gone).where(gone)
        before = tables.state(spark, root)["version"]
        tables.commit(spark, root, {"documents": tables.Change(marked, marked, "document_id"), "jobs": tables.Change(None, marked.select("document_id"), "document_id")})
        if not queued:
            tables.restore(spark, root, before)
    left = tables.read(spark, root, "jobs").select("document_id", F.col("status").alias("job"))
    first_jobs = tables.read(spark, root, "jobs", first).select("document_id", F.lit(True).alias("had_job"))
    return tables.read(spark, root, "documents").join(left, "document_id", "left").join(first_jobs, "document_id", "left").select("document_id", "status", "job", "had_job")


QUERIES = {f.__name__: f for f in (topics_with_expiry, config_versions, tags_synced_by_change, statistics_after_changes, queued_and_rolled_back)}


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(model.SQL[n] for n in names)


def _effective(name: str, suffix: str, tags: str) -> str:
    return f"""{name} AS (
  SELECT docs.document_id, coalesce(string_agg(name, '|' ORDER BY name), '') AS tags FROM docs LEFT JOIN (
    SELECT DISTINCT document_id, name FROM (
      SELECT document_id, tag_id FROM docs JOIN wt{suffix} w ON w.entity_id = workspace_id UNION ALL
      SELECT document_id, tag_id FROM docs JOIN ct{suffix} c ON c.entity_id = collection_id UNION ALL
      SELECT document_id, tag_id FROM docs JOIN dt{suffix} d ON d.entity_id = document_id) a JOIN {tags} USING (tag_id)) x USING (document_id) GROUP BY docs.document_id)"""


SQL = {
    "topics_with_expiry": f"""
SELECT CAST(user_id AS VARCHAR) AS key, event_id, event_type AS payload FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, max(ts) OVER () AS now FROM events)
WHERE rn = 1 AND ts + INTERVAL {TTL} SECONDS > now""",
    "config_versions": """
WITH e AS (SELECT event_id // 5 AS version, event_id, ts, user_id, event_type, 'c' || ((event_id // 5) % 10) AS config FROM events),
a AS (SELECT config, version, user_id AS worker, ts, CASE WHEN event_type = 'error' AND version % 3 = 0 THEN 'refused' ELSE 'ok' END AS result FROM e WHERE event_type <> 'view'),
f AS (SELECT config, version, count(DISTINCT worker) FILTER (WHERE result = 'ok') AS ok, count(*) FILTER (WHERE result <> 'ok') AS failed FROM a GROUP BY ALL),
v AS (SELECT config, version, min(ts) AS published_at, version % 13 = 5 AS down, CASE WHEN version % 4 = 1 THEN 5 ELSE 2 END AS workers FROM e GROUP BY ALL),
s AS (
  SELECT v.config, v.version, coalesce(ok, 0) AS acked, down, CASE WHEN down OR coalesce(failed, 0) > 0 THEN 'error' WHEN coalesce(ok, 0) >= workers THEN 'applied'
    WHEN epoch(TIMESTAMP '2024-01-10 00:00:00') - floor(epoch(published_at)) > 3600 THEN 'timed_out' ELSE 'pending' END AS state FROM v LEFT JOIN f USING (config, version))
SELECT config, version, state, acked, CASE WHEN state = 'error' THEN CASE WHEN down THEN 'down' ELSE 'refused' END END AS reason,
  max(CASE WHEN state = 'applied' THEN version END) OVER (PARTITION BY config ORDER BY version) AS active, state IN ('error', 'timed_out') AS rolled_back FROM s""",
    "tags_synced_by_change": _with("documents", "tags", "links")
    + """, tags2 AS (SELECT tag_id, CASE WHEN tag_id = 'tag_fr_toxic' THEN 'harmful' ELSE name END AS name FROM tags),
wt2 AS (SELECT * FROM wt WHERE entity_id <> 'ws_de'), ct2 AS (SELECT * FROM ct UNION ALL SELECT entity_id, 'tag_en_toxic' FROM ct WHERE entity_id = 'col_en_web'),
dt2 AS (SELECT * FROM dt WHERE NOT (tag_id = 'tag_es_high quality' AND entity_id LIKE '%7')),
"""
    + _effective("old", "", "tags")
    + ",\n"
    + _effective("new", "2", "tags2")
    + """ SELECT docs.document_id, CASE WHEN status IS NULL THEN new.tags ELSE old.tags END AS tags, status IS NULL AND new.tags <> old.tags AS is_rewritten FROM docs JOIN old USING (document_id) JOIN new USING (document_id)""",
    "statistics_after_changes": r"""
WITH d AS (
  SELECT lang AS collection_id, list_filter(string_split_regex(lower(CASE WHEN doc_id % 10 = 0 THEN 'changed ' || text ELSE coalesce(text, '') END), '\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id % 10 <> 1),
t AS (SELECT collection_id, term, count(*) AS df FROM (SELECT collection_id, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL),
n AS (SELECT collection_id, count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS words FROM d GROUP BY ALL),
m AS (SELECT collection_id, round(avg(ln(n - df + 0.5) - ln(df + 0.5)), 6) AS mean_raw FROM t JOIN n USING (collection_id) GROUP BY ALL)
SELECT collection_id, term, df, 0 AS words, NULL AS mean_raw FROM t UNION ALL SELECT collection_id, NULL, n, words, mean_raw FROM n JOIN m USING (collection_id)""",
    "queued_and_rolled_back": """
SELECT 'doc_' || doc_id AS document_id, CASE WHEN doc_id % 10 = 3 THEN 'deleting' END AS status, CASE WHEN doc_id % 10 <> 3 THEN 'pending' END AS job, true AS had_job FROM documents""",
}
