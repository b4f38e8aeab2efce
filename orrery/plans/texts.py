"""Chunking, scalar function and state queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import structured
from orrery.functions import text as X
from orrery.operators import catalog as C
from orrery.operators import chunking as K
from orrery.operators import tags as T
from orrery.plans import model
from orrery.streaming import progress, rate_limit


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.chunks(spark, sf_dir).select("document_id", "chunk_id")


def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.chunks(spark, sf_dir).select("document_id", X.point_id(F.col("chunk_id")).alias("point_id"))


def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as stored text; a missing language leaves no key."""
    rows = model.chunks(spark, sf_dir).select("document_id", F.struct("filename", "parser", F.when(F.col("language") != "en", F.col("language")).alias("language")).alias("m"))
    return rows.select("document_id", X.encoded_metadata(F.col("m")).alias("metadata"))


def row_group_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each nation, ten rows a chunk."""
    rows = model.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    texts = rows.withColumn("text", X.serialize_row(["c_custkey", "c_name", "c_mktsegment"]))
    return K.row_groups(texts, "c_nationkey", "c_custkey").select("c_nationkey", "chunk_index", "row_range", "total_rows", "text")


def line_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = model.table(spark, sf_dir, "documents").select("doc_id", "text")
    return K.line_windows(texts, lines=5).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


def sliding_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = model.table(spark, sf_dir, "documents").select("doc_id", "text")
    return K.sliding_windows(texts).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


def public_tokenizer() -> str | None:
    """The file of an installed public tokenizer, if there is one."""
    try:
        import public_tokenizers
        import tokenizers  # noqa: F401
    except ModuleNotFoundError:
        return None
    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, by a public tokenizer; its merges can't be said in SQL."""
    texts = model.table(spark, sf_dir, "documents").select("doc_id", "text")
    return K.token_counts(texts, public_tokenizer()).select("doc_id", "n_tokens")


def token_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 512 tokens of a public tokenizer, which overlap by 64."""
    texts = model.table(spark, sf_dir, "documents").select("doc_id", "text")
    return K.token_windows(texts, public_tokenizer()).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


def paragraph_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed like paragraphs, as the texts have no blank lines."""
    texts = model.table(spark, sf_dir, "documents").select("doc_id", "text")
    return K.packed_paragraphs(texts, size=64, overlap=8, separator="\n").select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


def normalize_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit("  "), F.upper("p_type"), F.lit(" ")).alias("raw"))
    return rows.select("p_partkey", X.normalize_tag(F.col("raw")).alias("tag"))


def serialize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "nation").select("n_nationkey", X.serialize_row(["n_nationkey", "n_name", "n_regionkey"]).alias("text"))


def json_extract_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and values of the properties of all events, counted."""
    rows = model.table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "events").select("event_id", F.explode(structured.flatten_json("props")).alias("x"))
    return rows.select("event_id", "x.path", "x.value")


def conversation_text_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.text_of(model.table(spark, sf_dir, "conversations"), "conv_id", order="turn")
    return found.select("conv_id", "parts", F.sha2("text", 256).alias("text_sha256"))


def topic_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = model.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", "event_type")
    return progress.latest_states(events).select("key", "event_id", "event_type")


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limit.limited(rate_limit.requests_of(model.table(spark, sf_dir, "events")), rpm=2)


def tag_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of each part's name as a model's reply: parsed, ranked, and cut at a confidence."""
    replies = model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(", ", F.split("p_name", " "), F.col("p_brand")).alias("reply"))
    existing = model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    ranked = T.rank_suggestions(T.parse_suggestions(replies), existing, 0.7)
    return ranked.select("id", "name", "confidence", "rank")


def tag_suggestions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as JSON: arrays of objects with their own confidences, bad ones too, or arrays of names in prose."""
    part = model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", F.element_at(F.split("p_name", " "), 1).alias("first"))
    objects = F.format_string('Sure: [{"name": "%s", "confidence": 0.9}, {"name": "%s", "confidence": "high"}, {"name": " %s ", "confidence": 1.5}]', "first", "p_brand", "p_type")
    replies = part.select("id", F.when(F.col("id") % 2 == 0, objects).otherwise(F.format_string('["%s", "%s", "%s"]', "first", "p_brand", "first")).alias("reply"))
    return T.parse_suggestions(replies).select("id", "name", "confidence", "position")


def json_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"p": '), "props", F.lit("}"))).otherwise(F.lit("[1")).alias("t"))
    return rows.select("event_id", structured.json_depth("t").alias("depth"))


def metadata_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored metadata read back; fields that were left out are null."""
    meta = chunk_metadata(spark, sf_dir).select("document_id", X.decoded_metadata(F.col("metadata"), "filename string, parser string, language string").alias("m"))
    return meta.select("document_id", "m.*")


def highlighted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "documents").select("doc_id", X.highlighted(F.col("text"), "the and a").alias("marked"))
    return rows.select("doc_id", F.length("marked").alias("n"), F.md5("marked").alias("marked_md5"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return rows.select(
        "o_orderkey",
        X.progress_percent(F.col("o_orderkey") % 41, F.col("o_custkey") % 40).alias("pct"),
        F.round(X.heat_share(F.col("o_custkey"), F.col("o_orderkey")), 6).alias("heat"),
        X.topic_parts(F.concat_ws(":", "o_orderpriority", "o_custkey"))["collection"].alias("collection"),
        X.clamped(F.when(F.col("o_orderkey") % 5 == 0, "high").when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("-"), F.col("o_custkey").cast("string"))).when(F.col("o_orderkey") % 5 == 2, "7.5").otherwise(F.concat(F.lit("0."), F.col("o_custkey").cast("string")))).alias("confidence"),
        X.symbol_kind(F.element_at(F.array(*[F.lit(t) for t in ("Method_declaration", "struct_item", "function_item", "constructor", "impl_item", "call")]), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("kind"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        chunk_ids, point_ids, chunk_metadata, row_group_chunks, line_window_chunks, sliding_window_chunks, paragraph_packing, normalize_tags, serialize_rows, json_extract_props, flatten_json, conversation_text_concat,
        topic_latest_snapshot, token_bucket, tag_suggestions, tag_suggestions_json, json_depths, metadata_round_trip, highlighted_texts, scalar_functions,
    )
}

if public_tokenizer():
    QUERIES |= {f.__name__: f for f in (token_counts, token_window_chunks)}

SQL = {
    "chunk_ids": "SELECT 'doc_' || doc_id AS document_id, sha256('doc_' || doc_id || ':0') AS chunk_id FROM documents",
    "point_ids": """
WITH h AS (SELECT 'doc_' || doc_id AS document_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(sha256('doc_' || doc_id || ':0'))) AS h FROM documents)
SELECT document_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr(h, 17, 1))::INT & 3), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""",
    "chunk_metadata": """
SELECT 'doc_' || doc_id AS document_id, '{"filename":"doc_' || doc_id || '.txt","parser":"txt"' || CASE WHEN lang <> 'en' THEN ',"language":"' || lang || '"' ELSE '' END || '}' AS metadata FROM documents""",
    "row_group_chunks": """
WITH r AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS total_rows,
  'c_custkey=' || c_custkey || '; c_name=' || coalesce(c_name, '') || '; c_mktsegment=' || coalesce(c_mktsegment, '') AS t FROM customer)
SELECT c_nationkey, CAST(i // 10 AS INTEGER) AS chunk_index, min(i) || '-' || max(i) AS row_range, total_rows, string_agg(t, chr(10) ORDER BY i) AS text FROM r GROUP BY c_nationkey, i // 10, total_rows""",
    "line_window_chunks": r"""
WITH l AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|[\n\r]') AS l FROM documents),
w AS (SELECT doc_id, s, regexp_replace(array_to_string(l[s + 1:s + 5], chr(10)), '^\s+|\s+$', '', 'g') AS c FROM (SELECT doc_id, l, unnest(range(0, len(l), 5)) AS s FROM l))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, md5(c) AS chunk_md5 FROM w WHERE c <> ''""",
    "sliding_window_chunks": r"""
WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT *, unnest(CASE WHEN len(w) <= 512 THEN [0] ELSE range(0, CAST(ceil((len(w) - 512) / 448.0) * 448 AS BIGINT) + 1, 448) END) AS b FROM t WHERE len(w) > 0)
SELECT doc_id, CAST(b // 448 AS INTEGER) AS chunk_index, md5(CASE WHEN len(w) <= 512 THEN text ELSE array_to_string(w[b + 1:b + 512], ' ') END) AS chunk_md5 FROM s""",
    "normalize_tags": r"SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '\s+', ' ', 'g')) AS tag FROM part",
    "serialize_rows": "SELECT n_nationkey, 'n_nationkey=' || n_nationkey || '; n_name=' || n_name || '; n_regionkey=' || n_regionkey AS text FROM nation",
    "json_extract_props": """
SELECT k AS path, count(*) AS n, count(DISTINCT props ->> k) AS n_values FROM (SELECT CAST(props AS JSON) AS props, unnest(json_keys(CAST(props AS JSON))) AS k FROM events) GROUP BY k""",
    "flatten_json": "SELECT event_id, k AS path, props ->> k AS value FROM (SELECT event_id, CAST(props AS JSON) AS props, unnest(json_keys(CAST(props AS JSON))) AS k FROM events)",
    "conversation_text_concat": "SELECT conv_id, count(*) AS parts, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text)) AS text_sha256 FROM conversations GROUP BY conv_id",
    "topic_latest_snapshot": "SELECT user_id AS key, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "tag_suggestions": """
WITH n AS (SELECT p_partkey AS id, lower(p_brand) AS brand, string_split(lower(p_name), ' ') || [lower(p_brand)] AS names FROM part),
e AS (SELECT id, brand, unnest(names) AS name, unnest(range(0, len(names))) AS i FROM n),
f AS (SELECT id, brand, name, min(i) AS i FROM e GROUP BY ALL),
c AS (SELECT id, name, i, round(greatest(0.3::DOUBLE, 0.95::DOUBLE - i * 0.07::DOUBLE), 3) AS confidence FROM f WHERE name <> brand)
SELECT id, name, confidence, CAST(row_number() OVER (PARTITION BY id ORDER BY confidence DESC, i) AS INTEGER) AS rank FROM c WHERE confidence >= 0.7""",
    "tag_suggestions_json": """
WITH n AS (SELECT p_partkey AS id, lower(string_split(p_name, ' ')[1]) AS first, lower(p_brand) AS brand, lower(p_type) AS kind FROM part),
e AS (
  SELECT id, unnest([first, brand, kind]) AS name, unnest([0.9::DOUBLE, 0.0, 1.0]) AS confidence, unnest([0, 1, 2]) AS position FROM n WHERE id % 2 = 0
  UNION ALL SELECT id, unnest([first, brand]), unnest([0.95::DOUBLE, 0.88]), unnest([0, 1]) FROM n WHERE id % 2 <> 0)
SELECT id, name, arg_min(confidence, position) AS confidence, min(position) AS position FROM e GROUP BY id, name""",
    "json_depths": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS depth FROM events",
    "metadata_round_trip": "SELECT 'doc_' || doc_id AS document_id, 'doc_' || doc_id || '.txt' AS filename, 'txt' AS parser, CASE WHEN lang <> 'en' THEN lang END AS language FROM documents",
    "highlighted_texts": "SELECT doc_id, CAST(length(m) AS INTEGER) AS n, md5(m) AS marked_md5 FROM (SELECT doc_id, regexp_replace(text, '(and|the)', '<mark>\\1</mark>', 'gi') AS m FROM documents)",
    "scalar_functions": """
SELECT o_orderkey, CASE WHEN o_custkey % 40 <> 0 THEN CAST(round_even(100.0::DOUBLE * (o_orderkey % 41) / (o_custkey % 40), 0) AS INTEGER) END AS pct,
  round(CASE WHEN o_orderkey > 0 THEN o_custkey::DOUBLE / o_orderkey ELSE 0 END, 6) AS heat, CAST(o_custkey AS VARCHAR) AS collection,
  CASE o_orderkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 ELSE CAST('0.' || o_custkey AS DOUBLE) END AS confidence,
  ['method', 'class', 'function', 'method', 'class', 'function'][CAST(o_orderkey % 6 + 1 AS BIGINT)] AS kind FROM orders""",
    "paragraph_packing": r"""
WITH RECURSIVE l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
t AS (SELECT doc_id, unnest(range(len(l))) AS j, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS t FROM l),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i, t, string_split_regex(t, '\s+') AS w FROM t WHERE t <> ''),
s AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS held, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS done FROM documents
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN len(w) > 64 THEN '' WHEN n + len(w) > 64 OR held = '' THEN t ELSE held || chr(10) || t END,
    CASE WHEN len(w) > 64 THEN 0 WHEN n + len(w) > 64 THEN len(w) ELSE n + len(w) END,
    list_concat(CASE WHEN held <> '' AND n + len(w) > 64 THEN [held] ELSE [] END,
      CASE WHEN len(w) > 64 THEN list_transform(range(0, CAST(ceil((len(w) - 64) / 56.0) * 56 AS BIGINT) + 1, 56), lambda b: array_to_string(w[b + 1:b + 64], ' ')) ELSE [] END)
  FROM s JOIN p ON p.doc_id = s.doc_id AND p.i = s.i + 1),
o AS (
  SELECT doc_id, i, unnest(range(len(done))) AS k, unnest(done) AS c FROM s
  UNION ALL SELECT doc_id, i + 1, 0, held FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS r FROM s) WHERE r = 1 AND held <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INTEGER) AS chunk_index, md5(c) AS chunk_md5 FROM o""",
    "token_bucket": """
WITH RECURSIVE e AS (
  SELECT CAST(user_id AS BIGINT) AS key, epoch_us(ts) / 1e6::DOUBLE AS seconds, CAST(event_id AS BIGINT) AS request_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (
  SELECT key, i, seconds, request_id, true AS allowed, 1.0::DOUBLE AS tokens FROM e WHERE i = 1
  UNION ALL
  SELECT key, i, seconds, request_id, t >= 1.0, CASE WHEN t >= 1.0 THEN t - 1.0 ELSE t END
  FROM (SELECT e.*, least(2.0::DOUBLE, s.tokens + (e.seconds - s.seconds) * 2.0::DOUBLE / 60.0::DOUBLE) AS t FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1))
SELECT key, seconds, request_id, allowed FROM s""",
}
