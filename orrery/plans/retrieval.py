"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import index
from orrery.operators import retrieval as R
from orrery.plans import model

TOP_K = 5
POOL = R.pool_size(TOP_K)


def _statistics(spark: SparkSession, sf_dir: str, corpus: DataFrame | None = None) -> DataFrame:
    """Statistics of the corpus by language, or of all of it, kept by the version of its files."""
    version = index.version_of(spark, f"{sf_dir}/documents.parquet")
    return index.kept_statistics(spark, f"{version}-{'lang' if corpus is None else 'all'}", lambda: model.corpus(spark, sf_dir) if corpus is None else corpus)


def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = model.table(spark, sf_dir, "embeddings").select(F.lit("all").alias("collection_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    found = R.nearest(chunks, model.query(spark, sf_dir).select("query_vector"), POOL)
    return found.select("chunk_id", F.round("cosine", 6).alias("cosine"), "vec_rank")


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = R.corpus_statistics(model.corpus(spark, sf_dir))
    found = R.inverse_frequencies(R.document_frequencies(statistics), R.corpus_sizes(statistics))
    return found.select("collection_id", "term", "df", F.round("idf", 6).alias("idf"))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.bm25(model.corpus(spark, sf_dir), model.query(spark, sf_dir).select("query_text"), _statistics(spark, sf_dir))
    return found.select("collection_id", "chunk_id", F.round("bm25", 6).alias("bm25"))


def _ranked(spark: SparkSession, sf_dir: str, mode: str = "hybrid", request: DataFrame | None = None) -> DataFrame:
    return R.search(model.vectors(spark, sf_dir), model.corpus(spark, sf_dir), model.query(spark, sf_dir), mode=mode, top_k=TOP_K, request=request, statistics=_statistics(spark, sf_dir))


def _shown(results: DataFrame) -> DataFrame:
    return results.select("collection_id", "chunk_id", "vec_rank", "bm25_rank", F.round("fused", 9).alias("fused"), "rank")


def rrf_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.collection_results(_ranked(spark, sf_dir), TOP_K))


def search_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.collection_results(_ranked(spark, sf_dir, "semantic"), TOP_K))


def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.collection_results(_ranked(spark, sf_dir, "bm25"), TOP_K))


def search_filtered_after_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are one collection; the filter on language comes after ranking and may leave too few."""
    everything = model.vectors(spark, sf_dir).withColumn("collection_id", F.lit("all"))
    corpus = model.corpus(spark, sf_dir).withColumn("collection_id", F.lit("all"))
    ranked = R.search(everything, corpus, model.query(spark, sf_dir), top_k=TOP_K, statistics=_statistics(spark, sf_dir, corpus))
    return _shown(R.collection_results(ranked, TOP_K, {"language": "fr"}))


REQUEST = ("fr", "en", "de", "es")


def _request(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT posexplode(array(" + ", ".join(f"'{c}'" for c in REQUEST) + ")) AS (ordinal, collection_id)")


def _multi(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    request = _request(spark)
    ranked = _ranked(spark, sf_dir, request=request)
    results = R.collection_results(ranked, TOP_K, {"filename": None})
    return ranked, results, R.merged(results, request, TOP_K)


def search_multi_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multi(spark, sf_dir)[2].select("collection_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


def search_collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collection_stats(*_multi(spark, sf_dir))


def search_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker (here: shorter texts first) orders the head of each collection before the cut."""
    sizes = model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars")
    ranked = _ranked(spark, sf_dir).join(sizes, "chunk_id")
    return R.collection_results(ranked, TOP_K, rerank=lambda rows: R.reranked(rows, -F.col("n_chars"), 10)).select("collection_id", "chunk_id", "rank")


def search_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged list with the collection, workspace and file of each result."""
    collections = model.table(spark, sf_dir, "documents").select(F.col("lang").alias("collection_id"), F.concat(F.lit("ws_"), "lang").alias("workspace_id"), F.upper("lang").alias("name")).distinct()
    workspaces = model.workspaces(spark, sf_dir).withColumn("name", F.concat(F.lit("Workspace "), "workspace_id"))
    shown = R.with_provenance(_multi(spark, sf_dir)[2], collections, workspaces)
    return shown.select("chunk_id", "rank", "source.document_id", "source.collection_name", "source.workspace_name", "source.filename", "source.page_number")


def search_under_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.under_delivered(search_filtered_after_rank(spark, sf_dir), TOP_K)


# The searches over many queries: every row whose id is divisible by model.EVERY against all rows.


def _ranked_each(spark: SparkSession, sf_dir: str, mode: str = "hybrid", request: DataFrame | None = None) -> DataFrame:
    return R.search(model.vectors(spark, sf_dir), model.corpus(spark, sf_dir), model.queries(spark, sf_dir), mode=mode, top_k=TOP_K, request=request, statistics=_statistics(spark, sf_dir))


def _shown_each(results: DataFrame) -> DataFrame:
    return results.select("query_id", "collection_id", "chunk_id", "vec_rank", "bm25_rank", F.round("fused", 9).alias("fused"), "rank")


def knn_cosine_topk_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = model.table(spark, sf_dir, "embeddings").select(F.lit("all").alias("collection_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    query = chunks.where(F.col("chunk_id") % model.EVERY == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return R.nearest(chunks, query, POOL).select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine"), "vec_rank")


def bm25_scores_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk for every query, so the rows grow with the square of the input."""
    found = R.bm25(model.corpus(spark, sf_dir), model.queries(spark, sf_dir).select("query_id", "query_text"), _statistics(spark, sf_dir))
    # F.round goes through decimals of text, which for so many rows takes longer than the scores
    return found.select("query_id", "collection_id", "chunk_id", (F.rint(F.col("bm25") * 1e6) / 1e6).alias("bm25"))


def rrf_hybrid_topk_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_each(R.collection_results(_ranked_each(spark, sf_dir), TOP_K))


def search_semantic_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_each(R.collection_results(_ranked_each(spark, sf_dir, "semantic"), TOP_K))


def search_bm25_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_each(R.collection_results(_ranked_each(spark, sf_dir, "bm25"), TOP_K))


def search_filtered_after_rank_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = model.vectors(spark, sf_dir).withColumn("collection_id", F.lit("all"))
    corpus = model.corpus(spark, sf_dir).withColumn("collection_id", F.lit("all"))
    ranked = R.search(everything, corpus, model.queries(spark, sf_dir), top_k=TOP_K, statistics=_statistics(spark, sf_dir, corpus))
    return _shown_each(R.collection_results(ranked, TOP_K, {"language": "fr"}))


def _multi_each(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    request = _request(spark)
    ranked = _ranked_each(spark, sf_dir, request=request)
    results = R.collection_results(ranked, TOP_K, {"filename": None})
    return ranked, results, R.merged(results, request, TOP_K)


def search_multi_collection_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multi_each(spark, sf_dir)[2].select("query_id", "collection_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


def search_collection_stats_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collection_stats(*_multi_each(spark, sf_dir))


def search_reranked_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars")
    ranked = _ranked_each(spark, sf_dir).join(sizes, "chunk_id")
    return R.collection_results(ranked, TOP_K, rerank=lambda rows: R.reranked(rows, -F.col("n_chars"), 10)).select("query_id", "collection_id", "chunk_id", "rank")


def search_provenance_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    collections = model.table(spark, sf_dir, "documents").select(F.col("lang").alias("collection_id"), F.concat(F.lit("ws_"), "lang").alias("workspace_id"), F.upper("lang").alias("name")).distinct()
    workspaces = model.workspaces(spark, sf_dir).withColumn("name", F.concat(F.lit("Workspace "), "workspace_id"))
    shown = R.with_provenance(_multi_each(spark, sf_dir)[2], collections, workspaces)
    return shown.select("query_id", "chunk_id", "rank", "source.collection_name", "source.workspace_name", "source.filename")


def search_under_delivered_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.under_delivered(search_filtered_after_rank_each(spark, sf_dir), TOP_K, model.queries(spark, sf_dir))


def search_partial_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus lacks every third document: such a candidate scores 0 and keeps its place among the zeros."""
    corpus = model.corpus(spark, sf_dir).where("chunk_id % 3 <> 0")
    return _shown(R.search(model.vectors(spark, sf_dir), corpus, model.query(spark, sf_dir), top_k=TOP_K))


def search_tags_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that carry all wanted tags, filtered after ranking."""
    names = model.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"), F.array(F.lit("high quality"), F.lit("seen")).alias("tags"))
    ranked = _ranked(spark, sf_dir).join(names, "chunk_id", "left")
    return _shown(R.collection_results(ranked, TOP_K, {"tags": ["high quality", "seen"]}))


def search_effective_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection without a corpus makes the whole response semantic; one with all of them is as asked."""
    corpus, collections = model.corpus(spark, sf_dir), _request(spark).select("collection_id")
    partial = R.effective_mode("hybrid", corpus.where("collection_id <> 'es'"), collections).select(F.lit("partial").alias("corpus"), "mode")
    return partial.unionByName(R.effective_mode("hybrid", corpus, collections).select(F.lit("whole").alias("corpus"), "mode"))


def search_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collections of a request that exist, in its order, repeated ones too."""
    request = spark.sql("SELECT posexplode(array('fr', 'xx', 'en', 'fr')) AS (ordinal, collection_id)")
    return R.requested(model.corpus(spark, sf_dir).select("collection_id").distinct(), request).select("ordinal", "collection_id")


def fused_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists for each sixty documents, which share only some of their rows."""
    ids = model.table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 60).alias("query_id"), (F.col("doc_id") % 60 + 1).alias("i"))
    lists = [ids.where(f"i % {m} = 0").select("query_id", F.col("doc_id").alias("chunk_id"), (F.col("i") / m).cast("int").alias("rank")) for m in (2, 3)]
    return R.fuse_lists(*lists).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def _sql(group: str, tail: str, corpus: str = "true") -> str:
    """The search in SQL, with ``group`` as the collection of a document, and a condition for those in the corpus."""
    return f"""
WITH tok AS (SELECT {group} AS c, doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE {corpus}),
st AS (SELECT c, count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM tok GROUP BY c),
tf AS (SELECT c, doc_id, dl, term, count(*) AS tf FROM (SELECT c, doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT c, term, count(*) AS df FROM tf GROUP BY c, term),
raw AS (SELECT dfs.c, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs JOIN st ON dfs.c = st.c),
idf AS (SELECT c, term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY c) ELSE raw END AS idf FROM raw),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest(string_split_regex('{model.QUERY_TEXT}', '\\s+')) AS term) GROUP BY term),
hit AS (
  SELECT tf.c, tf.doc_id, sum(times * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM tf JOIN q ON q.term = tf.term JOIN idf ON idf.c = tf.c AND idf.term = tf.term JOIN st ON st.c = tf.c GROUP BY tf.c, tf.doc_id),
bm AS (SELECT tok.c, tok.doc_id, coalesce(bm25, 0.0) AS bm25 FROM tok LEFT JOIN hit ON hit.doc_id = tok.doc_id),
qv AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7),
cos AS (
  SELECT {group} AS c, d.doc_id, d.lang, d.n_chars, list_dot_product(CAST(e.embedding AS DOUBLE[]), qv.v)
    / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(qv.v, qv.v))) AS cosine
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, qv),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(cosine, 9) DESC NULLS LAST, doc_id) AS vec_rank FROM cos) WHERE vec_rank <= {POOL}),
both_ AS (
  SELECT cand.*, row_number() OVER (PARTITION BY cand.c ORDER BY round(coalesce(bm25, 0.0), 9) DESC, vec_rank) AS bm25_rank FROM cand LEFT JOIN bm ON bm.doc_id = cand.doc_id),
sc AS (SELECT *, 0.7::DOUBLE * (1.0::DOUBLE / (60 + vec_rank)) + 0.30000000000000004::DOUBLE * (1.0::DOUBLE / (60 + bm25_rank)) AS hybrid,
  1.0::DOUBLE / (60 + vec_rank) AS semantic, 1.0::DOUBLE / (60 + bm25_rank) AS lexical FROM both_),
rk AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY hybrid DESC, bm25_rank) AS rank FROM sc)
{tail}"""


_OUT = "c AS collection_id, doc_id AS chunk_id, vec_rank, bm25_rank"
_ORDER = "(VALUES (0, 'fr'), (1, 'en'), (2, 'de'), (3, 'es')) AS o(ordinal, c)"
_MERGED = f"SELECT rk.c, doc_id, rank, 1.0::DOUBLE / (60 + rank) AS score FROM rk JOIN {_ORDER} ON o.c = rk.c WHERE rank <= {TOP_K} ORDER BY score DESC, ordinal LIMIT {TOP_K}"

QUERIES = {f.__name__: f for f in (knn_cosine_topk, bm25_idf, bm25_scores, rrf_hybrid_topk, search_semantic, search_bm25, search_filtered_after_rank, search_multi_collection, search_collection_stats, search_reranked, search_provenance, search_under_delivered, search_partial_corpus, search_tags_filter, search_effective_mode, search_requested, fused_lists)}

SQL = {
    "search_partial_corpus": _sql("lang", f"SELECT {_OUT}, round(hybrid, 9) AS fused, rank FROM rk", "doc_id % 3 <> 0"),
    "search_tags_filter": _sql(
        "lang",
        f"""SELECT * FROM (SELECT {_OUT}, round(hybrid, 9) AS fused, row_number() OVER (PARTITION BY c ORDER BY rank) AS rank FROM rk
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE rank <= {TOP_K}""",
    ),
    "search_effective_mode": "SELECT 'partial' AS corpus, 'semantic_only' AS mode UNION ALL SELECT 'whole', CASE WHEN count(DISTINCT lang) FILTER (WHERE lang IN ('fr', 'en', 'de', 'es')) = 4 THEN 'hybrid' ELSE 'semantic_only' END FROM documents",
    "search_requested": "SELECT ordinal, c AS collection_id FROM (VALUES (0, 'fr'), (1, 'xx'), (2, 'en'), (3, 'fr')) AS r(ordinal, c) WHERE c IN (SELECT lang FROM documents)",
    "fused_lists": """
WITH i AS (SELECT doc_id, doc_id // 60 AS query_id, doc_id % 60 + 1 AS i FROM documents),
s AS (SELECT query_id, doc_id, i / 2 AS s FROM i WHERE i % 2 = 0), b AS (SELECT query_id, doc_id, i / 3 AS b FROM i WHERE i % 3 = 0),
f AS (SELECT coalesce(s.query_id, b.query_id) AS query_id, coalesce(s.doc_id, b.doc_id) AS chunk_id, s, b, coalesce(0.7::DOUBLE * (1.0::DOUBLE / (60 + s)), 0) + coalesce(0.30000000000000004::DOUBLE * (1.0::DOUBLE / (60 + b)), 0) AS score FROM s FULL JOIN b ON s.doc_id = b.doc_id)
SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, b NULLS LAST, s NULLS LAST) AS rank FROM f""",
    "knn_cosine_topk": f"""
WITH qv AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7),
s AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), v)
  / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(v, v))) AS cosine FROM embeddings, qv)
SELECT * FROM (SELECT vec_id AS chunk_id, round(cosine, 6) AS cosine, row_number() OVER (ORDER BY round(cosine, 9) DESC NULLS LAST, vec_id) AS vec_rank FROM s) WHERE vec_rank <= {POOL}""",
    "bm25_idf": _sql("lang", "SELECT c AS collection_id, term, df, round(idf, 6) AS idf FROM idf"),
    "bm25_scores": _sql("lang", "SELECT c AS collection_id, doc_id AS chunk_id, round(bm25, 6) AS bm25 FROM bm"),
    "rrf_hybrid_topk": _sql("lang", f"SELECT {_OUT}, round(hybrid, 9) AS fused, rank FROM rk WHERE rank <= {TOP_K}"),
    "search_semantic": _sql("lang", f"SELECT {_OUT}, round(semantic, 9) AS fused, vec_rank AS rank FROM rk WHERE vec_rank <= {TOP_K}"),
    "search_bm25": _sql("lang", f"SELECT {_OUT}, round(lexical, 9) AS fused, bm25_rank AS rank FROM rk WHERE bm25_rank <= {TOP_K}"),
    "search_filtered_after_rank": _sql("'all'", f"SELECT * FROM (SELECT {_OUT}, round(hybrid, 9) AS fused, row_number() OVER (ORDER BY rank) AS rank FROM rk WHERE lang = 'fr') WHERE rank <= {TOP_K}"),
    "search_multi_collection": _sql("lang", f"SELECT c AS collection_id, doc_id AS chunk_id, rank, round(score, 9) AS score FROM ({_MERGED})"),
    "search_collection_stats": _sql(
        "lang",
        f"""SELECT o.c AS collection_id, count(rk.doc_id) AS retrieved, count(rk.doc_id) FILTER (WHERE rank <= {TOP_K}) AS returned,
  (SELECT count(*) FROM ({_MERGED}) m WHERE m.c = o.c) AS contributed FROM {_ORDER} JOIN rk ON rk.c = o.c GROUP BY o.c""",
    ),
    "search_provenance": _sql("lang", f"SELECT doc_id AS chunk_id, rank, 'doc_' || doc_id AS document_id, CAST(NULL AS INTEGER) AS page_number, upper(c) AS collection_name, 'Workspace ws_' || c AS workspace_name, 'doc_' || doc_id || '.txt' AS filename FROM ({_MERGED})"),
    "search_under_delivered": _sql("'all'", f"SELECT count(*) < {TOP_K} AS under_delivered FROM rk WHERE lang = 'fr'"),
    "search_reranked": _sql(
        "lang",
        f"SELECT * FROM (SELECT c AS collection_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY c ORDER BY (rank > 10)::INT, CASE WHEN rank <= 10 THEN n_chars END NULLS LAST, rank) AS rank FROM rk) WHERE rank <= {TOP_K}",
    ),
}


def _sql_each(group: str, tail: str) -> str:
    """The search of many queries in SQL, with ``group`` as the collection of a document."""
    return f"""
WITH tok AS (SELECT {group} AS c, doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
st AS (SELECT c, count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM tok GROUP BY c),
tf AS (SELECT c, doc_id, dl, term, count(*) AS tf FROM (SELECT c, doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT c, term, count(*) AS df FROM tf GROUP BY c, term),
raw AS (SELECT dfs.c, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs JOIN st ON dfs.c = st.c),
idf AS (SELECT c, term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY c) ELSE raw END AS idf FROM raw),
qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % {model.EVERY} = 0),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(w) AS term FROM tok JOIN qv ON qv.query_id = tok.doc_id) GROUP BY ALL),
hit AS (
  SELECT q.query_id, tf.c, tf.doc_id, sum(times * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM tf JOIN q ON q.term = tf.term JOIN idf ON idf.c = tf.c AND idf.term = tf.term JOIN st ON st.c = tf.c GROUP BY ALL),
bm AS (
  SELECT qv.query_id, tok.c, tok.doc_id, coalesce(bm25, 0.0) AS bm25
  FROM tok CROSS JOIN qv LEFT JOIN hit ON hit.query_id = qv.query_id AND hit.doc_id = tok.doc_id),
cos AS (
  SELECT qv.query_id, {group} AS c, d.doc_id, d.lang, d.n_chars, list_dot_product(CAST(e.embedding AS DOUBLE[]), qv.v)
    / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(qv.v, qv.v))) AS cosine
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, qv),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY round(cosine, 9) DESC NULLS LAST, doc_id) AS vec_rank FROM cos) WHERE vec_rank <= {POOL}),
both_ AS (
  SELECT cand.*, row_number() OVER (PARTITION BY cand.query_id, cand.c ORDER BY round(bm25, 9) DESC, vec_rank) AS bm25_rank
  FROM cand JOIN bm ON bm.query_id = cand.query_id AND bm.doc_id = cand.doc_id),
sc AS (SELECT *, 0.7::DOUBLE * (1.0::DOUBLE / (60 + vec_rank)) + 0.30000000000000004::DOUBLE * (1.0::DOUBLE / (60 + bm25_rank)) AS hybrid,
  1.0::DOUBLE / (60 + vec_rank) AS semantic, 1.0::DOUBLE / (60 + bm25_rank) AS lexical FROM both_),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY hybrid DESC, bm25_rank) AS rank FROM sc)
{tail}"""


_OUT_EACH = f"query_id, {_OUT}"
_MERGED_EACH = f"""SELECT * FROM (SELECT query_id, rk.c, doc_id, rank, 1.0::DOUBLE / (60 + rank) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY 1.0::DOUBLE / (60 + rank) DESC, ordinal) AS place FROM rk JOIN {_ORDER} ON o.c = rk.c WHERE rank <= {TOP_K}) WHERE place <= {TOP_K}"""

QUERIES |= {
    f.__name__: f
    for f in (
        knn_cosine_topk_each,
        bm25_scores_each,
        rrf_hybrid_topk_each,
        search_semantic_each,
        search_bm25_each,
        search_filtered_after_rank_each,
        search_multi_collection_each,
        search_collection_stats_each,
        search_reranked_each,
        search_provenance_each,
        search_under_delivered_each,
    )
}

SQL |= {
    "knn_cosine_topk_each": f"""
WITH qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % {model.EVERY} = 0),
s AS (SELECT query_id, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), v)
  / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(v, v))) AS cosine FROM embeddings, qv)
SELECT * FROM (SELECT query_id, vec_id AS chunk_id, round(cosine, 6) AS cosine,
  row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC NULLS LAST, vec_id) AS vec_rank FROM s) WHERE vec_rank <= {POOL}""",
    "bm25_scores_each": _sql_each("lang", "SELECT query_id, c AS collection_id, doc_id AS chunk_id, round(bm25, 6) AS bm25 FROM bm"),
    "rrf_hybrid_topk_each": _sql_each("lang", f"SELECT {_OUT_EACH}, round(hybrid, 9) AS fused, rank FROM rk WHERE rank <= {TOP_K}"),
    "search_semantic_each": _sql_each("lang", f"SELECT {_OUT_EACH}, round(semantic, 9) AS fused, vec_rank AS rank FROM rk WHERE vec_rank <= {TOP_K}"),
    "search_bm25_each": _sql_each("lang", f"SELECT {_OUT_EACH}, round(lexical, 9) AS fused, bm25_rank AS rank FROM rk WHERE bm25_rank <= {TOP_K}"),
    "search_filtered_after_rank_each": _sql_each(
        "'all'", f"SELECT * FROM (SELECT {_OUT_EACH}, round(hybrid, 9) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM rk WHERE lang = 'fr') WHERE rank <= {TOP_K}"
    ),
    "search_multi_collection_each": _sql_each("lang", f"SELECT query_id, c AS collection_id, doc_id AS chunk_id, rank, round(score, 9) AS score FROM ({_MERGED_EACH})"),
    "search_collection_stats_each": _sql_each(
        "lang",
        f"""SELECT rk.query_id, o.c AS collection_id, count(*) AS retrieved, count(*) FILTER (WHERE rank <= {TOP_K}) AS returned, coalesce(any_value(k.n), 0) AS contributed
FROM {_ORDER} JOIN rk ON rk.c = o.c LEFT JOIN (SELECT query_id, c, count(*) AS n FROM ({_MERGED_EACH}) GROUP BY ALL) k ON k.query_id = rk.query_id AND k.c = o.c GROUP BY rk.query_id, o.c""",
    ),
    "search_provenance_each": _sql_each(
        "lang", f"SELECT query_id, doc_id AS chunk_id, rank, upper(c) AS collection_name, 'Workspace ws_' || c AS workspace_name, 'doc_' || doc_id || '.txt' AS filename FROM ({_MERGED_EACH})"
    ),
    "search_under_delivered_each": _sql_each("'all'", f"SELECT qv.query_id, count(rk.doc_id) < {TOP_K} AS under_delivered FROM qv LEFT JOIN rk ON rk.query_id = qv.query_id AND lang = 'fr' GROUP BY qv.query_id"),
    "search_reranked_each": _sql_each(
        "lang",
        f"""SELECT * FROM (SELECT query_id, c AS collection_id, doc_id AS chunk_id,
  row_number() OVER (PARTITION BY query_id, c ORDER BY (rank > 10)::INT, CASE WHEN rank <= 10 THEN n_chars END NULLS LAST, rank) AS rank FROM rk) WHERE rank <= {TOP_K}""",
    ),
}
