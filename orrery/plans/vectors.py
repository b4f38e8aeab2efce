"""Queries of the vector index and of vectors of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import embedding
from orrery.operators import retrieval as R
from orrery.operators import vector_index as V
from orrery.plans import model
from orrery.sources.shared import stored

K = 20
TARGET = 0.95


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _found(vectors: DataFrame, query: DataFrame, k: int = K) -> DataFrame:
    index = V.build(vectors, V.fit(vectors))
    return V.search(index, query, k, V.probes_for(index, vectors, k, TARGET))


def _each(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("chunk_id") % model.EVERY == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def knn_index_topk_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every row whose id is divisible by 20, by the index over all rows."""
    vectors = _vectors(spark, sf_dir)
    return _found(vectors, _each(vectors)).select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine"), "vec_rank")


def knn_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds nine tenths of the true neighbours of those rows."""
    vectors = _vectors(spark, sf_dir)
    query = _each(vectors)
    exact = R.nearest(vectors.withColumn("collection_id", F.lit("all")), query, K)
    return V.recall(_found(vectors, query), exact).select("queries", "wanted", (F.col("recall") >= 0.9).alias("is_reached"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def planted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): the texts of ids divisible by 20 with every tenth word left out and the rest in reverse order."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w, i: (w != "") & (i % 10 != 9))
    return _texts(spark, sf_dir).where(F.col("chunk_id") % model.EVERY == 0).select(F.col("chunk_id").alias("query_id"), F.array_join(F.reverse(words), " ").alias("text"))


def text_vectors_find_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at least nine tenths of changed texts find their original among ten neighbours by the vectors of texts, through the index."""
    texts = _texts(spark, sf_dir)
    model_ = embedding.fitted(texts)
    vectors = stored(model_.embed(texts).select("chunk_id", "embedding"), "text-vectors")
    query = stored(model_.embed(planted_texts(spark, sf_dir)).where("embedding IS NOT NULL").select("query_id", F.col("embedding").alias("query_vector")), "planted")
    same = texts.select("chunk_id", F.md5("text").alias("m"))  # an exact copy is as good as the original
    found = _found(vectors, query, 10).join(same, "chunk_id").join(same.select(F.col("chunk_id").alias("query_id"), F.col("m").alias("own")), "query_id")
    hits = query.select("query_id").join(found.where("m = own").select("query_id").distinct().withColumn("hit", F.lit(1)), "query_id", "left")
    return hits.agg(F.count("*").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("is_reached"))


QUERIES = {f.__name__: f for f in (knn_index_topk_each, knn_index_recall, text_vectors_find_near_texts)}

SQL = {
    "knn_index_recall": "SELECT count(*) AS queries, count(*) * least(20, (SELECT count(*) FROM embeddings)) AS wanted, true AS is_reached FROM embeddings WHERE vec_id % 20 = 0",
    "text_vectors_find_near_texts": r"SELECT count(*) AS queries, true AS is_reached FROM documents WHERE doc_id % 20 = 0 AND regexp_matches(coalesce(text, ''), '\S')",
}
