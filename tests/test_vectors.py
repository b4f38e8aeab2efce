"""The vector index and vectors of texts, against brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from orrery.functions import embedding
from orrery.operators import retrieval as R
from orrery.operators import vector_index as V

ROW = "chunk_id long, embedding array<float>"


def clustered(spark, n=600, width=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=width)).astype("float32").tolist()) for i in range(n)]
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * width), (n + 3, [1.0, None] + [0.0] * (width - 2)), (n + 4, rows[7][1]), (n + 5, rows[7][1])]
    return spark.createDataFrame(rows + odd, ROW)


def queries_of(rows):
    return rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def test_all_cells_give_the_exact_answer(spark):
    rows = clustered(spark)
    index = V.build(rows, V.fit(rows, cells=7), block=50)
    found = V.search(index, queries_of(rows).where("query_id < 600"), 5, 7)
    exact = R.nearest(rows.where("chunk_id < 600 OR chunk_id > 603").withColumn("collection_id", F.lit(0)), queries_of(rows).where("query_id < 600"), 5)
    key = lambda r: (r.query_id, r.vec_rank, r.chunk_id, round(r.cosine, 5))
    assert sorted(map(key, found.collect())) == sorted(map(key, exact.collect()))
    table = spark.read.parquet(index.path)
    assert table.count() == 602 and table.groupBy("cell", "block").count().agg(F.max("count")).first()[0] <= 100


def test_few_probes_reach_the_recall_they_were_chosen_for(spark):
    rows = clustered(spark)
    query = queries_of(rows).where("query_id < 600")
    index = V.build(rows, V.fit(rows, cells=12))
    probes = V.probes_for(index, rows, 5, 0.95)
    assert probes < 12
    exact = R.nearest(rows.withColumn("collection_id", F.lit(0)), query, 5)
    assert V.recall(V.search(index, query, 5, probes), exact).first()["recall"] >= 0.9


def test_empty_vectors(spark):
    none = clustered(spark).where("chunk_id BETWEEN 600 AND 601")
    index = V.build(none, V.fit(none))
    assert V.search(index, queries_of(clustered(spark)), 5, 3).count() == 0


def test_text_vectors_are_alike_everywhere(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(500)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(80)] + [(80, None), (81, " "), (82, "word1")]
    rows = spark.createDataFrame(texts, "chunk_id long, text string")
    model = embedding.fitted(rows)
    once = {r.chunk_id: r.embedding for r in model.embed(rows.repartition(5)).collect()}
    again = {r.chunk_id: r.embedding for r in embedding.fitted(rows.repartition(3)).embed(rows.coalesce(1)).collect()}
    assert once == again and once[80] is None and once[81] is None
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in once.values() if v)
    changed = spark.createDataFrame([(i, " ".join(t.split()[::-1][3:])) for i, t in texts[:80]], "query_id long, text string")
    query = model.embed(changed).select("query_id", F.col("embedding").alias("query_vector"))
    found = R.nearest(model.embed(rows).select("chunk_id", "embedding").withColumn("collection_id", F.lit(0)), query, 1)
    assert all(r.chunk_id == r.query_id for r in found.collect())


def test_aiming_makes_few_rows_at_a_time(spark, monkeypatch):
    """However many queries an Arrow batch has, a query's vector is repeated for its probes for a few queries at a time."""
    rows = clustered(spark)
    index, query, captured, kept = V.build(rows, V.fit(rows, cells=12)), queries_of(rows), [], type(rows).mapInArrow
    monkeypatch.setattr(V, "AIMED", 24, raising=False)
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, *a, **b: captured.append(f) or kept(self, f, *a, **b))
    V.search(index, query, 5, 12)
    batch = V.pa.RecordBatch.from_arrays([V.pa.array(range(100)), V.pa.array([[1.0] * index.centroids.shape[1]] * 100, V.pa.list_(V.pa.float32()))], ["query_id", "query_vector"])
    made = [b.num_rows for b in captured[0](iter([batch]))]
    assert sum(made) == 1200 and max(made) <= 24


def test_a_search_sends_on_no_vectors_and_k_rows_of_a_query_and_task(spark, monkeypatch):
    """However many cells a query looks into, and however the queries are sent; copies in several blocks go by their ids."""
    for name, value in (("VALUES", 80), ("PACKED", 7), ("RUN", 4), ("KEPT", 5)):
        monkeypatch.setattr(V, name, value, raising=False)
    plain = clustered(spark).where("chunk_id < 600")
    copies = plain.where("chunk_id < 12").crossJoin(spark.range(1000, 1900, 100)).select((F.col("chunk_id") + F.col("id")).alias("chunk_id"), "embedding")
    rows = plain.union(copies).select(F.concat(F.lit("c"), F.col("chunk_id")).alias("chunk_id"), "embedding").repartition(3)
    query = queries_of(plain).union(spark.createDataFrame([(900, None), (901, [0.0] * 8)], "query_id long, query_vector array<float>")).repartition(2)
    index = V.build(rows, V.fit(rows, cells=12), block=20)
    sent, kept = [], type(rows).withColumn
    monkeypatch.setattr(type(rows), "withColumn", lambda self, name, c: (sent.append(self.count()) if name == "vec_rank" else None) or kept(self, name, c))
    found = V.search(index, query, 3, 12)
    exact = R.nearest(rows.withColumn("collection_id", F.lit(0)), query.where("query_id < 900"), 3)
    key = lambda r: (r.query_id, r.vec_rank, r.chunk_id, round(r.cosine, 5))
    assert sorted(map(key, found.collect())) == sorted(map(key, exact.collect()))
    assert sent[0] <= 30 * 3 * spark.sparkContext.defaultParallelism
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
