from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from orrery.operators import retrieval as R

CORPUS = [("col", "c1", "machine learning python"), ("col", "c2", "cooking recipes dinner"), ("col", "c3", "gardening flowers plants")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "collection_id string, chunk_id string, text string")


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("col", "c1", [1.0, 0.0], "en", ["a", "b"]), ("col", "c2", [0.9, 0.1], "fr", ["a"]), ("col", "c3", [0.0, 1.0], "en", None), ("col", "c4", [0.8, 0.6], "en", [])]
    return spark.createDataFrame(rows, "collection_id string, chunk_id string, embedding array<float>, language string, tags array<string>").withColumn("filename", F.concat("chunk_id", F.lit(".txt")))


def query(spark, text="python", vector=(1.0, 0.0)):
    return spark.createDataFrame([(list(vector), text)], "query_vector array<float>, query_text string")


def plain_bm25(docs, words):
    docs = {k: t.lower().split() for k, t in docs.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for d in docs.values():
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}
    return {k: sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in words) for k, d in docs.items()}


def test_bm25_counts_common_and_repeated_words(spark):
    docs = {"a": "the cat the dog", "b": "the bird", "c": "The  CAT\tsat", "d": "", "e": "the"}
    corpus = spark.createDataFrame([("x", k, t) for k, t in docs.items()], "collection_id string, chunk_id string, text string")
    found = {r.chunk_id: r.bm25 for r in R.bm25(corpus, query(spark, "the cat the unknown")).collect()}
    expected = plain_bm25(docs, "the cat the unknown".split())
    assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k]) for k in expected)


def test_scores_of_many_queries_are_never_shuffled(spark, monkeypatch):
    for name, value in (("CARD", 3), ("STRIP", 2)):
        monkeypatch.setattr(R, name, value, raising=False)
    docs = {i: " ".join(f"w{(i * k) % 11}" for k in range(1, i % 9)) or None for i in range(30)}
    corpus = spark.createDataFrame([("x" if i % 2 else "y", i, t) for i, t in docs.items()], "collection_id string, chunk_id long, text string")
    asked = {i: docs[i] for i in range(0, 30, 4)} | {100: "w1 w1 nothing"}
    found = R.bm25(corpus, spark.createDataFrame(list(asked.items()), "query_id long, query_text string"))
    got = {(r.query_id, r.chunk_id): r.bm25 for r in found.collect()}
    assert len(got) == found.count() == len(docs) * len(asked)
    for q, text in asked.items():
        for odd in (0, 1):
            want = plain_bm25({i: t or "" for i, t in docs.items() if i % 2 == odd}, (text or "").split())
            assert all(got[q, i] == pytest.approx(want[i]) for i in want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_words_that_all_pairs_share_are_not_worked_out_pair_by_pair(spark, monkeypatch):
    docs = {i: "the of and " + " ".join(f"w{(i * k) % 13}" for k in range(1, i % 7)) for i in range(200)}
    corpus = spark.createDataFrame([("x", i, t) for i, t in docs.items()], "collection_id string, chunk_id long, text string").coalesce(1)
    asked = corpus.select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query_text"))
    captured, kept = [], type(corpus).mapInArrow
    monkeypatch.setattr(type(corpus), "mapInArrow", lambda self, f, *a, **b: captured.append((self, f)) or kept(self, f, *a, **b))
    R.bm25(corpus, asked)
    pairs, score = captured[-1]  # the last step, which gives the scores
    added, count = [], R.np.bincount
    batches = pairs.toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(R.np, "bincount", lambda x, *a, **b: added.append(len(x)) or count(x, *a, **b))
    for few in (500, 1, 0):  # few shared words are columns; all but those of all pairs; none
        monkeypatch.setattr(R, "DENSE", few, raising=False)
        monkeypatch.setattr(R, "HITS", 1000, raising=False)
        monkeypatch.setattr(R, "COLUMNS", 2, raising=False)
        added.clear()
        got = {(q, i): x for b in score(iter(batches)) for q, i, x in zip(b["query_id"].to_pylist(), b["chunk_id"].to_pylist(), b["bm25"].to_pylist(), strict=True)}
        assert len(got) == 200 * 200
        if few == 500:
            assert sum(added) <= 2 * sum(len(set(t.split())) for t in docs.values()) * len(batches[0])
        for q in (0, 6, 199):
            want = plain_bm25(docs, docs[q].split())
            assert all(got[q, i] == pytest.approx(want[i]) for i in want)


def test_words_of_texts_are_rows_only_if_there_are_too_many_weights_or_a_chunk_is_there_twice(spark, monkeypatch):
    monkeypatch.setattr(R, "COUNTED", 60, raising=False)
    monkeypatch.setattr(R, "CARD", 3, raising=False)
    docs = [("xyz"[i % 3], i, " ".join(f"w{(i * k) % 11}" for k in range(1, i % 9)) or None) for i in range(30)] + [(None, 30, "w1 w2"), ("x", 31, "ẞ É \x1cw1\u0085 w1")]
    corpus = spark.createDataFrame(docs, "collection_id string, chunk_id long, text string").repartition(2)
    asked = spark.createDataFrame([(0, "w1 w1 W3 nothing"), (1, None), (2, "w2 ß é"), (3, docs[8][2])], "query_id long, query_text string")
    cut, kept = [], R._said
    monkeypatch.setattr(R, "_said", lambda rows: cut.append(1) or kept(rows))
    scores = lambda rows: {(r.query_id, r.collection_id, r.chunk_id): r.bm25 for r in R.bm25(rows, asked).collect()}
    sent = scores(corpus)
    assert not cut and len(sent) == 32 * 4 and any(sent.values()) and sent[0, None, 30] == 0.0
    monkeypatch.setattr(R, "WEIGHTS", -1, raising=False)
    joined = scores(corpus)
    assert cut and joined.keys() == sent.keys() and all(joined[k] == pytest.approx(sent[k]) for k in sent)
    monkeypatch.setattr(R, "WEIGHTS", 1 << 20, raising=False)
    cut.clear()
    assert R.bm25(corpus.union(corpus.where("chunk_id = 8")), asked).count() == 33 * 4 and cut


def test_blank_corpus_scores_zero(spark):
    corpus = spark.createDataFrame([("x", "a", " "), ("x", "b", None)], "collection_id string, chunk_id string, text string")
    assert {r.bm25 for r in R.bm25(corpus, query(spark)).collect()} == {0.0}


def test_candidates_come_from_vectors_only(spark, chunks, corpus):
    found = {r.chunk_id: r for r in R.search(chunks, corpus, query(spark), top_k=5).collect()}
    assert set(found) == {"c1", "c2", "c3", "c4"}
    assert found["c4"].bm25 == 0.0 and found["c4"].bm25_rank == 3  # not in the corpus, ranked behind c2 by vector order
    fused = found["c1"].fused
    assert fused == pytest.approx(0.7 / 61 + 0.3 / 61)
    assert max(r.fused for r in found.values()) <= 1 / 61
    assert sorted(r["rank"] for r in found.values()) == [1, 2, 3, 4]


def test_bm25_mode_lifts_the_match(spark, chunks, corpus):
    ranked = R.search(chunks, corpus, query(spark, "python", (0.0, 1.0)), mode="bm25")
    assert ranked.where("rank = 1").first().chunk_id == "c1"
    assert R.search(chunks, corpus, query(spark, "python", (0.0, 1.0)), mode="semantic").where("rank = 1").first().chunk_id == "c3"


def test_filters_come_after_ranking(spark, chunks, corpus):
    ranked = R.search(chunks, corpus, query(spark), top_k=1, fan_out=2)
    assert ranked.count() == 2
    assert R.collection_results(ranked, 1, {"language": "fr"}).first().chunk_id == "c2"
    assert R.collection_results(ranked, 1, {"tags": ["a", "b"]}).first().chunk_id == "c1"
    assert R.collection_results(ranked, 1, {"filename": "c3.txt"}).count() == 0  # under-delivers
    assert R.collection_results(ranked, 5, {}).count() == 2
    assert R.collection_results(R.search(chunks, corpus, query(spark)), 5, {"tags": []}).count() == 4


def test_fusion_of_lists(spark):
    s = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, rank int")
    b = spark.createDataFrame([("c", 1), ("b", 2)], "chunk_id string, rank int")
    out = {r.chunk_id: r for r in R.fuse_lists(s, b, 0.5).collect()}
    assert out["b"]["rank"] == 1 and out["b"].score == pytest.approx(0.5 / 62 * 2)
    assert out["c"]["rank"] == 2 and out["a"]["rank"] == 3  # equal scores: by the lexical list


def test_merge_keeps_request_order_and_duplicates(spark):
    rows = [("x", "k", 1), ("y", "k", 1), ("x", "m", 2)]
    results = spark.createDataFrame(rows, "collection_id string, chunk_id string, rank int")
    request = spark.createDataFrame([(1, "x"), (0, "y")], "ordinal int, collection_id string")
    out = R.merged(results, request, 5).collect()
    assert [(r.collection_id, r.chunk_id) for r in out] == [("y", "k"), ("x", "k"), ("x", "m")]
    assert out[0].score == pytest.approx(1 / 61)
    stats = {r.collection_id: r for r in R.collection_stats(results, results.where("rank = 1"), R.merged(results, request, 1)).collect()}
    assert (stats["x"].retrieved, stats["x"].returned, stats["x"].contributed) == (2, 1, 0)


def test_reranker_orders_the_head_only(spark):
    rows = [("x", i, i, float(i)) for i in range(1, 6)]
    ranked = spark.createDataFrame(rows, "collection_id string, chunk_id int, rank int, s double")
    out = sorted((r["rank"], r.chunk_id) for r in R.reranked(ranked, F.col("s"), 3).collect())
    assert [c for _, c in out] == [3, 2, 1, 4, 5]


def test_limits_and_modes(spark, corpus):
    assert R.pool_size(5) == 20 and R.pool_size(5, 99) == 50 and R.pool_size(5, 0) == 5
    for bad in ({"top_k": 0}, {"top_k": 21}, {"alpha": 1.5}, {"collections": []}):
        with pytest.raises(ValueError):
            R.check_request(**bad)
    assert R.search_mode(None, False) == "semantic" and R.search_mode("bm25", True) == "bm25"
    request = spark.createDataFrame([("col",), ("empty",)], "collection_id string")
    assert R.effective_mode("hybrid", corpus, request).first().mode == "semantic_only"
    assert R.effective_mode("hybrid", corpus, request.where("collection_id = 'col'")).first().mode == "hybrid"


def test_plan_limits_before_the_shuffle(spark, chunks, corpus):
    plan = R.nearest(chunks, query(spark).select("query_vector"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_several_queries_are_all_answered(spark, chunks, corpus):
    asked = {1: ("python", (1.0, 0.0)), 2: ("cooking the cooking", (0.0, 1.0)), 3: (None, (0.0, 0.0)), 4: ("dinner", (1.0, 0.0, 0.0))}
    queries = spark.createDataFrame([(i, list(v), t) for i, (t, v) in asked.items()], "query_id long, query_vector array<float>, query_text string")
    columns = ["chunk_id", "vec_rank", "bm25_rank", "fused", "rank"]
    for mode in ("hybrid", "bm25"):
        found = R.collection_results(R.search(chunks, corpus, queries, mode=mode, top_k=1, fan_out=3), 3)
        for i, (text, vector) in asked.items():
            one = R.collection_results(R.search(chunks, corpus, query(spark, text or "", vector), mode=mode, top_k=1, fan_out=3), 3)
            expected = sorted(tuple(r) for r in one.select(*columns).collect())
            assert len(expected) == 3 and sorted(tuple(r) for r in found.where(f"query_id = {i}").select(*columns).collect()) == expected
    scores = {(r.query_id, r.chunk_id): r.bm25 for r in R.bm25(corpus, queries).collect()}
    assert len(scores) == 12 and scores[1, "c1"] > 0 and scores[2, "c2"] > scores[2, "c1"] == 0.0
    request = spark.createDataFrame([(0, "col")], "ordinal int, collection_id string")
    assert R.merged(found, request, 2).groupBy("query_id").count().where("count = 2").count() == 4
    assert {r.query_id: r.under_delivered for r in R.under_delivered(found.where("query_id > 1"), 3, queries).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_several_queries_without_ids_are_an_error(spark, chunks, corpus):
    two = query(spark).union(query(spark, "dinner", (0.0, 1.0)))
    with pytest.raises(ValueError, match="query_id"):
        R.nearest(chunks, two, 2)
    with pytest.raises(Exception, match="query_id"):
        R.bm25(corpus, two).collect()


def test_blocks_of_queries_and_ties(spark, chunks, monkeypatch):
    monkeypatch.setattr(R, "QUERIES", 2)
    same = spark.createDataFrame([("x", i, [1.0, 1.0]) for i in range(50, 0, -1)], "collection_id string, chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "query_id long, query_vector array<float>")
    found = sorted((r.query_id, r.vec_rank, r.chunk_id) for r in R.nearest(same, queries, 3).collect())
    assert found == [(q, n, n) for q in range(5) for n in (1, 2, 3)]


def test_a_task_sends_on_the_best_of_all_its_rows(spark, monkeypatch):
    """Rows without direction, ties over tasks, several collections, bounds in single precision: as all pairs by hand."""
    import numpy as np

    rng = np.random.default_rng(5)
    data = [("ab"[i % 2] if i % 7 else None, i, [float(x) for x in rng.integers(-2, 3, 8)]) for i in range(3000)]
    data += [("a", 3001, None), ("b", 3002, [0.0] * 8), ("c", 3003, [1.0] * 8), ("c", 3004, [0.0] * 8), ("c", 3005, [1.0])]
    rows = spark.createDataFrame(data, "collection_id string, chunk_id long, embedding array<float>").repartition(5)
    vectors = {i: rng.normal(size=8).astype(np.float32).tolist() if i % 3 else [float(x) for x in rng.integers(-2, 3, 8)] for i in range(40)}
    queries = spark.createDataFrame(list(vectors.items()), "query_id long, query_vector array<float>")
    for name, value in (("BLOCK", 16), ("KEPT", 50), ("HEAD", 32), ("STATE", 500)):
        monkeypatch.setattr(R, name, value, raising=False)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = R.nearest(rows, queries, 5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {}
    for r in found:
        got.setdefault((r.query_id, r.collection_id), {})[r.vec_rank] = (r.chunk_id, r.cosine)
    for q, v in vectors.items():
        v = np.array(v, float)
        for c in ("a", "b", "c", None):
            scored = []
            for own, i, e in data:
                if own == c:
                    e = np.array(e if e is not None else [], float)
                    norm = np.linalg.norm(v) * np.linalg.norm(e)
                    scored.append((1, 0, i, None) if len(e) != 8 or norm == 0 else (0, -round(float(v @ e / norm), 9), i, float(v @ e / norm)))
            want = sorted(scored, key=lambda x: x[:3])[:5]
            mine = got[q, c]
            assert [mine[n + 1][0] for n in range(len(want))] == [w[2] for w in want] and len(mine) == len(want)
            assert all(w[3] is None and mine[n + 1][1] is None or mine[n + 1][1] == pytest.approx(w[3]) for n, w in enumerate(want))


def test_what_many_queries_send_on_does_not_grow_with_the_chunks(spark, monkeypatch):
    """Rows that come to the window: at most k for each query and task, however many batches a task has."""
    rows = spark.range(20_000).select(F.lit("x").alias("collection_id"), F.col("id").alias("chunk_id"), F.array(F.cos("id").cast("float"), F.sin("id").cast("float")).alias("embedding"))
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.array(F.sin("id").cast("float"), F.cos("id").cast("float")).alias("query_vector"))
    sent = []
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    kept = type(rows).withColumn
    monkeypatch.setattr(type(rows), "withColumn", lambda self, name, c: (sent.append(self.count()) if name == "vec_rank" else None) or kept(self, name, c))
    try:
        assert R.nearest(rows, queries, 5).count() == 1500
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert max(sent) <= 300 * 5 * spark.sparkContext.defaultParallelism


def test_words_are_cut_once_and_only_of_the_texts_that_are_asked_for(spark, monkeypatch):
    monkeypatch.setattr(R, "COUNTED", 40, raising=False)
    texts = [None, "", " \t\n", "A b\x0ba\x0cB c\r\nC", "É é x y \x1cz\x85 é é", "ẞ İ Σας " * 20, *(f"w{i % 7} w{i % 3} W{i % 7}" for i in range(40))]
    corpus = spark.createDataFrame([("x" if i % 3 else None, i, t) for i, t in enumerate(texts)], "collection_id string, chunk_id long, text string")
    cut = {r.chunk_id: (r.collection_id, r.w) for r in corpus.select("collection_id", "chunk_id", R.tokens(F.col("text")).alias("w")).collect()}
    got = {(r.collection_id, r.term): (r.df, r.words) for r in R.corpus_statistics(corpus).collect()}
    want = {}
    for name, words in cut.values():
        for term in {None, *words}:
            df, n = want.get((name, term), (0, 0))
            want[name, term] = df + 1, n + (len(words) if term is None else 0)
    assert got == want
    said = {(r.collection_id, r.chunk_id, r.dl, r.term, r.tf) for r in R.postings(corpus).collect()}
    assert said == {(name, i, len(words), t, words.count(t)) for i, (name, words) in cut.items() for t in words}
    # as an expression under explode, Spark would cut all texts once more in a filter below the join
    plan = R.postings(corpus.join(corpus.select("chunk_id").limit(1), "chunk_id", "left_semi"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_a_chunk_that_is_there_twice_counts_as_in_sql(spark):
    corpus = spark.createDataFrame([("x", 1, "a a b"), ("x", 1, "a c c"), ("x", 2, "a d"), ("x", 3, "e f g h")], "collection_id string, chunk_id long, text string")
    asked = spark.createDataFrame([(1, "a a c"), (2, "zz")], "query_id long, query_text string")
    pairs = spark.createDataFrame([(q, "x", c) for q in (1, 2) for c in (1, 2, 3)], "query_id long, collection_id string, chunk_id long")
    whole = {(r.query_id, r.chunk_id): r.bm25 for r in R.bm25(corpus, asked).collect()}
    found = {(r.query_id, r.chunk_id): r.bm25 for r in R.bm25_of_pairs(corpus, asked, pairs).collect()}
    assert found and all(found[k] == pytest.approx(whole[k]) for k in found) and all(abs(whole[k]) < 1e-12 for k in whole.keys() - found.keys())
    idf = {r.term: r.idf for r in R.inverse_frequencies(R.document_frequencies(R.corpus_statistics(corpus)), R.corpus_sizes(R.corpus_statistics(corpus))).collect()}
    share = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 3))
    assert found[1, 1] == pytest.approx(2 * idf["a"] * share(3, 3) + idf["c"] * share(2, 3))
