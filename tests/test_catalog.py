from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.operators import catalog as C
from orrery.operators import mutations as M
from orrery.operators import tags as T


@pytest.fixture(scope="module")
def documents(spark):
    rows = [("d1", "c1", "w1", None), ("d2", "c1", "w1", None), ("d3", "c1", "w1", None), ("d4", "c2", "w1", "deleting")]
    return spark.createDataFrame(rows, "document_id string, collection_id string, workspace_id string, status string").withColumn("filename", F.col("document_id"))


@pytest.fixture(scope="module")
def collections(spark):
    return spark.createDataFrame([("c1", "w1"), ("c2", "w1")], "collection_id string, workspace_id string")


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [("j1", "d1", "done", "2024-01-01"), ("j2", "d1", "failed", "2024-02-01"), ("j3", "d2", "pending", "2024-01-01"), ("j4", "d2", "done", "2024-01-01")]
    return spark.createDataFrame(rows, "job_id string, document_id string, status string, created_at string")


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame([("t1", "w1", "alpha", "#1"), ("t2", "w1", "beta", "#2"), ("t3", "w1", "gamma", "#3"), ("t4", "w1", "unused", "#4")], "tag_id string, workspace_id string, name string, color string")


def links(spark, *rows):
    return spark.createDataFrame(list(rows), "entity_id string, tag_id string")


def test_counts_keep_empty_groups(spark, documents, collections):
    assert {r.collection_id: r.document_count for r in C.collections_with_counts(collections, documents).collect()} == {"c1": 3, "c2": 0}
    workspaces = spark.createDataFrame([("w1",), ("w2",)], "workspace_id string")
    assert {r.workspace_id: r.collection_count for r in C.workspaces_with_counts(workspaces, collections).collect()} == {"w1": 2, "w2": 0}
    tree = {r.workspace_id: r for r in C.workspace_tree(workspaces, collections, documents).collect()}
    assert tree["w1"].document_count == 3 and tree["w2"].document_count == 0 and [c.collection_id for c in tree["w1"].collections] == ["c1", "c2"]


def test_latest_job_and_index_status(spark, documents, jobs):
    assert {r.document_id: r.job_id for r in C.latest_jobs(jobs).collect()} == {"d1": "j2", "d2": "j4"}
    corpus = spark.createDataFrame([("d1",), ("d1",)], "document_id string")
    status = C.index_status(documents, jobs, corpus).first()
    assert (status.total, status.indexed, status.unindexed, status.pending, status.failed) == (3, 1, 2, 0, 1)
    assert {r.document_id: r.indexed for r in C.with_indexed_flag(documents, corpus).collect()}["d2"] is False


def test_effective_tags_join_all_levels(spark, documents, tags):
    out = {r.document_id: r.tags for r in T.effective_tags(documents, tags, links(spark, ("w1", "t1")), links(spark, ("c1", "t2")), links(spark, ("d1", "t3"), ("d1", "t2"))).collect()}
    assert out == {"d1": ["alpha", "beta", "gamma"], "d2": ["alpha", "beta"], "d3": ["alpha", "beta"], "d4": ["alpha"]}


def test_tag_matching_usage_and_items(spark, documents, collections, tags):
    dt = links(spark, ("d1", "t1"), ("d1", "t2"), ("d2", "t1"), ("d4", "t1"))
    assert [r.entity_id for r in T.with_all_tags(dt, tags, [" ALPHA ", "beta", "alpha"]).collect()] == ["d1"]
    assert {r.entity_id for r in T.with_all_tags(dt, tags, ["alpha"]).collect()} == {"d1", "d2", "d4"}
    usage = {r.name: (r.workspace_count, r.collection_count, r.document_count) for r in T.usage_counts(tags, links(spark, ("w1", "t1")), links(spark, ("c1", "t1")), dt).collect()}
    assert usage["alpha"] == (1, 1, 3) and usage["unused"] == (0, 0, 0)
    items = {(r.kind, r.id) for r in T.tag_items("t1", collections, documents, links(spark, ("c1", "t1")), dt).collect()}
    assert items == {("collection", "c1"), ("document", "d1"), ("document", "d2")}
    assert [x.name for x in T.tags_by_entity(dt, tags).where("entity_id = 'd1'").first().tags] == ["alpha", "beta"]


def test_merge_drops_doubles(spark):
    out = T.merge_tags(links(spark, ("c1", "src"), ("c1", "dst"), ("c2", "src")), "src", "dst").collect()
    assert Counter((r.entity_id, r.tag_id) for r in out) == {("c1", "dst"): 1, ("c2", "dst"): 1}


def test_graph(spark, documents, tags):
    dt = links(spark, ("d1", "t1"), ("d2", "t1"), ("d3", "t1"), ("d4", "t1"), ("d1", "t2"))
    nodes = {r.id: r for r in T.graph_nodes(documents, tags, dt).collect()}
    assert nodes["t1"].heat == 3 and nodes["t1"].heat_pct == 1.0 and nodes["t2"].heat_pct == pytest.approx(1 / 3)
    assert nodes["d1"].degree == 2 and nodes["d1"].heat == 0 and "d4" not in nodes and "t4" not in nodes
    assert {r.kind for r in T.graph_nodes(documents, tags, dt, ["other"]).collect()} == {"file"}
    assert {r.id: r.neighbours for r in T.neighbours(T.graph_edges(documents, dt)).collect()} == {"d1": 2, "d2": 1, "d3": 1, "t1": 3, "t2": 1}


def test_suggestions(spark):
    replies = [
        (1, 'Sure! [{"name": " Deep  Learning", "confidence": 0.9}, {"name": "x", "confidence": "high"}, {"name": "deep learning", "confidence": 0.1}]'),
        (2, '["One", "two", "ONE"]'),
        (3, "first, second\nthird"),
        (4, ""),
    ]
    found = {}
    for r in T.parse_suggestions(spark.createDataFrame(replies, "id int, reply string")).collect():
        found.setdefault(r.id, {})[r["name"]] = r.confidence
    assert found[1] == {"deep learning": 0.9, "x": 0.0}
    assert found[2] == {"one": 0.95, "two": 0.88} and found[3] == {"first": 0.95, "second": 0.88, "third": 0.81} and 4 not in found
    many = spark.createDataFrame([(1, ", ".join(f"t{i}" for i in range(20)))], "id int, reply string")
    assert T.parse_suggestions(many).count() == 8
    existing = spark.createDataFrame([(3, " SECOND ")], "id int, name string")
    ranked = T.rank_suggestions(T.parse_suggestions(spark.createDataFrame(replies, "id int, reply string")), existing, 0.81)
    assert sorted((r["rank"], r["name"]) for r in ranked.where("id = 3").collect()) == [(1, "first"), (2, "third")]


def test_acknowledgements(spark):
    acks = spark.createDataFrame([("v1", "a", "ok"), ("v1", "b", "ok"), ("v2", "a", "ok"), ("v3", "a", "boom")], "version_id string, worker string, result string")
    expected = spark.createDataFrame([("v1", "ok", 2), ("v2", "ok", 2), ("v3", "ok", 2), ("v4", "bad", 0), ("v5", None, 0)], "version_id string, api string, workers int")
    assert {r.version_id: r.status for r in C.acknowledgements(acks, expected).collect()} == {"v1": "applied", "v2": "pending", "v3": "error", "v4": "error", "v5": "applied"}


def test_mutations(spark, documents, collections, jobs):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 3), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in M.upsert(rows, new, "k").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in M.upsert(rows, new.limit(0), "k").collect()} == {("a", 1), ("b", 2)}
    table, conflicts = M.insert_unique(rows, new, ["k"])
    assert table.count() == 3 and {r.k for r in conflicts.collect()} == {"b"}
    assert {tuple(r) for r in M.update(rows, "k", spark.createDataFrame([("a", None), ("b", 9)], "k string, v int"), ["v"]).collect()} == {("a", 1), ("b", 9)}
    one = links(spark, ("d1", "t1"))
    assert M.assign(one, one).count() == 1 and M.unassign(one, one).count() == 0
    made = M.get_or_create(spark.createDataFrame([("t", "w", "x")], "tag_id string, workspace_id string, name string"), spark.createDataFrame([("w", "x"), ("w", "y"), ("w", "y")], "workspace_id string, name string"))
    assert sorted(r["name"] for r in made.collect()) == ["x", "y"]
    with pytest.raises(Exception, match="no counterpart"):
        M.with_vectors(rows.withColumnRenamed("k", "chunk_id"), spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<double>")).collect()


def test_deletes_cascade(spark, documents, collections, jobs):
    gone = M.soft_delete(documents, F.col("document_id") == "d1")
    chunks = documents.select("document_id", "collection_id")
    left = M.hard_delete(gone, chunks, chunks, jobs)
    assert {r.document_id for r in left["documents"].collect()} == {"d2", "d3"} and {r.document_id for r in left["jobs"].collect()} == {"d2"}
    tables = {"collections": collections, "documents": documents, "links": links(spark, ("d1", "t1"), ("d4", "t1"))}
    chain = [("collections", "collection_id", "documents", "collection_id"), ("documents", "document_id", "links", "entity_id")]
    out = M.delete_cascading(tables, collections.where("collection_id = 'c2'"), "collection_id", chain)
    assert out["collections"].count() == 1 and out["documents"].count() == 3 and [r.entity_id for r in out["links"].collect()] == ["d1"]
    fresh = M.reindex(chunks.limit(0), chunks, documents, collections)
    assert {r.document_id for r in fresh.collect()} == {"d1", "d2", "d3"}
    one = M.reindex_document(chunks.unionByName(chunks), chunks, "d1")
    assert Counter(r.document_id for r in one.collect()) == {"d1": 1, "d2": 2, "d3": 2, "d4": 2}
    tagged = M.set_document_tags(chunks.withColumn("tags", F.array(F.lit("old"))), spark.createDataFrame([("d1", ["new"])], "document_id string, tags array<string>"))
    assert {r.document_id: r.tags for r in tagged.collect()}["d1"] == ["new"]
    assert {r.document_id: r.tags for r in tagged.collect()}["d2"] == ["old"]
    assert M.set_job_status(jobs, spark.createDataFrame([("j1", "processing")], "job_id string, status string")).where("job_id = 'j1'").first().status == "processing"
