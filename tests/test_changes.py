"""Changes of the catalogue and listings, on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orrery.operators import catalog as C
from orrery.operators import mutations as M
from orrery.operators import retrieval as R
from orrery.operators import tags as T

TAG = "workspace_id string, name string, tag_id string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_conflicts_inside_the_new_rows_are_reported(spark):
    old = spark.createDataFrame([("w", "a", "t1")], TAG)
    new = spark.createDataFrame([("w", "a", "n1"), ("w", "b", "n3"), ("w", "b", "n2"), ("w", "b", "n2"), ("v", "a", "n4"), (None, "a", "n5")], TAG)
    table, conflicts = M.insert_unique(old, new, ["workspace_id", "name"], ["tag_id"])
    assert rows_of(table) == sorted([("w", "a", "t1"), ("w", "b", "n2"), ("v", "a", "n4"), (None, "a", "n5")], key=repr)
    assert rows_of(conflicts) == [("w", "a", "n1", "exists"), ("w", "b", "n2", "repeated"), ("w", "b", "n3", "repeated")]


def test_upsert_takes_the_last_of_conflicting_rows(spark):
    old = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "b", 5), (1, "z", 3), (3, "c", 1), (3, "d", 1), (3, "d", 1)], "k int, v string, at int")
    assert rows_of(M.upsert(old, new, "k", ["at"])) == [(1, "b", 5), (2, "y", 0), (3, "d", 1)]
    assert rows_of(M.upsert(old.limit(0), new.limit(0), "k")) == []


def test_a_merged_tag_is_gone_and_links_once(spark):
    tags = spark.createDataFrame([("w", "a", "t1"), ("w", "b", "t2")], TAG)
    links = spark.createDataFrame([("d1", "t1"), ("d1", "t2"), ("d2", "t1")], "entity_id string, tag_id string")
    left, moved = M.merge_tag(tags, {"document": links}, "t1", "t2")
    assert rows_of(left) == [("w", "b", "t2")] and rows_of(moved["document"]) == [("d1", "t2"), ("d2", "t2")]
    with pytest.raises(ValueError):
        M.merge_tag(tags, {}, "t1", "t1")


def test_only_collections_that_lost_their_last_document_are_dropped(spark):
    collections = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "collection_id string")
    documents = spark.createDataFrame([("d1", "c1"), ("d2", "c1"), ("d3", "c2")], "document_id string, collection_id string")
    gone = documents.where("document_id IN ('d1', 'd3')")
    assert rows_of(M.emptied(collections, M.delete(documents, gone, "document_id"), gone)) == [("c2",)]  # c3 was empty before


def test_listings_have_positions(spark):
    rows = spark.createDataFrame([("w", "b", 1), ("w", "a", 2), ("v", "c", 0)], "workspace_id string, id string, created_at int")
    assert rows_of(C.listing(rows, F.desc("created_at"), F.col("id")).select("id", "position")) == [("a", 1), ("b", 2), ("c", 3)]
    assert rows_of(C.listing(rows, F.col("id"), within="workspace_id").select("id", "position")) == [("a", 1), ("b", 2), ("c", 1)]


def test_tag_counts_by_name(spark):
    edges = spark.createDataFrame([("d1", "t1"), ("d2", "t1"), ("d1", "t1"), ("d1", "t2"), ("d1", "t3")], "source string, target string")
    tags = spark.createDataFrame([("w", "a", "t1"), ("w", "b", "t2"), ("w", "b", "t3"), ("w", "c", "t4")], TAG)
    found = T.tag_count_map(T.tag_counts(edges, tags)).first()
    assert found.tag_counts == {"a": 2, "b": 1} and found.max_heat == 2


def test_fused_lists_of_many_queries(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id int, chunk_id int, rank int")
    two = spark.createDataFrame([(1, 11, 1), (2, 12, 1)], "query_id int, chunk_id int, rank int")
    got = {(r.query_id, r.chunk_id): r.rank for r in R.fuse_lists(one, two, 0.5).collect()}
    assert got == {(1, 11): 1, (1, 10): 2, (2, 12): 1, (2, 10): 2}
