"""Expiring topics, configuration versions, propagated tags, kept statistics."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.operators import index, reload, tag_sync
from orrery.operators import mutations as M
from orrery.operators import retrieval as R
from orrery.operators import tags as T
from orrery.sources import tables
from orrery.streaming import topics

EVENT = "key string, ts timestamp, event_id long, payload string"


def at(minute):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def put(spark, path, rows):
    made = spark.createDataFrame([(k, at(m), i, p) for k, m, i, p in rows], "key string, t string, event_id long, payload string")
    made.select("key", F.col("t").cast("timestamp").alias("ts"), "event_id", "payload").coalesce(1).write.mode("append").parquet(path)


def test_topics_expire_survive_a_restart_and_ignore_the_late(spark, tmp_path):
    inbox, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run():
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(inbox)
        return {r.key: r.payload for r in topics.snapshot(topics.run_to_end(spark, topics.latest_with_expiry(stream, 3600, "10 minutes"), out, check)).collect()}

    put(spark, inbox, [("a", 5, 1, "a1"), ("b", 0, 2, "b1"), ("a", 5, 3, "a2"), ("a", 2, 9, "old")])
    assert run() == {"a": "a2", "b": "b1"}
    put(spark, inbox, [("b", 40, 4, "b2"), ("a", 4, 5, "late")])  # the stream starts anew; a late event changes nothing
    assert run() == {"a": "a2", "b": "b2"}
    put(spark, inbox, [("c", 80, 6, "c1")])  # 80 - 10 is past 5 + 60
    assert run() == {"b": "b2", "c": "c1"}
    put(spark, inbox, [("a", 85, 7, "a3")])  # a key comes back after its expiry
    assert run() == {"a": "a3", "b": "b2", "c": "c1"}
    kinds = Counter((r.key, r.kind) for r in spark.read.parquet(out).collect())
    assert kinds[("a", "expired")] == 1 and kinds[("a", "set")] == 2 and kinds[("b", "set")] == 2


def test_a_renewed_event_leaves_the_timer_of_its_key_as_it_is():
    class Handle:
        def __init__(self):
            self.state, self.timers, self.calls = None, set(), 0

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls += 1
            return self.state

        def exists(self):
            self.calls += 1
            return self.state is not None

        def update(self, value):
            self.calls, self.state = self.calls + 1, value

        def clear(self):
            self.state = None

        def registerTimer(self, ms):
            self.calls += 1
            self.timers.add(ms)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    handle, latest = Handle(), topics.Latest(10)
    latest.init(handle)
    put_ = lambda *events: [r.payload for r in latest.handleInputRows(("k",), iter([{"us": s * 1_000_000, "event_id": i, "payload": p} for s, i, p in events]), Now(0))]
    assert put_((1, 1, "a"), (0, 9, "old")) == ["a"] and handle.timers == {11_000}
    assert put_((5, 2, None), (5, 1, "x")) == [None] and put_((5, 2, "same"), (4, 9, "late")) == []
    assert handle.timers == {11_000} and handle.calls == 6  # a look, what is kept, and the first timer
    assert list(latest.handleExpiredTimer(("k",), Now(12_000), Now(11_000))) == [] and 15_000 in handle.timers and handle.state
    assert [(r.kind, r.event_id, r.ts.timestamp()) for r in latest.handleExpiredTimer(("k",), Now(15_000), Now(15_000))] == [("expired", 2, 5.0)] and handle.state is None
    assert list(latest.handleExpiredTimer(("k",), Now(16_000), Now(15_000))) == []


def test_versions_are_applied_pending_failed_or_late(spark):
    versions = spark.createDataFrame([("c", 1, at(0), None, 2), ("c", 2, at(1), "ok", 2), ("c", 3, at(2), "down", 1), ("c", 4, at(30), None, 1), ("c", 5, at(31), None, 0), ("d", 1, at(0), None, 1)], "config string, version int, p string, api string, workers int").withColumn("published_at", F.col("p").cast("timestamp"))
    acks = spark.createDataFrame([("c", 1, "w1", "ok", 1), ("c", 1, "w1", "ok", 2), ("c", 1, "w2", "ok", 3), ("c", 2, "w1", "ok", 4), ("c", 2, "w2", "no disk", 5), ("d", 1, "w9", "bad", 9)], "config string, version int, worker string, result string, ts long")
    states = reload.version_states(versions, reload.folded_acks(acks), F.lit(at(31)).cast("timestamp"), 300)
    got = {(r.config, r.version): (r.state, r.acked, r.reason, r.active, r.rolled_back) for r in reload.in_force(states).collect()}
    assert got == {
        ("c", 1): ("applied", 2, None, 1, False), ("c", 2): ("error", 1, "no disk", 1, True), ("c", 3): ("error", 0, "down", 1, True), ("c", 4): ("pending", 0, None, 1, False), ("c", 5): ("applied", 0, None, 5, False), ("d", 1): ("error", 0, "bad", None, True),
    }
    late = reload.version_states(versions, reload.folded_acks(acks), F.lit(at(60)).cast("timestamp"), 300).where("version = 4").first()
    assert late.state == "timed_out"
    assert {(r.config, r.active) for r in reload.current(states).collect()} == {("c", 5), ("d", None)}


def test_acknowledgements_fold_on_a_stream(spark, tmp_path):
    schema = "config string, version int, worker string, result string, ts long"
    inbox, states = str(tmp_path / "in"), {}

    def keep(rows, _):
        states.update({r.version: (r.ok, r.failed) for r in rows.collect()})

    for rows in ([("c", 1, "w1", "ok", 1)], [("c", 1, "w2", "ok", 2), ("c", 2, "w1", "no", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = reload.folded_acks(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert states == {1: (2, 0), 2: (0, 1)}


@pytest.fixture
def catalogue(spark):
    documents = spark.createDataFrame([("d1", "c1", "w1", None), ("d2", "c1", "w1", "deleting"), ("d3", "c2", "w1", None), ("d4", "c3", "w2", None)], "document_id string, collection_id string, workspace_id string, status string")
    tags = spark.createDataFrame([("t1", "one", "#1"), ("t2", "two", "#2"), ("t3", "three", "#3")], "tag_id string, name string, color string")
    link = "entity_id string, tag_id string"
    links = {"workspace": spark.createDataFrame([("w1", "t1")], link), "collection": spark.createDataFrame([("c1", "t2"), ("c3", "t2")], link), "document": spark.createDataFrame([("d3", "t3"), ("d4", "t1")], link)}
    state = tag_sync.TagState(tags, links)
    chunks = T.effective_tags(documents, tags, *(links[k] for k in tag_sync.LEVELS)).withColumn("chunk_id", F.concat("document_id", F.lit(":0")))
    return documents, state, chunks


def test_only_what_a_change_concerns_is_written(spark, catalogue):
    documents, old, chunks = catalogue
    recoloured = tag_sync.TagState(old.tags.withColumn("color", F.lit("#9")), old.links)
    assert tag_sync.synced(chunks, documents, old, recoloured).count() == 0
    renamed = tag_sync.TagState(old.tags.withColumn("name", F.when(F.col("tag_id") == "t2", "zwei").otherwise(F.col("name"))), old.links)
    assert {(r.document_id, tuple(r.tags)) for r in tag_sync.synced(chunks, documents, old, renamed).collect()} == {("d1", ("one", "zwei")), ("d4", ("one", "zwei"))}
    again = M.assign(old.links["document"], spark.createDataFrame([("d1", "t1"), ("d3", "t2")], "entity_id string, tag_id string"))
    moved = tag_sync.TagState(old.tags, dict(old.links) | {"document": again, "workspace": old.links["workspace"].limit(0)})
    new = tag_sync.synced(chunks, documents, old, moved)
    assert {(r.document_id, tuple(r.tags)) for r in new.collect()} == {("d3", ("three", "two"))}  # d1 keeps the name by a link of its own
    everything = M.upsert(chunks, new, "chunk_id").join(documents.where("status IS NULL"), "document_id", "left_semi").select("document_id", "tags")
    full = T.effective_tags(documents.where("status IS NULL"), moved.tags, *(moved.links[k] for k in tag_sync.LEVELS))
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, full.collect()))


def test_kept_statistics_follow_the_changes(spark, tmp_path):
    root = str(tmp_path / "t")
    schema = "document_id string, collection_id string, chunk_id string, text string"

    def rows(*items):
        return spark.createDataFrame([(d, c, f"{d}:0", t) for d, c, t in items], schema)

    def checked():
        kept = index.table_statistics(spark, root, "corpus")
        full = index.with_means(R.corpus_statistics(tables.read(spark, root, "corpus")))
        key = lambda r: (r.collection_id, r.term or "", r.df, r.words, None if r.mean_raw is None else round(r.mean_raw, 9))
        assert Counter(map(key, kept.collect())) == Counter(map(key, full.collect()))
        return kept

    tables.commit(spark, root, {"corpus": tables.Change(rows(("a", "c", "x y y"), ("b", "c", "y z"), ("e", "d", "")))})
    checked()
    new = rows(("b", "c", "w w"), ("f", "d", "q"))
    tables.commit(spark, root, {"corpus": tables.Change(new, rows(("b", "", ""), ("e", "", "")), "document_id")})
    calls = []
    whole, R_corpus = index.corpus_statistics, index.corpus_statistics

    def counted(corpus):
        calls.append(corpus.count())
        return R_corpus(corpus)

    index.corpus_statistics = counted
    try:
        kept = checked()
    finally:
        index.corpus_statistics = whole
    assert sorted(calls) == [2, 2]  # the rows that came and those that went, not the table
    assert {r.term for r in kept.where("collection_id = 'c' AND term IS NOT NULL").collect()} == {"x", "y", "w"}
    tables.commit(spark, root, {"corpus": tables.Change(None, rows(("a", "", ""), ("b", "", "")), "document_id")})
    assert {r.collection_id for r in checked().collect()} == {"d"}
    tables.compact(spark, root)
    checked()
    found = R.bm25(tables.read(spark, root, "corpus").select("collection_id", "chunk_id", "text"), spark.createDataFrame([("q",)], "query_text string"), index.table_statistics(spark, root, "corpus"))
    assert all(math.isfinite(r.bm25) for r in found.collect())


def test_statistics_of_a_folder_are_kept_by_its_files(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([("c", "k", "x y")], "collection_id string, chunk_id string, text string").write.parquet(path)
    calls = []

    def corpus():
        calls.append(1)
        return spark.read.parquet(path)

    version = index.version_of(spark, path)
    for _ in range(3):
        assert index.kept_statistics(spark, version, corpus).count() == 3
    assert len(calls) == 1
    spark.createDataFrame([("c", "m", "z")], "collection_id string, chunk_id string, text string").write.mode("append").parquet(path)
    assert index.version_of(spark, path) != version and index.kept_statistics(spark, index.version_of(spark, path), corpus).count() == 4
