"""Filters judge each row by its own text; what a filter can't do whole is refused."""

from __future__ import annotations

import pytest

from orrery.llm import decontam, minhash, toxicity

DOC = "doc_id long, text string"


def test_toxic_rows_without_or_with_shared_ids_are_dropped(spark, monkeypatch):
    model = toxicity.OrdinalModel(["dreck"], toxicity.np.array([20.0]), toxicity.np.array([5.0, 30.0]))
    monkeypatch.setattr(toxicity, "learn", lambda docs, labels: model)
    docs = spark.createDataFrame([(None, "so ein dreck"), (None, "so ein tag"), (1, "dreck"), (1, "clean"), (2, None), (3, "")], DOC)
    kept = sorted((r.doc_id or 0, r.text) for r in toxicity.without_toxic(docs, docs).where("text IS NOT NULL").collect())
    assert kept == [(0, "so ein tag"), (1, "clean"), (3, "")]
    assert toxicity.without_toxic(docs, docs).where("doc_id = 2").count() == 1


def test_leaks_without_or_with_shared_ids_are_dropped(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 10)
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "an entirely different item of the benchmark")], "item_id long, text string")
    leak, other = "x the quick brown fox jumps over the lazy dog y", "an entirely different item of the benchmark"
    docs = spark.createDataFrame([(None, leak), (None, "clean"), (1, other), (1, "clean too"), (2, None)], DOC)
    assert sorted(r.text or "" for r in decontam.decontaminated(docs, items).collect()) == ["", "clean", "clean too"]


def test_similarities_under_the_bound_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], DOC)
    for bad in (50, 79, 101):
        with pytest.raises(ValueError, match="percent"):
            minhash.near_duplicates(docs, percent=bad)
