"""The stages of the pipeline on a small corpus, against brute force for those without a model."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from orrery.llm.decontam import contaminations

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    item = " ".join(rng.choice(words) for _ in range(20))
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(60))
        if i % 10 == 1:
            text += " dreck depp pfui mist " * 2
        if i % 25 == 3:
            text = text[:80] + " " + item + " " + text[80:]
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows += [(300 + i, rows[i][1] + " end", "en", "s1", 0) for i in range(0, 20)] + [(400, None, "en", "s1", None), (401, "", None, None, 0)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 10 == 1)) for i in range(300)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / "out" / name))
        docs = spark.read.parquet(str(tmp_path / "out" / name))
        kept.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
    toxic, near, clean, mixed, sharded = kept
    assert set(toxic) == {i for i in range(402) if (i < 320 or i >= 400) and not (i < 300 and i % 10 == 1) and not (300 <= i < 320 and (i - 300) % 10 == 1)}
    assert set(near) == {i for i in toxic if not 300 <= i < 320}
    assert set(clean) == {i for i in near if not (i < 300 and i % 25 == 3)}
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2
    assert sharded == mixed
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in final) == sharded
    assert contaminations(docs.select("doc_id").limit(0).selectExpr("doc_id", "'' AS text"), spark.read.parquet(str(tmp_path / "benchmark.parquet"))).count() == 0
