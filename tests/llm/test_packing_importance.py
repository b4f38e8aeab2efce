"""Packing and importance resampling, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import importance, packing

DOC = "doc_id long, text string"


def docs_of(spark, rows):
    clash = ["n", "row", "group", "ids", "bucket", "rank", "_row", "buckets"]
    return spark.createDataFrame(rows, DOC).select("*", *[F.lit("clash").alias(c) for c in clash]).repartition(3)


# Packing


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    return packing.vocabulary_path()


def test_ids_are_those_of_whole_texts(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    encode, rng = packing.Encoder(vocabulary), random.Random(3)
    some = ["a", "B", "é", "ß", "1", "²", "½", "'s", "'ll", "  ", " ", "\n", "\t", "\r\n", " ", "—", "’", ".", "!!", "_", "<|endoftext|>", "ª", "東京", "é", "🙂", "\x1c", "word"]
    for run in (1 << 18, 5):
        monkeypatch.setattr(packing, "RUN", run)
        for _ in range(1500):
            text = "".join(rng.choice(some) for _ in range(rng.randint(0, 20)))
            assert encode(text) == encode.asked(text), repr(text)


def test_first_fit_decreasing_is_that_of_a_plain_loop():
    rng = random.Random(5)
    for n in (1, 2, 7, 200):
        sizes = np.array([rng.randint(1, 64) for _ in range(n)])
        loads: list[list[int]] = []
        for size in sorted(sizes.tolist(), reverse=True):
            at = next((b for b in loads if sum(b) + size <= 64), None)
            if at is None:
                loads.append([size])
            else:
                at.append(size)
        found = packing.first_fit_decreasing(sizes, 64)
        assert [[p[2] for p in b] for b in found] == loads
        done = packing.filled(found, 64, 3)
        spans = defaultdict(list)
        for b in done:
            load = sum(p[2] for p in b)
            assert load > 64 - 3 and load <= 64 or packing.is_power(load)
            for item, start, size in b:
                spans[item].append((start, size))
        for i, size in enumerate(sizes.tolist()):
            at = 0
            for start, part in sorted(spans[i]):
                assert start == at and part > 0
                at += part
            assert at == size


def test_pieces_rebuild_every_document(spark, vocabulary):
    rng = random.Random(9)
    texts = ["", None, "x", "word " * 5000, "a b " * 300, "🙂 " * 40] + [" ".join(rng.choice(["alpha", "be", "gamma,", "δ"]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7]), (None, "no id"), (None, None)]
    found = packing.packed(docs_of(spark, rows), length=64, group=16).collect()
    encode = packing.Encoder(vocabulary)
    loads = defaultdict(list)
    for r in found:
        assert len(r.ids) == 4 * r.length > 0
        loads[r.sequence_id].append((r.offset, r.length))
    for parts in loads.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    want = Counter()
    for i, t in rows:
        want.update((i, bytes(x)) for x in np.frombuffer(encode(t or "") + b"\0\0\0\0", np.uint8).reshape(-1, 4).tolist())
    have = Counter()
    for r in found:
        have.update((r.doc_id, r.ids[k : k + 4]) for k in range(0, len(r.ids), 4))
    assert have == want
    for i in (3, 6, 20):
        parts = sorted((r.start, r.ids) for r in found if r.doc_id == i)
        assert b"".join(bytes(x) for _, x in parts) == encode(texts[i]) + b"\0\0\0\0"
    padding = sum(64 - n for n in (sum(n for _, n in p) for p in loads.values()) if not packing.is_power(n))
    assert padding <= 0.1 * sum(r.length for r in found)


def test_sequences_are_padded_but_at_powers_of_two(spark, vocabulary):
    packs = packing.packed(docs_of(spark, [(i, "w " * i) for i in range(40)]), length=64, group=16)
    for r in packing.sequences(packs, 64).collect():
        size = len(r.ids) // 4
        assert size == (r.tokens if packing.is_power(r.tokens) else 64)
    assert packing.packed(docs_of(spark, [(1, "x")]).limit(0)).count() == 0
    report = packing.pack_report(packs).collect()
    ids = {(r.doc_id, r.start): r.ids for r in packs.collect()}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id, r.start]) for r in report)


# Importance resampling


def plainly(rows, target, n, buckets, least, percent, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    corpus = [features(t) for _, t in rows]
    s, t = Counter(b for _, x in corpus for b in x), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for (i, _), (words, x) in zip(rows, corpus, strict=True):
        gain = [math.floor(1000 * math.log(((t[b] + 1) * (s_all + buckets)) / ((s[b] + 1) * (t_all + buckets)))) for b in x]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    places = defaultdict(list)
    for place, x in enumerate(eligible, 1):
        places[x].append(place if place <= len(eligible) * percent // 100 else None)
    return Counter((x[0], x[2], x[3], x[4], places[x].pop(0) if x in places and places[x] else None) for x in out)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling_against_plain_python(spark, n):
    rng = random.Random(n)
    words = ["Alpha", "beta", "GAMMA", "ünï", "x1", "İ", "ǅ", "東京", "d-e", "f_g"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "..."), (3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, rows[5][1]), (203, "long Tail " * 20_000)]
    target = [None, "", "alpha beta", "gamma x1 " * 7]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    found = importance.resampled(docs_of(spark, rows), items, n=n, buckets=500, least_words=5, percent=30, seed=7)
    assert Counter(map(tuple, found.collect())) == plainly(rows, target, n, 500, 5, 30, 7)


def test_ring_has_the_states_of_whole_runs():
    text = "Ab cd, Éf  ab_x 9".lower().encode()
    words = importance.WORD.findall(text)
    for n in (1, 2, 4):
        want = Counter(zlib.crc32(b" ".join(words[i : i + k])) % 97 for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words))
        assert Counter(importance.crc_ring(text, n, 97)) == want
        assert importance.words_in(sum(want.values()), n) == len(words)


def test_resampling_of_empty_tables(spark):
    docs, none = docs_of(spark, [(1, "a b c")]), spark.createDataFrame([], "item_id long, text string")
    assert importance.resampled(docs.limit(0), none).count() == 0
    only = importance.resampled(docs, none, least_words=1, percent=100).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in only] == [(1, 3, 1)]


def test_ranks_run_on_over_slices(spark):
    rows = spark.range(5000).select(F.pmod(F.col("id"), F.lit(3)).alias("score"), (F.col("id") % 10).alias("doc_id"), F.col("id").alias("_row"))
    found = importance.numbered(rows, 5000, F.col("score").desc(), F.col("doc_id").asc(), F.col("_row").asc())
    want = sorted(((-(i % 3), i % 10, i) for i in range(5000)))
    assert sorted((r.rank, r._row) for r in found.collect()) == [(k, w[2]) for k, w in enumerate(want, 1)]
