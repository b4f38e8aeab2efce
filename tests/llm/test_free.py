"""WARC, language, toxicity, near-duplicates, decontamination and repeated substrings, against brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.llm import decontam, langid, minhash, substrings, support, toxicity, warc
from orrery.llm.support import components

DOC = "doc_id long, text string, lang string, source string"


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s") for i, t in texts], DOC).withColumn("n", F.lit("clash")).withColumn("run", F.lit("clash"))


def prose(rng, n, words=None):
    return " ".join(rng.choice(words or [f"w{i}" for i in range(400)]) for _ in range(n))


# WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b", "same"), (3, None, "same"), (4, "http://c\r\nX: y", ""), (5, "u", None), (6, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 3), (7, "u", "x" * 5000 + "€" * 3000), (8, "u", "same"), (None, "u", "odd")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=700)
    back = {r.page_id: r for r in warc.page_report(spark, str(tmp_path / "w")).collect()}
    assert len(back) == len(rows)
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(i if i is not None else -1, last.get(html or "", -1))
    for i, _, html in rows:
        data = (html or "").encode()
        origin = last[html or ""]
        revisit = i is not None and i != origin
        assert (back[i].payload_bytes, back[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (back[i].record_type, back[i].refers_to) == (("revisit", origin) if revisit else ("response", None))
    payloads = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "w")).where("payload IS NOT NULL").collect()}
    assert payloads[7] == rows[6][2].encode() and payloads[6] == rows[5][2].encode()


def test_warc_repeated_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (0, "u", "a")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "r"))
    found = Counter((r.page_id, r.record_type) for r in warc.page_report(spark, str(tmp_path / "r")).collect())
    assert found == {(1, "response"): 2, (0, "revisit"): 1}
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.page_report(spark, str(tmp_path / "e")).count() == 0


def test_warc_revisits_of_a_frequent_page(spark, tmp_path):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("p"), F.col("id") % 500)).alias("html"))
    warc.write_archives(pages, str(tmp_path / "f"))
    out = warc.page_report(spark, str(tmp_path / "f"))
    last = {r.html: r.of for r in pages.groupBy("html").agg(F.max("page_id").alias("of")).collect()}
    own = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in out.collect()}
    assert got == {i: ("response" if last[h] == i else "revisit", None if last[h] == i else last[h], len(h)) for i, h in own.items()}


def test_warc_missing_segment_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc" * 1000)], "page_id long, url string, html string")
    records = warc.records_of(pages, segment_bytes=500).where(~F.col("record").contains("WARC-Segment-Number: 3"))
    records.write.option("lineSep", warc.RECORD_END).text(str(tmp_path / "m"))
    with pytest.raises(Exception, match="segments are missing"):
        warc.page_report(spark, str(tmp_path / "m")).collect()


def test_chunked_framing():
    assert warc.unchunked(b"4;x=y\r\nWiki\r\n3\r\n\r\n1\r\n0\r\n\r\n") == b"Wiki\r\n1"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


# Language


def test_language_is_learned_without_held_out(spark):
    rng = random.Random(1)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["zwölf", "größe", "straße", "über"]}
    rows = [(i, prose(rng, 30, words[("aa", "bb")[i % 2]]), ("aa", "bb")[i % 2], "s") for i in range(200)]
    rows += [(900, None, "aa", "s"), (901, " 12 !", "aa", "s"), (902, "STRASSE ÜBER GRÖSSE", None, "s"), (903, "über " * 60_000, None, "s"), (903, "über " * 60_000, None, "s"), (None, "lorem ipsum", "aa", "s")]
    docs = spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash"))
    out = langid.language_report(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == ("aa", "bb")[i % 2] and 0 <= by[i].score <= 1 for i in range(200))
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[902].lang_pred == by[903].lang_pred == "bb"
    import zlib

    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200)) and not by[None].held_out
    relabelled = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.language_report(relabelled).collect()} == {(r.doc_id, r.lang_pred, r.score) for r in out}
    assert {r.lang_pred for r in langid.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_report(docs.limit(0)).count() == 0


def test_counts_probabilities_and_posterior_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEP", 64)
    monkeypatch.setattr(langid, "BLOCK", 40)  # texts are cut into parts, and parts of several texts are looked at together
    texts = [("aa", "Ein  Haus"), ("aa", "zu Hause! " * 12), ("bb", "une maison, é"), ("bb", ""), ("cc", "\U00010400\U00010428 \U0001f600 x")]
    docs = spark.createDataFrame([(i, t, lang, "s") for i, (lang, t) in enumerate(texts)], DOC)

    def grams(text):
        low = re.sub(r" +", " ", "".join(chr(langid.fold(ord(c))) for c in text))
        for n in (1, 2, 3):
            for i in range(len(low) - n + 1):
                h = 0
                for c in low[i : i + n]:
                    h = (h + ord(c) + 1) * 2654435761 % 2**32
                    h ^= h >> 15
                yield h % langid.BUCKETS

    seen = {}
    for lang, t in texts:
        seen.setdefault(lang, Counter()).update(grams(t))
    found = {(r.lang, r.cell): r.n for r in langid.counts(docs).collect()}
    assert found == {(lang, c): n for lang, cells in seen.items() for c, n in cells.items()}
    [(names, matrix)] = langid.learn(docs)
    assert names == ["aa", "bb", "cc"]
    log = [[math.log((seen[lang][c] + 0.5) / (sum(seen[lang].values()) + 0.5 * langid.BUCKETS)) for c in range(langid.BUCKETS)] for lang in names]
    assert abs(matrix.T - log).max() < 1e-5
    for r in langid.predict(docs, [(names, matrix)]).collect():
        sums = [sum(n * log[k][c] for c, n in Counter(grams(texts[r.doc_id][1])).items()) for k in range(3)]
        if not any(c.isalpha() for c in texts[r.doc_id][1]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == names[sums.index(max(sums))] and r.score == pytest.approx(1 / sum(math.exp(s - max(sums)) for s in sums), rel=1e-2)


def test_dirty_labels_and_equal_scores(spark):
    rows = [(i, "lorem ipsum dolor", f"junk{i:02d}", "s") for i in range(12)] + [(100 + i, "lorem ipsum dolor", ("bb", "aa")[i % 2], "s") for i in range(40)]
    docs = spark.createDataFrame(rows, DOC)
    model = langid.learn(docs, languages=6)
    assert [len(names) for names, _ in model] == [6, 6, 2] and model[0][0][:2] == ["aa", "bb"]
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"aa"}
    assert {r.lang_pred for r in langid.predict(docs, []).collect()} == {"und"}


def test_blocks_of_languages_agree_with_one_matrix(spark):
    rng = random.Random(14)
    words = {lang: [f"{lang}{rng.choice('aeiou')}{rng.choice('mnrst')}{k}" for k in range(30)] + ["und", "the"] for lang in ("ba", "de", "fi", "ko", "zu")}
    rows = [(i, None if i == 3 else "12" if i == 4 else prose(rng, rng.randint(1, 30), words[lang]), lang, "s") for i, lang in enumerate(list(words) * 12)]
    docs = spark.createDataFrame(rows, DOC)
    one, parts = langid.learn(docs), langid.learn(docs, languages=2)
    assert (len(one), len(parts)) == (1, 3)
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, m).collect()} for m in (one, parts))
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()} and all(a[k][1] == pytest.approx(b[k][1], abs=1e-6) for k in a)


def test_rare_labels_are_learned_and_any_share_can_be_drawn(spark):
    rows = [(i, f"frequent words {i % 7} again", "xx", "s") for i in range(3000)] + [(5000 + i, "selten gesagt", "yy", "s") for i in range(3)]
    docs = spark.createDataFrame(rows, DOC)
    model = langid.learn(docs, max_training=200)
    assert model[0][0] == ["xx", "yy"]
    drawn = support.sampled(spark.range(2_000_000).withColumnRenamed("id", "doc_id"), 10**11, 10**7, 7).count()  # a share of 1 in 10^4
    assert 100 < drawn < 320


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = prose(rng, 40).split()
        for _ in range(rng.randint(1, 5) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["dreck", "DEPP,", "pfui!", "mist"]))
        rows.append((i, " ".join(text), "en", "s"))
        if i % 3:
            labels.append((i, int(toxic)))
    rows += [(1000, None, "en", "s"), (1001, " ", "en", "s"), (1002, "w1 " * 50_000 + "dreck depp pfui mist", "en", "s"), (1, rows[1][1], "en", "s")]
    docs = spark.createDataFrame(rows, DOC).withColumn("severity", F.lit("clash"))
    known = spark.createDataFrame(labels + [(7, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity_report(docs, known).collect()}
    held = [i for i in range(600) if i % 3 == 0]
    right = sum(out[i].toxic == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.95
    assert not any(out[i].toxic for i in range(600) if i % 5)
    assert out[1000].severity == out[1001].severity == 0 and out[1002].toxic
    severe = [out[i].severity for i in range(0, 600, 5) if out[i].n_marks >= 4]
    mild = [out[i].severity for i in range(0, 600, 5) if out[i].n_marks == 1]
    assert min(severe) > max(mild)
    assert not any(r.toxic for r in toxicity.toxicity_report(docs, known.limit(0)).collect())
    assert toxicity.toxicity_report(docs.limit(0), known).count() == 0
    assert toxicity.without_toxic(docs, known).columns == docs.columns


def test_graded_labels_and_the_loss(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        grade = i % 4
        marks = ["mild"] * (grade > 0) + ["harsh"] * (grade > 1) + ["vile"] * (grade > 2)
        rows.append((i, " ".join(prose(rng, 20).split() + marks), "en", "s"))
        labels.append((i, grade))
    labels += [(0, -1), (5, None), (None, 3), (4, 0), (4, 0)]
    docs = spark.createDataFrame(rows + [rows[3], (None, rows[3][1], "en", "s")], DOC)
    out = toxicity.toxicity_report(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == 402 and {r.grades_from for r in out} == {"labels"}
    assert all(r.grade == (3 if r.doc_id is None else r.doc_id % 4) for r in out)
    by = [[r.severity for r in out if r.grade == g] for g in range(4)]
    assert all(max(a) < min(b) for a, b in zip(by, by[1:], strict=False))

    # the fit is a minimum of the cumulative-link loss: no small step makes it smaller
    np = toxicity.np
    texts = [[k for k in range(3) if rng.random() < 0.5] for _ in range(60)]
    grades = [min(2, max(0, len(t) - 1 + (rng.random() < 0.3))) for t in texts]
    model = toxicity.fit(texts, grades, ["a", "b", "c"], ridge=1e-3)

    def loss(params):
        total = 1e-3 / 2 * sum(w * w for w in params[:3])
        for t, g in zip(texts, grades, strict=True):
            for k in range(2):
                p = 1 / (1 + math.exp(params[3 + k] - sum(params[i] for i in t)))
                total -= math.log(p if g > k else 1 - p) / len(texts)
        return total

    best = np.concatenate([model.weights, model.thresholds])
    assert list(model.thresholds) == sorted(model.thresholds)
    assert all(loss(best + d * np.eye(5)[k]) >= loss(best) - 1e-9 for k in range(5) for d in (-0.01, 0.01))


# Near-duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def brute_components(texts, n, percent=80):
    sets = {i: shingles(t, n) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts():
    rng = random.Random(3)
    texts = []
    for g in range(12):
        base = prose(rng, rng.choice([5, 12, 40, 150, 400])).split()
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10_000)}"
            texts.append(" ".join(copy))
    hub = prose(rng, 120).split()
    for i in range(70):  # a large group whose members are edited more and less
        copy = list(hub)
        for _ in range(i // 6):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(copy))
    texts += [None, "", " \t", "one", "One", "one two", "ONE\ntwo", "one two three", "ÉCOLE école", "école ÉCOLE"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("n,long", [(2, 32), (5, 32), (2, 3)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, n, long):
    monkeypatch.setattr(minhash, "LONG", long)
    texts = near_texts()
    out = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts), n).collect()}
    expected = brute_components(texts, n)
    assert {i: (r.n_shingles, r.component_id) for i, r in out.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.values())


def test_rounds_join_a_group_of_loose_copies(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(60)] = f"x{i}"
        texts.append((i, " ".join(copy)))
    turns = []
    draw = minhash.hub_pairs
    monkeypatch.setattr(minhash, "LONG", 3)
    monkeypatch.setattr(minhash, "HUBS", 1)
    monkeypatch.setattr(minhash, "hub_pairs", lambda *args: turns.append(args[-1]) or draw(*args))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, texts), 2).collect()}
    assert out == brute_components(texts, 2)
    assert len(turns) > 1


def test_near_duplicates_edges(spark):
    docs = frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f")])
    out = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert out == [("5", 5, True), ("5", 5, True), ("7", 5, False), ("None", None, True)]
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "None"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_different_texts_under_one_id(spark):
    a, b, c = "the first text has these words", "an other text of quite other words", "something else again in a third"
    docs = frame(spark, [(3, a), (5, a), (5, b), (9, b), (7, c), (7, a + " x"), (7, None)])
    out = Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, 1).collect())
    assert out == {(3, 3): 1, (5, 3): 2, (9, 3): 1, (7, 3): 2, (7, 7): 1}
    kept = sorted((r.doc_id, r.text or "") for r in minhash.deduplicated(docs, 1).collect())
    assert kept == [(3, a), (5, b), (7, ""), (7, c)]


@pytest.mark.parametrize("few", [500_000, 0])
def test_components_of_chains(spark, monkeypatch, few):
    monkeypatch.setattr(support, "BROADCAST_EDGES", few)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 101), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Decontamination


def edit_distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_contaminations_against_dynamic_programming(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randint(3, 25))) for k in range(8)] + [(90, ""), (91, None), (92, "?!"), (93, "w1")]
    texts = []
    for i in range(60):
        body = prose(rng, 60)
        if i % 3 == 0:
            item = list(items[rng.randrange(8)][1].upper() if i % 2 else items[rng.randrange(8)][1])
            for _ in range(rng.randint(0, len(item) // 15)):
                at = rng.randrange(len(item))
                item[at : at + 1] = rng.choice([[], ["q"], [item[at], "z"]])
            body = body[:100] + " -- " + "".join(item) + " ... " + body[100:]
        texts.append((i, body))
    texts += [(70, None), (71, ""), (72, "w1"), (73, (items[0][1] + "\n") * 300)]
    out = {(r.doc_id, r.item_id): r.distance for r in decontam.contaminations(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = {}
    for i, text in texts:
        for k, item in items:
            a, b = decontam.folded(item), decontam.folded(text)
            if a and i != 73:
                d = edit_distance_within(f" {a} ", f" {b} ")
                if d <= int(decontam.BUDGET * len(a)) and (len(a) >= decontam.SHORT or a == b):
                    expected[i, k] = d
    assert {k: v for k, v in out.items() if k[0] != 73} == expected
    assert out[73, 0] == 0
    docs = frame(spark, texts)
    clean = decontam.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in texts} - {i for i, _ in out}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminations(docs, none).count() == 0 and decontam.contaminations(docs.limit(0), none).count() == 0


def test_short_items_and_word_edges(spark):
    items = spark.createDataFrame([(1, "no"), (2, "a b"), (3, "seventeen letters"), (4, "whole words of a longer item")], "item_id long, text string")
    texts = ["I know it", "alpha beta", "NO!", "it says seventeen letters here", "Seventeen letters.", "x whole words of a longer item y", "unwhole words of a longer items", "nothing"]
    docs = frame(spark, list(enumerate(texts)) + [(2, "no"), (None, "a, b")])
    out = Counter((r.doc_id, r.item_id, r.distance) for r in decontam.contaminations(docs, items).collect())
    assert out == {(2, 1, 0): 2, (None, 2, 0): 1, (4, 3, 0): 1, (5, 4, 0): 1}
    assert sorted(r.text for r in decontam.decontaminated(docs, items).collect()) == sorted(texts[i] for i in (0, 1, 3, 6, 7))


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"benchmark item number {k} with some words") for k in range(30)], "item_id long, text string")
    docs = frame(spark, [(i, f"xx benchmark item number {i} with some words yy") for i in range(40)])
    whole = {tuple(r) for r in decontam.contaminations(docs, items).collect()}
    monkeypatch.setattr(decontam, "BLOCK", 100)
    assert {tuple(r) for r in decontam.contaminations(docs, items).collect()} == whole and len(whole) >= 30


# Repeated substrings


def brute_removals(texts, length, keep_first):
    where = Counter()
    for _, t in texts:
        b = (t or "").encode()
        where.update(b[p : p + length] for p in range(len(b) - length + 1))
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if where[s] > 1:
                if keep_first and s not in seen:
                    seen.add(s)
                    continue
                gone[p : p + length] = b"\x01" * length
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def substring_texts():
    rng = random.Random(5)
    shared = [prose(rng, 30) for _ in range(4)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            at = rng.randrange(len(s) // 2)
            parts += [s[at : at + rng.randint(20, 200)], prose(rng, rng.randint(0, 10))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], None, "", "short", "aaaa" * 60, "a" * 39, "ab" * 90, "é" * 70, shared[0] * 3]
    return list(enumerate(texts))


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("hot", [4000, 1])
def test_removals_against_all_substrings(spark, keep_first, hot):
    texts = substring_texts()
    out = substrings.removal_report(frame(spark, texts), length=40, gram=16, keep_first=keep_first, hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute_removals(texts, 40, keep_first)


def test_factors_against_all_pairs():
    rng = random.Random(9)
    for length, alphabet in ((5, b"ab"), (8, b"abc"), (20, b"a"), (16, b"abcdefgh")):
        contexts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(length, 3 * length))) for _ in range(12)]
        contexts[5] = contexts[2]
        owner, start, position, common = substrings.suffix_order(contexts, length)
        strings = [contexts[o][s : s + length] for o, s in zip(owner, start, strict=True)]
        assert strings == sorted(strings) and len(strings) == sum(len(c) - length + 1 for c in contexts)

        def match(a, b, length=length):
            return next((i for i in range(length) if a[i] != b[i]), length)

        assert list(common[1:]) == [match(a, b) for a, b in zip(strings, strings[1:], strict=False)]
        for sign in (1, -1):
            expected = [max((match(x, y) for y, q in zip(strings, position, strict=True) if sign * q < sign * p), default=0) for x, p in zip(strings, position, strict=True)]
            places = position if sign > 0 else position.max() - position
            assert list(substrings.longest_factors(places, common)) == expected


def test_long_texts_are_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 600)
    texts = [(i, t) for i, t in substring_texts()] + [(200, prose(random.Random(6), 700))]
    out = substrings.removal_report(frame(spark, texts), length=40, gram=16).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute_removals(texts, 40, False)


def test_removals_of_nothing_and_repeated_rows(spark):
    text = prose(random.Random(7), 60)
    docs = frame(spark, [(1, text), (1, text), (None, text)])
    out = sorted((str(r.doc_id), r.n_removed) for r in substrings.removal_report(docs).collect())
    assert out == [("1", len(text)), ("1", len(text)), ("None", len(text))]
    alone = frame(spark, [(1, "other"), (None, text), (2, text[20:]), (None, None)])
    assert sorted((str(r.doc_id), r.n_removed) for r in substrings.removal_report(alone).collect()) == [("1", 0), ("2", len(text) - 20), ("None", 0), ("None", len(text) - 20)]
    assert substrings.removal_report(docs.limit(0)).count() == 0


def test_texts_that_share_an_id_keep_what_is_not_a_copy(spark):
    rng = random.Random(12)
    text, other = prose(rng, 120), prose(rng, 100, [f"o{i}" for i in range(300)])
    rows = [(1, text), (2, text), (1, other), (None, other[:150]), (3, other + " tail of its own")]
    out = {(r.doc_id, r.n_bytes): r.n_removed for r in substrings.removal_report(frame(spark, rows)).collect()}
    assert out[(1, len(text))] == out[(2, len(text))] == len(text)
    assert out[(1, len(other))] == len(other) and out[(3, len(other) + 16)] == len(other) and out[(None, 150)] == 0
    alone = {(r.doc_id, r.n_bytes): r.n_removed for r in substrings.removal_report(frame(spark, rows[:3])).collect()}
    assert alone == {(1, len(text)): len(text), (2, len(text)): len(text), (1, len(other)): 0}
