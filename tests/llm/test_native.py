"""Sharding, quality rules, chat formatting and mixing, on small hand-made tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.llm import chat, mixing, quality_rules, sharding

DOC = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i} " * (i % 17 + 1), ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    rows += [(400 + i, "the same text again", "en", "hot") for i in range(60)]
    rows += [(500, None, "en", None), (501, "", None, None), (502, " \n\t ", "fr", "s1"), (503, "x" * 20_000, "fr", "s1"), (503, "x" * 20_000, "fr", "s1")]
    return corpus(spark, rows)


def test_shards_are_even_and_numbered(spark, docs):
    extra = docs.withColumn("node", F.lit("clash")).withColumn("size", F.lit(1))
    out = sharding.shard_report(extra, shards=4).collect()
    assert len(out) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {(r.doc_id, r.shard) for r in sharding.shard_report(docs, shards=4).collect()}
    assert {(r.doc_id, r.shard) for r in out} == again


def test_shards_balance_bytes_and_one_value(spark):
    rows = [(i, "one text for all of them", "en", "s") for i in range(1000)]
    sizes = Counter(r.shard for r in sharding.shard_report(corpus(spark, rows), shards=8).collect())
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 10
    sizes = Counter(r.shard for r in sharding.kd_shards(corpus(spark, rows), target_bytes=25 * 260).collect())
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) <= 260
    same = corpus(spark, [(1, "one row many times", "en", "s")] * 50)
    assert {r.shard for r in sharding.kd_shards(same, target_bytes=100).collect()} == {0}


@pytest.mark.parametrize("shards,target", [(6, None), (None, 9_000)])
def test_cuts_are_weighted_medians_of_the_widest_dimension(spark, docs, shards, target):
    dims = sharding.default_dimensions()
    points, cuts, leaves, n = sharding.kd_tree(sharding.points_of(docs, dims), len(dims), shards, target)
    rows = [(r.node, tuple(r.dims), r.by_text, r.by_id, r.size) for r in points.collect()]
    assert n == len(rows) and {r[0] for r in rows} <= set(leaves)
    spans = [max(r[1][i] for r in rows) - min(r[1][i] for r in rows) for i in range(len(dims))]

    def under(node):
        return [r for r in rows if r[0].bit_length() >= node.bit_length() and r[0] >> (r[0].bit_length() - node.bit_length()) == node]

    for c in cuts:
        inside, left, right = (under(x) for x in (c["node"], 2 * c["node"], 2 * c["node"] + 1))
        widths = [(max(r[1][i] for r in inside) - min(r[1][i] for r in inside)) / spans[i] for i in range(len(dims))]
        assert widths[c["dim"]] == max(widths) and sorted(left + right) == sorted(inside)
        place = lambda r, d=c["dim"]: (r[1][d], r[2], r[3])
        assert not left or not right or max(map(place, left)) <= min(map(place, right))
        total = sum(r[4] for r in inside)
        nearest = min(abs(sum(r[4] for r in inside if place(r) <= place(x)) - c["goal"]) for x in inside)
        assert abs(sum(r[4] for r in left) - c["goal"]) <= max(nearest, sharding.SLACK * total) + 1e-6
    for leaf in leaves:
        if target is not None:
            assert sum(r[4] for r in under(leaf)) <= target or len({r[1:4] for r in under(leaf)}) == 1
    assert shards is None or len(leaves) <= shards  # one text is larger than a shard should be


def test_shards_are_of_equal_bytes(spark):
    rows = [(i, "ab " * (1 + i * 7919 % 50), "en" if i % 3 else "de", "s") for i in range(3000)]
    sizes = Counter()
    for r in sharding.shard_report(corpus(spark, rows), shards=8).collect():
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 8 + 151


def test_shards_of_nothing(spark, docs):
    assert sharding.shard_report(docs.limit(0), shards=8).count() == 0
    few = sharding.shard_report(docs.limit(2), shards=8).collect()
    assert len(few) == 2


def statistics(text):
    words = BLANK.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_text_statistics_against_plain_python(spark):
    texts = [None, "", " \x0b\x1c ", "a b", "a b c", "a b c a b c", "x\ny\nx\n\n\nx", "é#*$ ü|<> %&", "a a a a a", "one two three four one two three\r\nfive\r\nfive", " a b c", "w " * 5000, "a\n" * 300]
    out = quality_rules.text_statistics(corpus(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(texts[r.doc_id]), texts[r.doc_id]


def test_decision_list_learns_junk(spark):
    good = [(i, " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(80)), "en", "s") for i in range(150)]
    bad = [(1000 + i, " ".join(f"w{(i * 5 + k * k) % 991}###" for k in range(80)), "en", "s") for i in range(60)]
    docs = corpus(spark, good + bad + [(9999, None, "en", "s")])
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(1000 + i, 0) for i in range(60)] + [(0, 1), (5, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_rules.quality_report(docs, labels).collect()}
    assert all(out[i].kept for i in range(150)) and not any(out[1000 + i].kept for i in range(60))
    assert out[9999].base_failed and not out[9999].kept
    none = quality_rules.quality_report(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality_rules.quality_report(docs.limit(0), labels).count() == 0


def test_decision_list_goes_on_after_an_imprecise_rule(spark):
    """The best first condition (long words) is imprecise on the held-back third; the symbols behind it are not."""
    columns = [*quality_rules.features()]

    def row(i, words, chars, symbols):
        return (i, words, chars * words, symbols, 0, 10, 0)

    good = [row(i, 100, 5, 0) for i in range(150)] + [row(1000 + i, 100, 8, 0) for i in range(9)]
    bad = [row(2000 + i, 100, 8, 0) for i in range(12)] + [row(3000 + i, 100, 5, 60) for i in range(40)]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
    stats = spark.createDataFrame(good + bad, schema)
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad], "doc_id long, quality int")
    found = quality_rules.learn(stats, labels)
    assert any(name == "symbols_per_word" and at_least for rule in found.rules for name, at_least, _ in rule), str(found)
    covered = {r.doc_id for r in stats.where(found.column().isNotNull()).collect()}
    assert {r[0] for r in bad[12:]} <= covered and not covered & {r[0] for r in good[:150]}
    assert set(n for rule in found.rules for n, _, _ in rule) <= set(columns)


def test_decision_list_covers_as_a_plain_one(spark):
    """Sequential covering in plain Python, on the same rows, bins and thirds."""
    rng = random.Random(8)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
    rows = []
    for i in range(260):
        junk = rng.random() < 0.3
        words = rng.randint(20, 400)
        rows.append((i, words, words * rng.randint(3, 6), rng.randint(0, 8) + (words // 2 if junk and rng.random() < 0.7 else 0), rng.randint(0, 3), rng.randint(4, 9), words // 2 if junk and rng.random() < 0.4 else rng.randint(0, 4), junk))
    stats = spark.createDataFrame([r[:-1] for r in rows], schema)
    labels = spark.createDataFrame([(r[0], 0 if r[-1] else 1) for r in rows], "doc_id long, quality int")
    found = quality_rules.learn(stats, labels)
    parts = stats.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) > 0).alias("grow"), *[c.alias(k) for k, c in quality_rules.features().items()]).collect()
    bad = {r[0]: r[-1] for r in rows}
    names = list(quality_rules.features())

    def quantile(values, q):
        at = q * (len(values) - 1)
        low = int(at)
        return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])

    steps = {k: sorted({quantile(sorted(r[k] for r in parts if bad[r.doc_id] == c), q) for c in (True, False) for q in quality_rules.QUANTILES}) for k in names}
    met = lambda r, rule: all((r[n] >= t) == at_least for n, at_least, t in rule)
    left, rules, aside = list(parts), [], set()
    while True:
        rule = []
        while True:
            here = [r for r in left if r.grow and met(r, rule)]
            p0 = sum(bad[r.doc_id] for r in here)
            if not p0 or p0 == len(here):
                break
            best = (0.0, ("", True, 0))
            for name in names:
                for i, t in enumerate(steps[name]):
                    for at_least in (True, False):
                        c = [r for r in here if (r[name] >= t) == at_least]
                        p = sum(bad[r.doc_id] for r in c)
                        if p >= quality_rules.LEAST_COVER and (rule or (name, at_least) not in aside):
                            best = max(best, (p * (math.log2(p / len(c)) - math.log2(p0 / len(here))), (name, at_least, i)))
            if not best[0]:
                break
            name, at_least, i = best[1]
            rule.append((name, at_least, steps[name][i]))
        if not rule:
            break
        held = [[bad[r.doc_id] for r in left if not r.grow and met(r, rule[:k])] for k in range(len(rule) + 1)]
        worth = max((((2 * sum(h) - len(h)) / len(h), -k) for k, h in enumerate(held) if k and h), default=(-1.0, 0))
        k = -worth[1]
        if not k or sum(held[k]) < quality_rules.PRECISION * len(held[k]):
            aside.add(rule[0][:2])
            continue
        aside.clear()
        rules.append(rule[:k])
        left = [r for r in left if not met(r, rule[:k])]
    assert rules and [[(n, g, round(t, 9)) for n, g, t in r] for r in found.rules] == [[(n, g, round(t, 9)) for n, g, t in r] for r in rules]


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_is_read_back(spark):
    nasty = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 0, "system", "be <|im_sep|> kind"), (1, 1, "user", "hi\\|<\\|"), (1, 2, "user", None), (1, 3, "assistant", "a\n<|im_end|>\n"), (1, 4, "assistant", ""), (1, 5, "assistant", "<"),
        (2, 0, "assistant", nasty), (2, 0, "assistant", nasty), (3, 0, "odd\nrole\\n<|", "|im_end|>"), (None, 1, None, "x"), (4, None, "user", "later"), (4, 0, "assistant", "\U0001f600é"),
    ]
    turns = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash"))
    formatted = chat.format_conversations(turns)
    out = {r.conv_id: r for r in chat.digests(formatted).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    for c, conversation in by.items():
        conversation.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in conversation)
        learnt = "".join(x for _, r, x in conversation if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(conversation), hashlib.sha256(whole.encode()).hexdigest()), c
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest()), c
    text = {r.conv_id: r.formatted for r in formatted.collect()}
    assert text[1].count("<|im_start|>") == 3 and text[1].count("<|im_sep|>") == 3
    assert chat.digests(chat.format_conversations(turns.limit(0))).count() == 0


def water(sizes, total, weights, cap):
    targets, free = {}, dict(sizes)
    while free:
        left = total - sum(targets.values())
        w = {s: weights[s] for s in free}
        over = [s for s in free if left * w[s] / sum(w.values()) > cap * sizes[s]]
        if not over:
            return targets | {s: left * w[s] / sum(w.values()) for s in free}
        for s in over:
            targets[s] = cap * sizes[s]
            del free[s]
    return targets


def test_mixing_meets_targets(spark, docs):
    out = mixing.mixture_report(docs.withColumn("size", F.lit(-1)).withColumn("target", F.lit("clash"))).collect()
    rows = {}
    for r in docs.collect():
        rows.setdefault(r.doc_id, (len(BLANK.findall(r.text or "")), r.source))
    assert len(out) == docs.count() and all(r["size"] == rows[r.doc_id][0] for r in out)
    sizes, taken, biggest = Counter(), Counter(), Counter()
    for r in out:
        s = rows[r.doc_id][1]
        sizes[s] += r["size"]
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r["size"])
        assert r.taken <= 2 * r["size"]
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    expected = water(sizes, 1.5 * sum(sizes.values()), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 2)
    for r in out:
        s = rows[r.doc_id][1]
        assert r.source_size == sizes[s] and r.target == pytest.approx(expected[s])
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= biggest[s]
    again = mixing.mixture_report(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in out) == Counter((r.doc_id, r.taken) for r in again)


def test_mixing_beyond_the_broadcast_and_with_shared_ids(spark, docs, monkeypatch):
    expected = Counter((r.doc_id, r.size, r.taken) for r in mixing.mixture_report(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter((r.doc_id, r.size, r.taken) for r in mixing.mixture_report(docs).collect()) == expected
    # rows without an id share one place in the order: the border runs through them
    same = corpus(spark, [(None, f"one two three {i}", "en", "a") for i in range(100)] + [(i, "four five", "en", "b") for i in range(50)])
    out = mixing.mixture_report(same, share=0.5).collect()
    taken = sum(r.taken for r in out if r.doc_id is None)
    assert abs(taken - next(r.target for r in out if r.doc_id is None)) <= 4 and len({r.taken for r in out if r.doc_id is None}) == 2


def test_many_sources_are_numbered_in_order(spark):
    names = [f"s{i:04d}" for i in range(500)] + ["é", "Z", ""]
    sources = spark.createDataFrame([(n,) for n in names] + [(None,)], "source string")
    got = {r.source: r.place for r in mixing.numbered(sources).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda x: x.encode()))} | {None: len(names)}


def test_mixed_rows_are_repetitions(spark, docs):
    took = Counter()
    for r in mixing.plan_epochs(docs).collect():
        took[r.row.doc_id] += r.copies
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    assert Counter(r.doc_id for r in rows.collect()) == +took
    assert mixing.mixture_report(docs.limit(0)).count() == 0
