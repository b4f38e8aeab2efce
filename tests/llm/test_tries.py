"""The prefix trie of conversations, against plain Python."""

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

from orrery.llm import tries

TURN = "conv_id long, turn long, role string, text string"
NONE = hashlib.sha256(b"").hexdigest()


def plainly(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [(x[3], x[4]) for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sorted(whole.items()):
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        tokens = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * tokens
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def nodes(spark, rows, **limits):
    turns = spark.createDataFrame(rows, TURN).select("*", *[F.lit("clash").alias(c) for c in ("n", "key", "words", "digests", "lead", "h", "least", "path")]).repartition(3)
    return tries.prefix_nodes(tries.rebuilt(tries.turn_lists(turns)), **limits)


def some_rows(seed, convs, kinds=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        for k in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([k, k, k, None, 2]), rng.choice(["user", "assistant", None, ""]), rng.choice([None, "", "a b", "c  d\te", "long " * 40][:kinds])))
    return rows


@pytest.mark.parametrize("limit", [1, 3, 1024])
def test_nodes_against_plain_python(spark, limit):
    rows = some_rows(limit, 60)
    rows += [(c, k, "user", f"x{min(c % 3, k)}") for c in range(200, 260) for k in range(9)]
    rows += [(300, 0, "u", "once"), (300, 0, "u", "once"), (None, 0, "u", "no id"), (-7, 0, "u", "below"), (301, 0, "u", "word " * 100_000)]
    found = nodes(spark, rows, limit=limit, per_shard=2)
    assert Counter(map(tuple, found.collect())) == plainly(rows)


def test_copies_and_chains(spark):
    chain = [(1000, k, "u", f"t{k}") for k in range(300)] + [(1001, k, "u", f"t{k}") for k in range(200)]
    copies = [(c, k, "u", f"same {k}") for c in range(3000, 5500) for k in range(2)]
    for limit in (1, 100):
        found = nodes(spark, chain + copies, limit=limit)
        assert Counter(map(tuple, found.collect())) == plainly(chain + copies)


def test_empty_and_turnless(spark):
    assert nodes(spark, [(1, 0, "u", "x")]).where("false").count() == 0
    assert nodes(spark, [(None, 0, "u", "x")]).count() == 0
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, k, "u", "gone") for k in range(2)]  # its first turns would come from a conversation that isn't there
    assert list(map(tuple, nodes(spark, rows).collect())) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_level_order_tries_hold_their_sequences():
    rng = random.Random(4)
    for _ in range(200):
        seqs = list({tuple(rng.randint(0, 2) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 20))})
        trie = tries.LevelTrie(np.array([x for s in seqs for x in s]), np.concatenate([[0], np.cumsum([len(s) for s in seqs])]))
        paths = [()]
        for label, parent in zip(trie.labels.tolist(), trie.parents().tolist(), strict=True):
            paths.append((*paths[parent], label))
        assert sorted(paths[1:]) == sorted({s[:d] for s in seqs for d in range(1, len(s) + 1)})
        assert [paths[e] for e in trie.ends] == seqs
        assert len(trie.bits) == 2 * len(paths) - 1 and trie.bits.sum() == len(paths) - 1
        assert [len(p) for p in paths] == sorted(len(p) for p in paths)
        own = np.arange(len(paths))
        assert trie.rolled_up(own).tolist() == [sum(j for j, q in enumerate(paths) if q[: len(p)] == p) for p in paths]


def test_stored_tries_rebuild_the_classes(spark):
    rows = some_rows(8, 80)
    turns = tries.rebuilt(tries.turn_lists(spark.createDataFrame(rows, TURN)))
    cuts = tries.with_cuts(tries.classes_of(turns), 5)
    want = {(r.shard, *map(bytes, r.labels[:k])) for r in tries.in_shards(cuts, 10).collect() for k in range(1, len(r.labels) + 1)}
    have = set()
    for r in tries.encoded_tries(cuts, 10).collect():
        bits = np.unpackbits(np.frombuffer(r.louds, np.uint8))[: 2 * r.nodes - 1].astype(bool)
        parents, labels = np.cumsum(~bits)[bits], [bytes(r.labels[k : k + 16]) for k in range(0, len(r.labels), 16)]
        paths = [(r.shard,)]
        for parent, label in zip(parents.tolist(), labels, strict=True):
            paths.append((*paths[parent], label))
        have.update(paths[1:])
    assert have == want
