"""Prefix trie of conversations: level-order tries of prefix shards, upper levels merged apart.

A turn stands for its role and text, as a 128-bit digest (two different turns with one
digest: about n^2 / 2^129); texts aren't shuffled. Equal conversations collapse into
one class, with its number and smallest id, before any trie is built.

1. Cuts. A prefix with more than LIMIT classes is heavy; depth 0 always is. Depths 1,
   2, 4, ... are counted for what is under heavy prefixes, until none is left. The
   classes of a light prefix stay together; their subtree hangs below depth `cut` - 1.
2. Shards. Light prefixes are dealt to shards of about PER_SHARD classes by a hash. A
   task numbers the nodes of its shard level by level, which gives the degrees of the
   nodes in that order: the LOUDS bit vector, a one for every child and a zero after
   every node. The parent of the i-th child is the number of zeros before the i-th
   one. Members are added level by level, and leaves and saved tokens are rolled up
   in reverse order, by ``np.add.at`` on the parents.
3. Upper levels. Each top node of a shard adds its totals to the nodes above it, and so
   do classes that end there, by aggregation with a partial step; totals of upper
   nodes are then added to their own ancestors. Upper nodes are as many as heavy
   prefixes and their ancestors, a small share of the classes.

The digest over the ids that end at a node is taken in order, so a class of any number
of conversations is sorted by a range exchange, written as runs of ids, and hashed run
by run; no task holds more than a run.

A conversation's digests and word counts, 24 bytes a turn, are one row, as its
turns are elsewhere; nothing larger is collected but the classes of a light prefix.

Defined cases: a null role or text is empty; a null turn comes first; equal turns of a
conversation are ordered by digest, repeated rows are turns of their own; the remainder
of a negative id is that of SQL, towards zero; rows without a conversation id belong to
none and are left out; an empty table has no node, not even the root; a very long text
is read by Spark expressions alone; only conv_id, turn, role and text are read, so
other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.importance import CRC_TABLE, crc_of
from orrery.llm.support import by_ids, small_batches, word_count, written

LIMIT = 1024
PER_SHARD = 1024
NO_END = hashlib.sha256(b"").hexdigest()


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, digest, words>>) in order, from rows (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    narrow = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", digest.alias("digest"), word_count(text).alias("words")).alias("t"))
    return narrow.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(lists: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, digests, words): the first h turns of the conversation that leads its block of ids, then its own after its first h; h hangs on the id."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = lists.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("lead"), F.slice("turns", 1, most - 1).alias("head"))
    own = lists.withColumn("lead", F.col("conv_id") - F.col("conv_id") % block).join(heads, "lead", "left")
    none = F.slice("turns", 1, 0)
    whole = own.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.lit(2**31 - 1))).alias("t"))
    return whole.select("conv_id", F.transform("t", lambda x: x["digest"]).alias("digests"), F.transform("t", lambda x: x["words"]).alias("words"))


def prefix_id(digests: Column, depth: Column) -> Column:
    return F.md5(F.array_join(F.transform(F.slice(digests, F.lit(1), depth.cast("int")), F.hex), ""))


def end_digests(keyed: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the ids of each key, in order and joined by commas, from rows (key, conv_id)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            at = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            own = [(keys[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*own, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)] if own else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string())], ["key", "low", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            keys, ends = [], []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        keys.append(key)
                        ends.append(state.hexdigest())
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ends, pa.string())], ["key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends"])

    small_batches(keyed.sparkSession)
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ordered.mapInArrow(runs, "key string, low long, ids string")
    return pieces.repartition(parts, "key").sortWithinPartitions("key", "low").mapInArrow(hashed, "key string, ends string")


def classes_of(conversations: DataFrame) -> DataFrame:
    """(key, digests, words, n, least, ends) of the different sequences of turns."""
    keyed = written(conversations.withColumn("key", prefix_id(F.col("digests"), F.size("digests"))), "conversations")
    each = keyed.groupBy("key").agg(F.first("digests").alias("digests"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    return written(each.join(end_digests(keyed.select("key", "conv_id")), "key"), "classes")


def with_cuts(classes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``classes`` with ``cut``, the depth from which on a class lies in a shard; a class that ends above has one more than its length."""
    done, open_, depth = None, classes, 1
    while True:
        size = F.size("digests")
        prefixed = open_.where(size >= depth).withColumn("prefix", prefix_id(F.col("digests"), F.lit(depth)))
        heavy = written(prefixed.groupBy("prefix").count().where(F.col("count") > limit).select("prefix"), "heavy")
        short = open_.where(size < depth).withColumn("cut", size + 1)
        light = by_ids(prefixed, heavy, "left_anti", "prefix").drop("prefix").withColumn("cut", F.lit(depth))
        closed = short.unionByName(light)
        done = closed if done is None else done.unionByName(closed)
        if heavy.isEmpty():
            return done
        open_ = written(by_ids(prefixed, heavy, "left_semi", "prefix").drop("prefix"), "open")
        depth *= 2


class LevelTrie:
    """A forest in level order below a root: LOUDS bits, the label of every node but the root, and where each sequence ends.

    ``labels`` are integers of all sequences, one after the other, bounded by ``offsets``.
    """

    def __init__(self, labels: np.ndarray, offsets: np.ndarray):
        lengths, starts = np.diff(offsets), offsets[:-1]
        kinds, at = int(labels.max(initial=0)) + 1, np.zeros(len(lengths), np.int64)
        degrees, parts, self.levels, self.steps, self.places = [np.zeros(1, np.int64)], [], [0, 1], [], []
        for depth in range(int(lengths.max(initial=0))):
            active = np.flatnonzero(lengths > depth)
            place = starts[active] + depth
            pairs, first, inverse = np.unique(at[active] * kinds + labels[place], return_index=True, return_inverse=True)
            degrees[-1] += np.bincount(pairs // kinds - self.levels[-2], minlength=len(degrees[-1]))
            at[active] = self.levels[-1] + inverse
            parts.append(pairs % kinds)
            degrees.append(np.zeros(len(pairs), np.int64))
            self.levels.append(self.levels[-1] + len(pairs))
            self.steps.append((active, at[active]))
            self.places.append(place[first])
        self.degrees, self.ends = np.concatenate(degrees), at
        self.labels = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.first = np.concatenate(self.places) if parts else np.zeros(0, np.int64)
        self.bits = np.ones(len(self.degrees) + len(self.labels), bool)
        self.bits[np.cumsum(self.degrees) + np.arange(len(self.degrees))] = False

    def parents(self) -> np.ndarray:
        """Of every node but the root: the zeros before its one."""
        return np.cumsum(~self.bits)[self.bits]

    def members(self, count: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of ``count`` and minima of ``least`` over the sequences through each node; the root has none."""
        total, low = np.zeros(len(self.degrees), np.int64), np.full(len(self.degrees), np.iinfo(np.int64).max)
        for active, nodes in self.steps:
            np.add.at(total, nodes, count[active])
            np.minimum.at(low, nodes, least[active])
        return total, low

    def rolled_up(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees, from the last level to the first."""
        total, parents = own.copy(), self.parents()
        for low, high in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            np.add.at(total, parents[low - 1 : high - 1], total[low:high])
        return total


def shard_trie(table: pa.Table) -> tuple[LevelTrie, np.ndarray, np.ndarray]:
    """The trie of a shard's rows, its different labels (16 bytes each), and the words of each place."""
    lists = table.column("labels").combine_chunks()
    flat = np.frombuffer(b"".join(lists.flatten().to_pylist()), "V16")
    words = table.column("words").combine_chunks().flatten().to_numpy()
    names, labels = np.unique(flat, return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return LevelTrie(labels, offsets), names, words


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def shard_nodes(table: pa.Table) -> pa.Table:
    """Node rows of a shard; the rows of top nodes also have the ids and words of their path."""
    trie, _, words = shard_trie(table)
    count, least, cut = (table.column(c).to_numpy() for c in ("n", "least", "cut"))
    n_convs, low = trie.members(count, least)
    own = np.zeros(len(trie.degrees), np.int64)
    own[1:] = (n_convs[1:] - 1) * words[trie.first]
    n_leaves, saved = trie.rolled_up((trie.degrees == 0).astype(np.int64)), trie.rolled_up(own)
    level = np.repeat(np.arange(len(trie.levels) - 1), np.diff(trie.levels))
    base = np.zeros(len(trie.degrees), np.int64)
    parents, tops = np.concatenate([[0], trie.parents()]), trie.levels[2] - 1
    if trie.steps:
        base[trie.steps[0][1]] = cut
    for start, end in zip(trie.levels[2:-1], trie.levels[3:], strict=True):
        base[start:end] = base[parents[start:end]]
    ends = np.full(len(trie.degrees), NO_END, object)
    ends[trie.ends] = table.column("ends").to_pylist()
    top_rows = np.zeros(len(trie.degrees), np.int64)
    top_rows[trie.steps[0][1][::-1]] = np.arange(len(cut))[::-1]
    paths = table.select(["path", "path_words"]).take(pa.array(top_rows[1 : tops + 1]))
    rest = len(trie.degrees) - 1 - tops
    return pa.table(
        {
            "conv_id": low[1:],
            "depth": (base + level - 1)[1:],
            "parent_conv_id": pa.array(low[parents[1:]], mask=np.arange(1, len(parents)) <= tops),
            "n_convs": n_convs[1:],
            "n_children": trie.degrees[1:],
            "n_leaves": n_leaves[1:],
            "saved_tokens": saved[1:],
            "ends_sha256": pa.array(ends[1:], pa.string()),
            "path": pa.chunked_array([*paths.column("path").chunks, pa.nulls(rest, paths.column("path").type)]),
            "path_words": pa.chunked_array([*paths.column("path_words").chunks, pa.nulls(rest, paths.column("path_words").type)]),
        }
    )


def in_shards(cuts: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """Classes that reach a shard: (shard, cut, labels, words, n, least, ends, path, path_words); a label for the whole prefix comes first."""
    deep = cuts.where(F.size("digests") >= F.col("cut"))
    shards = max(1, -(-deep.count() // per_shard))
    top = prefix_id(F.col("digests"), F.col("cut"))
    above = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda d: prefix_id(F.col("digests"), d))
    labels = F.concat(F.array(F.unhex("top")), F.slice("digests", F.col("cut") + 1, F.lit(2**31 - 1)))
    return deep.withColumn("top", top).select(
        F.pmod(F.xxhash64("top"), F.lit(shards)).alias("shard"),
        F.col("cut").cast("long").alias("cut"),
        labels.alias("labels"),
        F.slice("words", F.col("cut"), F.lit(2**31 - 1)).alias("words"),
        "n",
        "least",
        "ends",
        above.alias("path"),
        F.concat(F.array(F.lit(0).cast("long")), F.slice("words", F.lit(1), F.col("cut") - 1)).alias("path_words"),
    )


def encoded_tries(cuts: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """(shard, nodes, louds, labels) for storage: bits packed into bytes, 16 bytes for the label of each node but the root."""

    def pack(table: pa.Table) -> pa.Table:
        trie, names, _ = shard_trie(table)
        row = {"shard": table.column("shard")[:1], "nodes": [len(trie.degrees)], "louds": [np.packbits(trie.bits).tobytes()], "labels": [names[trie.labels].tobytes()]}
        return pa.table({k: pa.array(v.to_pylist() if isinstance(v, pa.ChunkedArray) else v) for k, v in row.items()})

    return in_shards(cuts, per_shard).groupBy("shard").applyInArrow(pack, "shard long, nodes long, louds binary, labels binary")


def prefix_nodes(conversations: DataFrame, limit: int = LIMIT, per_shard: int = PER_SHARD) -> DataFrame:
    """A row for every node of the trie of (conv_id, digests, words)."""
    cuts = with_cuts(classes_of(conversations), limit)
    inside = written(in_shards(cuts, per_shard).groupBy("shard").applyInArrow(shard_nodes, f"{NODE}, path array<string>, path_words array<long>"), "nodes")
    tops = inside.where("path IS NOT NULL")

    def above(rows: DataFrame, n: Column, least: Column, leaves: Column, saved: Column, child: Column, ends: Column) -> DataFrame:
        spread = rows.select("*", F.posexplode("path").alias("at", "id"))
        here = F.col("at") == F.size("path") - 1
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
        return spread.select(
            "id", F.col("at").cast("long").alias("depth"), F.get("path_words", F.col("at")).alias("words"), F.slice("path", F.lit(1), F.col("at") + 1).alias("path"),
            n.alias("n"), least.alias("least"), leaves.alias("leaves"), saved.alias("saved"), F.when(here, child).otherwise(zero).alias("children"), F.when(here, ends).otherwise(none).alias("ends"),
        )

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    ending = cuts.where(F.size("digests") < F.col("cut")).select(
        "n", "least", "ends", F.transform(F.sequence(F.lit(0), F.size("digests")), lambda d: prefix_id(F.col("digests"), d)).alias("path"), F.concat(F.array(zero), "words").alias("path_words")
    )
    sources = above(tops, F.col("n_convs"), F.col("conv_id"), F.col("n_leaves"), F.col("saved_tokens"), F.lit(1).cast("long"), none).unionByName(
        above(ending, F.col("n"), F.col("least"), zero, zero, zero, F.col("ends"))
    )
    merged = sources.groupBy("id", "depth").agg(
        F.first("words").alias("words"), F.first("path").alias("path"), F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("children").alias("children"), F.max("ends").alias("ends")
    )
    upper = written(merged.withColumn("parent", F.get("path", F.col("depth").cast("int") - 1)), "upper")
    inner = upper.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("more"))
    full = written(upper.join(inner, "id", "left").withColumn("children", F.col("children") + F.coalesce("more", zero)).drop("more"), "upper")
    own = full.select(F.explode("path").alias("id"), ((F.col("n") - 1) * F.col("words")).alias("own"), (F.col("children") == 0).cast("long").alias("leaf"))
    sums = own.groupBy("id").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    parents = full.select(F.col("id").alias("parent"), F.col("least").alias("parent_conv_id"))
    top_levels = full.join(sums, "id").join(parents, "parent", "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        (F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved") + F.col("own")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_END)).alias("ends_sha256"),
    )
    columns = top_levels.columns
    placed = by_ids(tops.drop("parent_conv_id").withColumn("parent", F.element_at("path", -1)), parents, "inner", "parent")
    return inside.where("path IS NULL").select(*columns).unionByName(placed.select(*columns)).unionByName(top_levels)


SQL = f"""
WITH RECURSIVE {CRC_TABLE},
  turns AS (
    SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS rn
    FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
  convs AS (
    SELECT conv_id, {crc_of('x')} % 4 AS h FROM (SELECT DISTINCT conv_id, hex(encode(conv_id::VARCHAR)) AS x FROM turns), crc_table),
  placed AS (
    SELECT c.conv_id, 0 AS part, rn, digest, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND rn <= h
    UNION ALL SELECT c.conv_id, 1, rn, digest, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND rn > h),
  lists AS (
    SELECT c.conv_id, coalesce(list(digest ORDER BY part, rn) FILTER (WHERE digest IS NOT NULL), []) AS g, list(words ORDER BY part, rn) AS w
    FROM convs c LEFT JOIN placed p ON p.conv_id = c.conv_id GROUP BY c.conv_id),
  steps AS (SELECT conv_id, g, w, unnest(range(len(g) + 1)) AS d FROM lists),
  nodes AS (
    SELECT array_to_string(g[1:d], '') AS id, d AS depth, min(CASE WHEN d > 0 THEN array_to_string(g[1:d - 1], '') END) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
      coalesce(min(w[d]), 0) AS words, min(g[1:d]) AS path,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(g) = d), '')) AS ends_sha256
    FROM steps GROUP BY 1, 2),
  kids AS (SELECT parent AS id, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
  known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.id = n.id),
  sums AS (
    SELECT array_to_string(path[1:a], '') AS id, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
    FROM (SELECT *, unnest(range(depth + 1)) AS a FROM known) GROUP BY 1)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs, n.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM known n JOIN sums s ON s.id = n.id LEFT JOIN nodes p ON p.id = n.parent AND n.depth > 0
"""
