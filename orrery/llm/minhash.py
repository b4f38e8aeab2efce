"""Near-duplicates by bottom-k sketches from one hash function.

1. Each text becomes the set of its hashed word shingles; the K smallest hashes
   are its sketch. Texts with equal sets are one class, whose smallest id stands
   for it; only these representatives go on.
2. Inverted lists of retained values. Of the K smallest values of the union of
   two sets of similarity 0.8, each is in both with a chance of 0.8, so two
   sketches share fewer than T = 24 of K = 48 values in fewer than one pair in
   10^6 (binomial; the true draw, without putting back, is narrower, and pairs of
   greater similarity, or with a third document between them, are safer). Pairs that
   share T values also share one among the K - T + 1 rarest of each (the
   pigeonhole that prefix filters rest on), so a document enters the lists of its
   rarest values only, and what very many documents share makes no long lists.
   A set of fewer than K shingles is its own sketch; there the bound is exact.
3. Links, without all pairs of a list. First, each list links its members with its
   smallest member. Pairs whose sizes or whose estimate from the union sketch rule
   a link out are dropped, all others are verified on the full sets. Then members
   of a list that are still in different components are paired, those outside the
   list's largest component with all others, and verified in the same way. Within
   a component nothing is left to find, so no link between components is lost. The
   documents in lists of more than LONG members get exact lists first: their whole
   sets, rarest shingle first, where the place of a shared shingle bounds what two
   documents can share from there on, so that pairs are made only where they can be
   links. In a large group of loose copies the smallest member is like only some of
   the others, so rounds of HUBS members of each list join most of the
   group with pairs in proportion to the lists: first those that share most with all,
   then drawn ones; what they leave open is paired whole. Full sets are made once for
   each text and written.

Hot values, lists and classes are counted with partial aggregates; the counts are
written before they are joined on a value, so Spark can split the join at a frequent
one. Nothing gathers a list, a class or a component. Pairs of a list are made within
neighbouring bands of set sizes only.

Defined cases: a null or blank text has an empty set and is linked with nothing;
rows that share an id are one document: :func:`near_duplicates` links it wherever one
of its texts is, :func:`deduplicated` judges each row by its own text and drops no
text that isn't like another; a null id is never linked, and its row is kept; repeated
rows (id and text) are one; texts of any length are whole sets in the exact steps; an
empty table gives an empty result; only doc_id and text are read, so other columns
can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.shingles import shingle_sets
from orrery.llm.support import by_ids, components, cut, joined, small_batches, values, written

K, T = 48, 24
#: The similarity that T and the bound of small sets are made for.
LEAST_PERCENT = 80
#: Members of a list from which on it is paired with bounds from full sets.
LONG = 32
#: Members of such a list that a round pairs with all others, before the rest is paired whole.
HUBS = 16


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, digest (of the whole set; null if empty), sketch of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for s in shingle_sets(values(batch.column("text")), n):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketches.append(_signed(s[:K]))
            offsets = np.cumsum([0] + [len(s) for s in sketches], dtype=np.int32)
            flat = np.concatenate([*sketches, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "t", "n_shingles", "digest", "sketch"],
            )

    return _texts(docs).mapInArrow(sign, "doc_id long, t long, n_shingles long, digest binary, sketch array<long>")


def _signed(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as longs in the same order; a copy, as a view of a sketch would keep the whole set."""
    return (hashes ^ np.uint64(1 << 63)).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def rare_values(reps: DataFrame) -> DataFrame:
    """(v, node, n): the inverted lists, each text in those of its rarest values."""
    entries = reps.select("node", "n", F.explode("sketch").alias("v"))
    often = cut(entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    shared = entries.join(often, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s"))
    have = F.least(F.col("n"), F.lit(K)).cast("int")
    least = F.when(F.col("n") >= K, F.lit(T)).otherwise(F.least(F.lit(T), F.ceil(F.col("n") * 0.8).cast("int")))
    # values of one text alone come first in the order, and lead to no one
    room = have - least + 1 - (have - F.size("s"))
    return shared.where(room > 0).select("node", "n", F.explode(F.slice("s", F.lit(1), room)).alias("x")).select("x.v", "node", "n")


def sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, whole): the full shingle sets of ``nodes`` (node, doc_id, t), already materialised; made once for each."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_signed(s) for s in shingle_sets(values(batch.column("text")), n)]
            offsets = np.cumsum([0] + [len(s) for s in sets], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "whole"])

    texts = by_ids(_texts(docs), nodes, "inner", ["doc_id", "t"]).select("node", "text")
    return written(texts.mapInArrow(whole, "node long, whole array<long>").dropDuplicates(["node"]), "sets")  # of repeated rows one


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the similarity: sizes, estimate, then exact."""
    one = reps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = reps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    both = both.withColumn("same", F.array_intersect("sa", "sb"))
    both = both.where(F.size("same") >= F.least(F.lit(T), F.ceil(F.least("na", "nb") * 0.8)))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K)
    likely = cut(both.where(F.size(F.array_intersect("same", union)) * K >= T * F.size(union)).select("a", "b"))

    nodes = cut(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct().join(reps.select("node", "doc_id", "t"), "node"))
    sets = sets_of(docs, nodes, n)
    held = likely.join(sets.toDF("b", "wb"), "b").join(sets.toDF("a", "wa"), "a")
    inter = F.size(F.array_intersect("wa", "wb"))
    return cut(held.where(100 * inter >= percent * (F.size("wa") + F.size("wb") - inter)).select("a", "b"))


def full_prefixes(docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """(v, node, n, room, near): lists of whole shingle sets, of these texts alone.

    The shingles of a set are put in order, rarest among these texts first. Two
    sets of the similarity share one of the first n - ceil(percent n / 100) + 1 of
    each, and from the first that they share on they have at most ``room`` shingles.
    ``near`` is the sum of a text's intersections with all of these texts over its
    size: greatest for what lies in the middle of a group.
    """
    every = sets_of(docs, nodes, n).select("node", F.explode("whole").alias("g"))
    counted = every.join(cut(every.groupBy("g").agg(F.count("*").alias("m"))), "g")
    ordered = counted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("m", "g"))).alias("s"), F.avg("m").alias("near"))  # the shingles of one text
    size = F.size("s")
    first = F.slice("s", F.lit(1), size - F.ceil(size * percent / 100).cast("int") + 1)
    placed = ordered.select("node", "near", size.cast("long").alias("n"), F.posexplode(first).alias("i", "x"))
    return cut(placed.where("x.m > 1").select(F.col("x.g").alias("v"), "node", "n", (F.col("n") - F.col("i")).alias("room"), "near"))


def open_lists(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Lists (v, node, n, room) that hold texts of different components: adds c, in_main, whole."""
    members = lists.join(found.withColumnRenamed("component", "c"), "node", "left").select(*lists.columns, F.coalesce("c", "node").alias("c"))
    parts = members.groupBy("v", "c").agg(F.count("*").alias("m")).groupBy("v").agg(F.count("*").alias("parts"), F.sum("m").alias("whole"), F.max_by("c", F.struct("m", "c")).alias("main")).where("parts > 1")
    return cut(members.join(cut(parts), "v").select(*lists.columns, "c", (F.col("c") == F.col("main")).alias("in_main"), "whole"))


def hub_pairs(members: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b, stands), a > b: members outside their list's largest component with HUBS members of it, one of each part that
    the turn's hash makes: the nearest to all in the first turn, then drawn ones. A pair stands for so many that the whole
    list would make."""
    drawn = F.xxhash64("node", F.lit(turn))
    order = F.col("near") if turn == 0 else F.lit(0.0)
    hub = F.max(F.struct(order.alias("o"), drawn.alias("h"), F.col("node").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("room").alias("my"))).alias("hub")
    hubs = cut(members.groupBy("v", F.pmod(drawn, F.lit(HUBS)).alias("part")).agg(hub).select("v", "hub.*"))
    can = (100 + percent) * F.least("room", "my") >= percent * (F.col("n") + F.col("ny"))
    pairs = members.where("NOT in_main").join(hubs, "v").where((F.col("c") != F.col("cy")) & can)
    return pairs.groupBy(F.greatest("node", "y").alias("a"), F.least("node", "y").alias("b")).agg((F.max("whole") / HUBS).alias("stands"))


def open_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b), a > b: pairs of a list in different components that can reach the similarity.

    ``room`` bounds what a text can have in common with another of the list, and so the
    similarity of a pair, before the pair is made. A list of up to LONG members is joined as it
    is; in longer ones, sizes of such a pair differ by the similarity at most, so they lie in
    neighbouring bands of a log scale, and pairs are made within those alone.
    """
    band = F.floor(F.ln("n") / math.log(100 / min(percent, 99))).cast("int")
    named = members.select("v", "whole", "in_main", band.alias("band"), "node", "c", "n", "room")
    outside = named.where("NOT in_main").toDF("v", "wx", "main_x", "band", "x", "cx", "nx", "mx")
    every = named.toDF("w", "wy", "main_y", "band_y", "y", "cy", "ny", "my")
    can = (F.col("cx") != F.col("cy")) & ((100 + percent) * F.least("mx", "my") >= percent * (F.col("nx") + F.col("ny"))) & (F.col("main_y") | (F.col("x") > F.col("y")))
    short = outside.where(F.col("wx") <= LONG).join(every.where(F.col("wy") <= LONG), (F.col("v") == F.col("w")) & can)
    spread = outside.where(F.col("wx") > LONG).withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    long = spread.join(every.where(F.col("wy") > LONG), (F.col("v") == F.col("w")) & (F.col("band") == F.col("band_y")) & can)
    pairs = short.select("x", "y").unionByName(long.select("x", "y"))
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def linked_classes(docs: DataFrame, n: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """(signatures, named): ``named`` has for each digest its text's place (doc_id, t) and that of its whole
    group, ``first``, as the smallest structs (doc_id, t). With ``by_id``, texts that share an id are linked."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent has to be {LEAST_PERCENT} to 100: T and K would lose links below")
    small_batches(docs.sparkSession)
    sigs = cut(signatures(docs, n))
    known = sigs.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # one node for each class of equal sets: its text of the smallest (doc_id, t)
    classes = cut(known.groupBy("digest").agg(F.min(F.struct("doc_id", "t")).alias("at")).withColumn("node", F.monotonically_increasing_id()))
    own = F.struct("doc_id", "t")
    reps = known.join(classes, "digest").where(own == F.col("at")).select("node", "doc_id", "t", F.col("n_shingles").alias("n"), "sketch")
    reps = cut(reps.dropDuplicates(["node"]))  # repeated rows
    lists = cut(rare_values(reps))

    hubs = cut(lists.groupBy("v").agg(F.min("node").alias("b"), F.count("*").alias("m")).where("m > 1").drop("m"))
    first = cut(lists.join(hubs, "v").where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    links = verified(first, reps, docs, n, percent)

    found = components(links)
    open_ = open_lists(lists.withColumn("room", F.col("n")), found)
    long = cut(open_.where(F.col("whole") > LONG).select("node").distinct().join(reps.select("node", "doc_id", "t"), "node"))
    prefixes, tried, texts = full_prefixes(docs, long, n, percent), first, reps.count()
    more, least, turn = open_pairs(open_.where(F.col("whole") <= LONG), percent), math.inf, 0
    while True:
        members = open_lists(prefixes, found)
        drawn = cut(hub_pairs(members, percent, turn).join(tried, ["a", "b"], "left_anti"))
        pairs = drawn.agg(F.coalesce(F.sum("stands"), F.lit(0))).first()[0]
        last = not pairs or turn > 0 and (pairs <= texts or pairs > least / 2)  # no more pairs than texts, or rounds that join little more
        more = more.unionByName(open_pairs(members, percent) if last else drawn.select("a", "b"))
        more = cut(more.distinct().join(tried, ["a", "b"], "left_anti"))
        links = verified(more, reps, docs, n, percent)
        if last:
            break
        found, tried, least, turn = joined(found, links), tried.unionByName(more), pairs, turn + 1
        more = more.limit(0)
    if by_id:
        shared = known.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
        nodes = known.join(cut(shared), "doc_id").select("doc_id", "digest").distinct().join(classes, "digest").select(known.doc_id, "node")
        links = links.unionByName(nodes.join(cut(nodes.groupBy("doc_id").agg(F.min("node").alias("b"))), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b"))

    whole = cut(classes.join(joined(found, links), "node", "left").select("digest", "at", F.coalesce("component", "node").alias("component")))
    groups = cut(whole.groupBy("component").agg(F.min("at").alias("first")))
    return sigs, cut(whole.join(groups, "component").select("digest", "at", "first"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: shingles of n words, similarity of percent / 100, from 80 on."""
    sigs, named = linked_classes(docs, n, percent, by_id=True)
    out = sigs.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one text of each group, that of the smallest id; of rows equal in id and text one stays."""
    sigs, named = linked_classes(docs, n, percent, by_id=False)
    own = F.struct("doc_id", "t")
    judged = sigs.where("doc_id IS NOT NULL").select("doc_id", "t", "digest").join(named.select("digest", "first"), "digest", "left")
    gone = cut(judged.where(F.col("first").isNotNull() & (own != F.col("first"))).select("doc_id", "t").distinct())
    twice = cut(sigs.where("doc_id IS NOT NULL").groupBy("doc_id", "t").count().where("count > 1").select("doc_id", "t"))
    keys = ["doc_id", "t"]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"))
    rest = by_ids(held, gone, "left_anti", keys)
    once = by_ids(rest, twice, "left_anti", keys).select("row.*")
    return once if twice.isEmpty() else once.unionByName(by_ids(rest, twice, "left_semi", keys).dropDuplicates(keys).select("row.*"))


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sized AS (SELECT s.*, n.n FROM s JOIN n ON n.doc_id = s.doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sized x JOIN sized y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_ AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, t.doc_id = c AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN least_ ON least_.a = t.doc_id
"""
