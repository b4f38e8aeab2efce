"""Sharding by a k-d tree over document metadata, in Spark expressions.

The tree starts with one node. Each level splits every node of more than
``target_bytes`` along the dimension in which it is widest (its range against the
range of the whole table) at the weighted median of the bytes, until all leaves
reach the target; a node of one row is a leaf, whatever its size. With ``shards``
instead, the number of leaves is fixed: the target is the bytes divided by it, and
a node that has to become an odd number of shards is split at the fitting quantile
instead of the median. Leaves are numbered in the order of the tree.

A median is found by histograms: one aggregation counts the bytes of every open
node in ``BINS`` bins, a window over the bins picks the one that holds the median,
and the next pass zooms into it, until a border between bins lies within
``SLACK`` of the node's bytes. Rows of equal value in the dimension are told apart
by a hash of the text and then by a hash of the id, so a dimension with few values
can be halved as well, and equal texts of equal metadata part only where keeping
them together would cost more than ``SLACK``. The driver sees one row per node and
pass; it never sees documents.

Numbers within a shard come from counts by (shard, hash slice of the id) and a
row number inside each slice, so no task has to number a whole shard.

Defined cases: a null text has size 1 and the checksum of an empty text; null
metadata counts as 0; repeated rows are rows of their own; fewer rows than
shards leave shards empty; an empty table gives an empty result; only the
needed columns are read, so others can't clash. A text is one row, however long: it
makes its leaf larger than the target where it is larger itself. Of equal texts,
those of equal metadata stay together where a split within SLACK allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.support import cut, unit_hash

BINS = 2048
#: Of the bytes of a node, how far from its median a split may lie.
SLACK = 0.001
#: Rows that one slice of a shard should have at most when it is numbered.
SLICE_ROWS = 100_000


def default_dimensions() -> list[Column]:
    """Size on a log scale, language and the share of multi-byte characters: equal texts of a language agree in all."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        F.log2(F.octet_length(text).cast("double") + 1),
        F.crc32(F.coalesce(F.col("lang"), F.lit(""))).cast("double") / F.lit(float(2**32)),
        F.char_length(text).cast("double") / (F.octet_length(text).cast("double") + 1),
    ]


def points_of(docs: DataFrame, dims: Sequence[Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.array(*[F.coalesce(d.cast("double"), F.lit(0.0)) for d in dims]).alias("dims"),
        unit_hash(text).alias("by_text"),
        unit_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("by_id"),
    )


def _rows(points: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as literals, so that no Python worker has to start for them."""
    fields = [f.split() for f in schema.split(", ")]
    structs = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields, strict=True)]) for row in rows]
    return points.sparkSession.range(1).select(F.inline(F.array(*structs)))


def _states(points: DataFrame, nodes: list[dict]) -> DataFrame:
    """One row for each open node; there are fewer than shards."""
    return _rows(
        points,
        [(n["node"], n["dim"], n["key"], n["from"], n["to"], n["is0"], n["is1"], n["below"], n["goal"]) for n in nodes],
        "node long, dim int, key int, v0 double, v1 double, is0 double, is1 double, below double, goal double",
    )


def _value(i: Column) -> Column:
    return F.when(i == 0, F.get("dims", F.col("dim"))).when(i == 1, F.col("by_text")).otherwise(F.col("by_id"))


def _zoom(points: DataFrame, nodes: list[dict]) -> list[dict]:
    """For each open node, the bin that holds its median."""
    at = points.join(F.broadcast(_states(points, nodes)), "node")  # fewer rows than shards
    here = ((F.col("key") < 1) | (F.get("dims", F.col("dim")) == F.col("is0"))) & ((F.col("key") < 2) | (F.col("by_text") == F.col("is1")))
    v = _value(F.col("key"))
    span = F.col("v1") - F.col("v0")
    slot = F.when(span > 0, F.least(F.floor((v - F.col("v0")) / span * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")
    bins = at.where(here & (v >= F.col("v0")) & (v <= F.col("v1"))).groupBy("node", "below", "goal", slot.alias("slot")).agg(F.sum("size").alias("w"), F.min(v).alias("mn"), F.max(v).alias("mx"))
    run = Window.partitionBy("node").orderBy("slot")
    up = bins.withColumn("end", F.col("below") + F.sum("w").over(run)).withColumn("last", F.max("slot").over(Window.partitionBy("node")))
    held = up.where((F.col("end") >= F.col("goal")) | (F.col("slot") == F.col("last")))
    return held.groupBy("node").agg(F.min_by(F.struct("w", "mn", "mx", "end"), "slot").alias("b")).select("node", "b.*").collect()


def _split(points: DataFrame, nodes: list[dict]) -> None:
    """Adds the cut of each node: dim, key, is0, is1, value, inclusive."""
    open_ = {n["node"]: n for n in nodes}
    while open_:
        for r in _zoom(points, list(open_.values())):
            n = open_[r["node"]]
            start, end, mn, mx = r["end"] - r["w"], r["end"], r["mn"], r["mx"]
            near = min((abs(start - n["goal"]), 0), (abs(end - n["goal"]), 1))
            single = mn == mx
            if near[0] <= SLACK * n["bytes"] or (single and n["key"] == 2):
                n |= {"value": mx if near[1] else mn, "inclusive": bool(near[1])}
                del open_[r["node"]]
            elif single:
                n |= {f"is{n['key']}": mn, "key": n["key"] + 1, "from": 0.0, "to": 1.0, "below": start}
            else:
                n |= {"from": mn, "to": mx, "below": start}


def _assign(points: DataFrame, nodes: list[dict]) -> DataFrame:
    cuts = _rows(
        points,
        [(n["node"], n["dim"], n["key"], n["is0"], n["is1"], n["value"], n["inclusive"]) for n in nodes],
        "node long, dim int, key int, is0 double, is1 double, value double, inclusive boolean",
    )
    at = points.join(F.broadcast(cuts), "node", "left")  # fewer rows than shards
    first, bound = F.get("dims", F.col("dim")), F.col("value")
    v = _value(F.col("key"))
    within = (v < bound) | (F.col("inclusive") & (v == bound))
    left = (
        F.when(F.col("key") == 0, within)
        .when(F.col("key") == 1, (first < F.col("is0")) | ((first == F.col("is0")) & within))
        .otherwise((first < F.col("is0")) | ((first == F.col("is0")) & ((F.col("by_text") < F.col("is1")) | ((F.col("by_text") == F.col("is1")) & within))))
    )
    child = 2 * F.col("node") + F.when(left, 0).otherwise(1)
    return at.withColumn("node", F.when(F.col("key").isNull(), F.col("node")).otherwise(child)).select(*points.columns)


def kd_tree(points: DataFrame, n_dims: int, shards: int | None, target_bytes: int | None) -> tuple[DataFrame, list[dict], list[int], int]:
    """(points with their leaf as node, the cuts, the leaves in order, number of rows).

    The children of node i are 2 i and 2 i + 1. The driver sees one row per node.
    """
    points = cut(points.withColumn("node", F.lit(1).cast("long")))
    whole: list[float] = []
    rows, level, goal, cuts, leaves, had = 0, 0, {1: shards or 0}, [], set(), dict[int, int]()
    while True:
        spans = [f(F.get("dims", F.lit(i))).alias(f"{k}{i}") for i in range(n_dims) for k, f in (("mn", F.min), ("mx", F.max))]
        stats = points.groupBy("node").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *spans).collect()  # one row per node
        if not level and stats:
            rows = stats[0]["n"]
            whole = [stats[0][f"mx{i}"] - stats[0][f"mn{i}"] or 1.0 for i in range(n_dims)]
        nodes = []
        for s in stats:
            node = s["node"]
            whole_parent = not shards and had.get(node // 2) == s["n"]  # rows that are equal in everything can't be split
            if s["n"] < 2 or whole_parent or (goal[node] < 2 if shards else s["bytes"] <= target_bytes):
                leaves.add(node)
            if node in leaves:
                continue
            had[node] = s["n"]
            _, dim = max(((s[f"mx{i}"] - s[f"mn{i}"]) / whole[i], -i) for i in range(n_dims))
            left = (goal[node] + 1) // 2
            share = left / goal[node] if shards else 0.5
            goal |= {2 * node: left, 2 * node + 1: goal[node] - left}
            nodes.append({"node": node, "dim": -dim, "key": 0, "is0": None, "is1": None, "from": s[f"mn{-dim}"], "to": s[f"mx{-dim}"], "below": 0.0, "goal": s["bytes"] * share, "bytes": s["bytes"]})
        if not nodes:
            break
        _split(points, nodes)
        cuts += nodes
        points = _assign(points, nodes)
        level += 1
        if level % 3 == 0:
            points = cut(points)
    deepest = max((x.bit_length() for x in leaves), default=1)
    return points, cuts, sorted(leaves, key=lambda x: x << (deepest - x.bit_length())), rows


def kd_shards(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, dims: Sequence[Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; give ``shards`` or ``target_bytes``."""
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    dims = default_dimensions() if dims is None else dims
    points, _, leaves, rows = kd_tree(points_of(docs, dims), len(dims), shards, target_bytes)
    shard = F.array_position(F.array(*[F.lit(x).cast("long") for x in leaves]).cast("array<bigint>"), F.col("node")) - 1
    return _numbered(points.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), "by_id"), rows)


def _numbered(placed: DataFrame, rows: int) -> DataFrame:
    slices = 16 + rows // SLICE_ROWS
    placed = placed.withColumn("slice", F.floor(F.col("by_id") * slices).cast("int"))
    upto = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "slice").count().withColumn("ahead", F.coalesce(F.sum("count").over(upto), F.lit(0))).drop("count")
    order = Window.partitionBy("shard", "slice").orderBy("by_id", "doc_id", "text_crc32")
    numbered = placed.join(counts, ["shard", "slice"]).withColumn("slot", (F.col("ahead") + F.row_number().over(order) - 1).cast("long"))
    return numbered.select("doc_id", "size", "text_crc32", "shard", "slot")


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    out = kd_shards(docs, shards=shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
