"""Mixing sources to target weights by capped water-filling, in Spark expressions.

Each source has a weight and may be repeated at most ``max_epochs`` times. The
wanted total is poured over the sources in proportion to their weights; a source
that reaches its cap is clamped, and what it could not take is poured over the
others by weight, until no source is above its cap. Each round is one aggregation
over a table of one row per source; the level of the water only rises, so it ends
when a round clamps no further source. Sources are numbered by range partitions,
so a source column of very many values isn't gathered in one task.

A target is met by whole repetitions of all documents of the source and a seeded
fraction of one more: documents stand in the order of a seeded hash, and one more
copy is taken of those whose middle lies within the fraction. Running sums over
the documents of a source are never needed: sizes are summed by (source, slice of
the hash), one slice per source is found to hold the border, and only the keys
and sizes of that slice (one in ``SLICES``) are put in order. What is found is the
border itself, one (key, size) per source, so the rows of the corpus, with their
texts, only meet one row of their source: by a broadcast of the counted sources,
and beyond ``BROADCAST_SOURCES`` in a join that Spark can split at a hot source.

Defined cases: null texts have size 0; a null source is a source of its own and
comes last; a source without words has target 0 and nothing is taken; repeated
rows and equal ids stand next to each other in the order and count as rows of
their own; a very long text is one row that is taken or left as a whole; an empty
table gives an empty result; columns of the input are kept in a struct, so their
names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.support import cut, word_count

#: Hex digits of the hash that name a slice, and so the number of slices.
DIGITS = 3
SLICES = 16**DIGITS
#: Sources (about 150 bytes each) up to which their plan is broadcast.
BROADCAST_SOURCES = 100_000


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` (one row per source) with place: their number in code point order, null last, from 0."""
    dealt = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").count()  # one row per partition
    ahead = parts.withColumn("ahead", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.join(F.broadcast(ahead), "part").withColumn("place", F.col("ahead") + own).drop("part", "ahead")


def water_fill(sizes: DataFrame, share: float, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with column target.

    Weights are given to the sources in code point order, null last, and repeat.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    filled = cut(
        numbered(sizes)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    wanted = float(filled.agg(F.sum("source_size")).first()[0] or 0) * share
    level, clamped = float("-inf"), -1
    while True:
        under = F.col("ratio") <= F.lit(level)
        now = filled.agg(F.count_if(under).alias("n"), F.sum(F.when(under, F.col("cap"))).alias("caps"), F.sum(F.when(~under, F.col("weight"))).alias("free")).first()
        if now["n"] == clamped or now["free"] is None:
            break
        clamped, level = now["n"], (wanted - (now["caps"] or 0.0)) / now["free"]
    return filled.select("source", "source_size", F.when(F.col("ratio") <= F.lit(level), F.col("cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def _per_source(sums: DataFrame, keyed: DataFrame, share: float, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """One row per source: source_size, target, whole (repetitions of all), at (slice and border of the part).

    ``sums`` (source, slice, slice_size) and ``keyed`` (source, slice, key, text), the latter one row per document.
    """
    targets = water_fill(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size")), share, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "of")
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # at most SLICES rows
    placed = sums.withColumn("ahead", F.coalesce(F.sum("slice_size").over(upto), F.lit(0)))
    crossed = placed.join(targets, F.col("source").eqNullSafe(F.col("of"))).where(F.col("ahead") + F.col("slice_size") > F.col("part"))
    borders = cut(crossed.groupBy("of").agg(F.first("part").alias("part"), F.min(F.struct("slice", "ahead")).alias("at")))

    # the documents of the border slices, in order: the first whose middle lies beyond the part, and how many rows like it come before
    if borders.count() > BROADCAST_SOURCES:  # then rows are shuffled, and sizes are narrower than texts
        keyed = keyed.withColumn("size", word_count(F.col("text"))).drop("text")
    here = _met(keyed, borders, F.col("slice") == F.col("at.slice"))
    here = here if "size" in keyed.columns else here.withColumn("size", word_count(F.col("text"))).drop("text")
    order = Window.partitionBy("of").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    lying = here.withColumn("lying", F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("at.ahead"))
    taken = 2 * F.col("lying") + F.col("size") <= 2 * F.col("part")
    tuple_ = F.struct("key", "size")
    first = lying.groupBy("of").agg(F.min(F.when(~taken, tuple_)).alias("border"))
    equal = lying.where(taken).groupBy("of", "key", "size").agg(F.count("*").alias("like")).select(F.col("of").alias("o"), F.struct("key", "size").alias("b"), "like")
    found = first.join(equal, F.col("of").eqNullSafe(F.col("o")) & (F.col("border") == F.col("b")), "left").select("of", "border", F.coalesce("like", F.lit(0)).alias("like"))
    at = borders.select("of", F.col("at.slice").alias("slice")).alias("x").join(found.alias("y"), F.col("x.of").eqNullSafe(F.col("y.of")), "left")
    at = at.select(F.col("x.of").alias("o"), F.struct("x.slice", "y.border", F.coalesce("y.like", F.lit(0)).alias("like")).alias("at"))
    return cut(targets.join(at, F.col("of").eqNullSafe(F.col("o")), "left").select("of", "source_size", "target", "whole", "at"))


def _met(rows: DataFrame, of_sources: DataFrame, also: Column | None = None) -> DataFrame:
    """``rows`` with the row of their source; a broadcast if the counted sources are few enough."""
    on = F.col("source").eqNullSafe(F.col("of"))
    side = F.broadcast(of_sources) if of_sources.count() <= BROADCAST_SOURCES else of_sources
    return rows.join(side, on if also is None else on & also)


def plan_epochs(
    docs: DataFrame,
    *,
    share: float = 1.5,
    weights: Sequence[float] = (3, 1, 2),
    max_epochs: float = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: ``row`` (the input row as a struct), size, source,
    source_size, target, copies (whole repetitions and perhaps one more)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    size = word_count(F.col(text_col))
    source = F.col(source_col).alias("source")
    keyed = docs.select(source, F.substring(key, 1, DIGITS).alias("slice"), key.alias("key"), F.col(text_col).alias("text"))
    sums = cut(keyed.groupBy("source", "slice").agg(F.sum(word_count(F.col("text"))).alias("slice_size")))  # at most SLICES rows per source
    plan = _per_source(sums, keyed, share, weights, max_epochs)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source, key.alias("key"), size.alias("size"))
    decided = _met(rows, plan)
    place, slice_ = F.struct("key", "size"), F.substring("key", 1, DIGITS)
    before = F.col("at").isNull() | (slice_ < F.col("at.slice")) | ((slice_ == F.col("at.slice")) & (F.col("at.border").isNull() | (place < F.col("at.border"))))
    # rows equal to the border, of which some are taken and others not: only where ids are repeated or null
    shared = F.coalesce((F.col("at.like") > 0) & (place == F.col("at.border")), F.lit(False))
    out = ["row", "source", "size", "source_size", "target"]
    clear = decided.where(~shared).select(*out, (F.col("whole") + before.cast("int")).alias("copies"))
    if plan.where("at.like > 0").isEmpty():
        return clear
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(f"row.{text_col}")))
    equal = decided.where(shared).withColumn("nth", nth)
    return clear.unionByName(equal.select(*out, (F.col("whole") + (F.col("nth") <= F.col("at.like")).cast("int")).alias("copies")))


def mixture_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    narrow = docs.select("doc_id", "text", "source")
    plan = plan_epochs(narrow, **options)
    return plan.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mixture: each input row as often as it is taken."""
    plan = plan_epochs(docs, **options).where(F.col("copies") > 0)
    return plan.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap,
         (SELECT sum(size) FROM d)::DOUBLE * 1.5::DOUBLE AS wanted FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
         (wanted - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT ratio, place, level FROM l WHERE ratio > level ORDER BY ratio, place LIMIT 1),
t AS (
  SELECT l.source, l.source_size,
         CASE WHEN f.place IS NULL OR (l.ratio, l.place) < (f.ratio, f.place) THEN l.cap ELSE f.level * l.weight END AS target
  FROM l LEFT JOIN f ON true),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
o AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lying
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN 2 * lying + size <= 2 * part THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""
