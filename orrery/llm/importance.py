"""Importance resampling towards a target: hashed word n-grams, log ratios and Gumbel scores.

Features of a text are all its runs of 1 to n consecutive words, joined by one space;
the bucket of a feature is the CRC-32 of its bytes modulo the number of buckets. One
scan of each document makes them: a ring keeps the running CRC states of the last n
starts, and every word extends each of them by a space and itself, so no run is ever
put together as a string. The scan emits the buckets of a document as one binary
value, in a table in the shared folder; counts and weights read that table, not the
texts. Its size is in proportion to the number of features.

A bucket's gain is floor(1000 ln(p_target / p_corpus)) with add-one counts; a weight is
the floored mean of a text's gains, and a score adds a Gumbel variate that hangs on
the document's id and the seed alone. The best share of scores is drawn without
replacement (Gumbel top-k). Counts are kept by task in an array of fixed size and
added up; both sums have as many rows as there are buckets and are all that reaches
the driver. Ranks come from a range exchange of narrow rows: each slice is sorted by
itself and numbered after the counted rows of the slices before it, so no task holds
an order of all documents.

Defined cases: a null or wordless text has no features, weight 0, and is never drawn if
LEAST_WORDS is above 0; equal scores go to the smaller id, a null id comes last, and
rows that agree in both are numbered in the order they are stored; a null id is hashed
as an empty string; repeated rows count and are drawn each for itself; an empty corpus
gives an empty result, an empty target zero counts; a very long text is read by words
and takes a few bytes for each; only doc_id and text are read, so other columns can't
clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.support import small_batches, values, written

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE_PERCENT = 10
SEED = 2024
#: Words over UTF-8 bytes with A-Z lowered: letters, digits and all that isn't ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Narrow rows in a slice of the ranking, in the mean.
SLICE = 1_000_000


def crc_ring(text: bytes, n: int, buckets: int) -> Iterator[int]:
    """Buckets of all runs of 1 to n words of lower-cased bytes, repeats included."""
    crc = zlib.crc32
    if n == 1:
        for word in WORD.finditer(text):
            yield crc(word[0]) % buckets
        return
    ring: list[int] = []
    for word in WORD.finditer(text):
        w = word[0]
        after = b" " + w
        ring = [crc(after, state) for state in ring[-(n - 1) :]]
        ring.append(crc(w))
        for state in ring:
            yield state % buckets


def words_in(features: int, n: int) -> int:
    """The number of words whose runs of 1 to n number ``features``."""
    few = n * (n + 1) // 2
    if features >= few:
        return (features - few) // n + n
    return next(w for w in range(n) if w * (w + 1) // 2 == features)


def bucket_lists(texts: DataFrame, n: int, buckets: int, key: str | None = "doc_id") -> DataFrame:
    """(key, n_words, n_features, buckets) of every text; ``buckets`` holds little-endian integers of 16 bits if they suffice, else 32."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    named = [key] if key else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.fromiter(crc_ring((t or "").encode().lower(), n, buckets), kind) for t in values(batch.column("text"))]
            sizes = [len(x) for x in out]
            own = [pa.array([words_in(s, n) for s in sizes], pa.int64()), pa.array(sizes, pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in named), *own], [*named, "n_words", "n_features", "buckets"])

    small_batches(texts.sparkSession)
    rows = texts.select(*named, "text")
    keys = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in named)
    return rows.mapInArrow(run, f"{keys}n_words long, n_features long, buckets binary")


def bucket_counts(lists: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: an array of fixed size for each task, added up."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in values(batch.column("buckets")):
                total += np.bincount(np.frombuffer(data, kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in lists.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p_target / p_corpus)) of each bucket, with one added to every count."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = ((target + 1.0) * (s_all + size)) / ((corpus + 1.0) * (t_all + size))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def with_weights(lists: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a text's features."""
    kind = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")
    sent = lists.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            sums = [int(of[np.frombuffer(data, kind)].sum()) if data else 0 for data in values(batch.column("buckets"))]
            mean = [s // n if n else 0 for s, n in zip(sums, batch.column("n_features").to_pylist(), strict=True)]
            yield batch.drop_columns(["buckets"]).append_column("weight", pa.array(mean, pa.int64()))

    kept = lists.select("doc_id", "n_words", "n_features", "buckets")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel variate g that hangs on the id and the seed."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def numbered(rows: DataFrame, total: int, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the given order, which has to be total: slices of a range exchange, sorted and counted each for itself."""
    slices = max(1, min(total // SLICE + 1, 10_000))
    parts = max(slices, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if total else 1
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = written(sorted_rows.withColumn("_slice", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "slices")
    sizes = {r["_slice"]: (r["n"], r["first"]) for r in kept.groupBy("_slice").agg(F.count("*").alias("n"), F.min("_place").alias("first")).collect()}  # a row for each slice
    offsets, before = [], 0
    for at, (n, first) in sorted(sizes.items()):
        offsets.append((at, before - first + 1))
        before += n
    shifts = rows.sparkSession.createDataFrame(offsets, "_slice int, _shift long")
    return kept.join(F.broadcast(shifts), "_slice").withColumn("rank", F.col("_place") + F.col("_shift")).drop("_slice", "_place", "_shift")


def resampled(
    docs: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = SHARE_PERCENT, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank is null where a document isn't drawn.

    ``percent`` of the documents of at least ``least_words`` words are drawn.
    """
    lists = written(bucket_lists(docs, n, buckets), "buckets")
    gain = gains(bucket_counts(lists, buckets), bucket_counts(bucket_lists(target, n, buckets, key=None), buckets))
    scored = with_weights(lists, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("_row", F.monotonically_increasing_id())
    eligible = lists.where(F.col("n_words") >= least_words).count()
    draws = eligible * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    inside = scored.where(F.col("n_words") >= least_words).select(*columns, "_row")
    ranked = numbered(inside, eligible, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc())
    rank = F.when(F.col("rank") <= draws, F.col("rank")).alias("rank")
    rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank).unionByName(rest)


#: CRC-32 in SQL: ``table`` has the 256 steps of a byte, by eight shifts; a word's checksum folds over its bytes.
CRC_TABLE = """
  crc_bits AS (
    SELECT b, 0 AS k, b::BIGINT AS v FROM range(256) t(b)
    UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE k < 8),
  crc_table AS (SELECT list(v ORDER BY b) AS steps FROM crc_bits WHERE k = 8)"""


def crc_of(data: str) -> str:
    """SQL for the CRC-32 of the hexadecimal string ``data`` (upper or lower case), with ``steps`` of CRC_TABLE in scope."""
    byte = f"(('0x' || substr({data}, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({data}) // 2), lambda i: {byte})), lambda s, x: xor(s >> 8, steps[CAST(xor(s & 255, x) AS BIGINT) + 1])), 4294967295)"


SQL = f"""
WITH RECURSIVE {CRC_TABLE},
  words AS (
    SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
    UNION ALL
    SELECT 't', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
  hexed AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words)),
  hashed AS (SELECT w, {crc_of('x')} % 10000 AS bucket FROM hexed, crc_table),
  counts AS (
    SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 't') AS t FROM words JOIN hashed USING (w) GROUP BY bucket),
  sums AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM counts),
  gains AS (
    SELECT bucket, CAST(floor(1000 * ln(((t + 1.0::DOUBLE) * (s_all + 10000)) / ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM counts, sums),
  weights AS (
    SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
  scored AS (
    SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM documents d LEFT JOIN weights USING (doc_id)),
  ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 10 // 100 AS draws FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r <= draws THEN r END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
"""
