"""Hybrid retrieval: cosine neighbours, BM25, reciprocal rank fusion, filters, merging.

Every operator works on any number of collections at once: ``collection_id`` is a
key of each table, so a request over many collections is one plan. A table of
queries with a ``query_id`` is answered as a whole: ``query_id`` is then a key of
every later table, too. A table without one has to be a single query; several rows
are an error. Corpus statistics are grouped aggregations, candidates a ranked window
with a limit before the shuffle: a task keeps at most k rows of a group.

The vectors of the queries pass through the driver, QUERIES of them at a time, and
are sent to the tasks; chunks are never replicated.

What decides ranks: candidates come from the vectors alone, BM25 only re-ranks
them, its statistics cover the whole corpus of a collection, and filters apply
after ranking. Ties: vector scores by chunk id, BM25 by vector rank, fused scores by
BM25 rank, merged ones by the order of the collections. Scores are compared at
nine decimals, so the order doesn't hang on the order of floating sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from orrery.functions.text import tokens
from orrery.sources.shared import stored

#: The constants of BM25Okapi and of rank fusion.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
DEFAULT_TOP_K, MAX_TOP_K, DEFAULT_ALPHA, DEFAULT_FAN_OUT, MAX_FAN_OUT = 5, 20, 0.7, 4, 10
DECIMALS = 9
#: Queries of one pass over the chunks, and those that a task scores together.
QUERIES, BLOCK = 65_536, 256
#: Places that a task holds for the best rows of queries, over all collections; rows of a collection whose columns it holds before it looks for those that it needs; first rows of a batch, which give bounds; queries of one batch of results.
STATE, KEPT, HEAD, OUT = 1 << 22, 1 << 16, 512, 4096
#: Texts or queries of one card, and the queries whose scores a task gives at a time.
CARD, STRIP = 1024, 32
#: In such a product a word is a column of both matrices if one in DENSE pairs or more shares it; columns and pairs that share other words, at a time.
DENSE, COLUMNS, HITS = 500, 1024, 1 << 20
#: Bytes of texts whose words a task counts at a time.
COUNTED = 16 << 20
#: Weights of asked words that are sent to all tasks at most, to score all pairs; more are joined.
WEIGHTS = 1 << 20
#: Candidates up to which their ids are broadcast to find their texts.
BROADCAST_PAIRS = 200_000


def check_request(top_k: int = DEFAULT_TOP_K, alpha: float = DEFAULT_ALPHA, collections: Sequence[str] = ("",)) -> None:
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k has to be 1 to {MAX_TOP_K}")
    if not 0 <= alpha <= 1:
        raise ValueError("alpha has to be 0 to 1")
    if not collections:
        raise ValueError("at least one collection is needed")


def clamped_top_k(top_k: int, most: int = MAX_TOP_K) -> int:
    """For callers that aren't refused: the nearest number of results that is allowed."""
    return max(1, min(top_k, most))


def pool_size(top_k: int, fan_out: int = DEFAULT_FAN_OUT) -> int:
    return top_k * min(max(fan_out, 1), MAX_FAN_OUT)


def search_mode(mode: str | None, hybrid: bool = True) -> str:
    """An explicit mode wins over the older flag."""
    return mode or ("hybrid" if hybrid else "semantic")


def keys_of(rows: DataFrame, *others: str) -> list[str]:
    """``others`` and, where there are many queries, query_id before them."""
    return [*(["query_id"] if "query_id" in rows.columns else []), *others]


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows in double precision, filled up with zeros, and their lengths; -1 if null or with a null in it."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    if len(lengths) and lengths.min() == lengths.max() >= 0 and not flat.null_count:
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(lengths), -1), lengths
    out = np.zeros((len(lengths), max(0, lengths.max(initial=0))))
    for i, v in enumerate(vectors.to_pylist()):
        if v is None or None in v:
            lengths[i] = -1
        else:
            out[i, : len(v)] = v
    return out, lengths


def _cosines(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of all rows of a with all of b, and where there is none: zero vectors, nulls, different lengths."""
    width = min(a[0].shape[1], b[0].shape[1])
    norm = np.sqrt((a[0] ** 2).sum(axis=1))[:, None] * np.sqrt((b[0] ** 2).sum(axis=1))[None, :]
    none = (norm == 0) | (a[1][:, None] != b[1][None, :]) | (a[1] < 0)[:, None]
    with np.errstate(all="ignore"):
        return a[0][:, :width] @ b[0][:, :width].T / norm, none


def _first(keys: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k largest; of equal ones those that come first."""
    if keys.shape[1] <= k:
        return np.ones(keys.shape, bool)
    least = np.partition(keys, keys.shape[1] - k, axis=1)[:, keys.shape[1] - k, None]
    more, equal = keys > least, keys == least
    return more | (equal & (equal.cumsum(axis=1) <= k - more.sum(axis=1, keepdims=True)))


def _query_blocks(query: DataFrame) -> Iterator[list]:
    """Rows (query_id, query_vector) in lists of QUERIES; without a query_id there is one row at most."""
    many = "query_id" in query.columns
    block: list = []
    for row in query.select(*(["query_id"] if many else []), "query_vector").toLocalIterator():
        if block and not many:
            raise ValueError("several queries need a query_id")
        block.append((row["query_id"] if many else 0, row["query_vector"]))
        if len(block) == QUERIES:
            yield block
            block = []
    if block:
        yield block


class _Best:
    """The k best rows of one collection so far, for each query of a pass; equal keys go to the rows that came first."""

    def __init__(self, queries: int, k: int):
        self.keys = np.full((queries, k), -np.inf)
        self.cosines = np.zeros((queries, k))
        self.refs = np.full((queries, k), -1, np.int64)
        self.carried: list[pa.RecordBatch] = []
        self.rows = self.kept = 0

    def add(self, q: np.ndarray, refs: np.ndarray, cosines: np.ndarray, keys: np.ndarray) -> None:
        k = self.keys.shape[1]
        own, group = np.unique(q, return_inverse=True)
        group = np.concatenate([np.repeat(np.arange(len(own)), k), group])
        every = [np.concatenate([old[own].reshape(-1), new]) for old, new in ((self.keys, keys), (self.cosines, cosines), (self.refs, refs))]
        order = np.lexsort((every[2] < 0, -every[0], group))  # stable: earlier rows before later ones
        first = np.searchsorted(group[order], np.arange(len(own)))
        taken = order[first[:, None] + np.arange(k)]
        self.keys[own], self.cosines[own], self.refs[own] = (x[taken] for x in every)

    def carry(self, rows: pa.RecordBatch) -> int:
        """Keeps the other columns of rows, and gives the place of the first; rows that aren't among the best of any query are dropped from time to time."""
        if self.rows > max(KEPT, 2 * self.kept):
            used, places = np.unique(self.refs, return_inverse=True)
            self.refs = places.reshape(self.refs.shape) - int(used[0] < 0)
            self.carried = pa.Table.from_batches(self.carried).take(pa.array(used[used >= 0])).combine_chunks().to_batches()
            self.rows = self.kept = sum(x.num_rows for x in self.carried)
        self.carried.append(rows)
        self.rows += rows.num_rows
        return self.rows - rows.num_rows

    def found(self, ids: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(self.carried).combine_chunks()
        for at in range(0, len(self.refs), OUT):
            q, slot = np.nonzero(self.refs[at : at + OUT] >= 0)
            q += at
            taken = rows.take(pa.array(self.refs[q, slot])).combine_chunks()
            keys = self.keys[q, slot]
            columns = [ids.take(pa.array(q)), *(taken.column(c).combine_chunks() for c in names), pa.array(self.cosines[q, slot], mask=keys == -np.inf), pa.array(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", *names, "cosine", "_key"])


def _units(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows normalised in single precision, and their norms; none if one of them has no direction or the lengths differ."""
    norm = np.sqrt((rows**2).sum(axis=1))
    if not len(rows) or lengths.min() != lengths.max() or not (np.isfinite(norm) & (norm > 1e-150)).all():
        return None
    return (rows / norm[:, None]).astype(np.float32), norm


def _offer(best: _Best, at: int, query: tuple, rows: tuple, base: int, k: int) -> None:
    """Rows (matrix, lengths, units) that may be among the best of a block of queries (the same) from ``at`` on.

    Where all have directions of one length, cosines in single precision find the few rows that may
    pass a query's k-th best, and only those are worked out in double precision.
    """
    block = slice(at, at + len(query[0]))
    a, b = query[2], rows[2]
    if a is not None and b is not None and query[1][0] == rows[1][0]:
        least = best.keys[block, -1]
        error = (len(rows[0][0]) + 16) * 2.0**-23 + 10.0**-DECIMALS
        near = a[0] @ b[0].T >= (least - error).astype(np.float32)[:, None]
        if np.count_nonzero(near) <= 4 * k * len(near):
            q, j = np.divmod(np.flatnonzero(near.reshape(-1)), near.shape[1])
            cosines = np.einsum("ij,ij->i", query[0][q], rows[0][j]) / (a[1][q] * b[1][j])
            keys = np.round(cosines, DECIMALS)
            more = keys > least[q]
            if more.any():
                best.add(at + q[more], base + j[more], cosines[more], keys[more])
            return
    cosines, none = _cosines(query[:2], rows[:2])
    keys = np.where(none, -np.inf, np.where(np.isnan(cosines), np.inf, np.round(cosines, DECIMALS)))
    q, j = np.nonzero(_first(keys, k))
    best.add(at + q, base + j, cosines[q, j], keys[q, j])


def nearest(chunks: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k nearest chunks of each collection, for each query: ``chunks`` (collection_id,
    chunk_id, embedding, ...), ``query`` (query_id, query_vector), or one row (query_vector).
    Adds cosine and vec_rank from 1, and the query_id; the embedding is left out.

    For many queries the chunks are dealt by a range exchange to as many tasks as there are cores,
    and a task gives the k best of all its chunks: what is sent on grows with the queries alone.
    """
    spark, many = chunks.sparkSession, "query_id" in query.columns
    carried = [f for f in chunks.schema if f.name != "embedding"]
    id_field = query.schema["query_id"] if many else T.StructField("query_id", T.LongType())
    schema = T.StructType([id_field, *carried, T.StructField("cosine", T.DoubleType()), T.StructField("_key", T.DoubleType())])
    id_type, names = to_arrow_type(id_field.dataType), [f.name for f in carried]

    def score(batches: Iterator[pa.RecordBatch], shared, dealt: bool) -> Iterator[pa.RecordBatch]:
        ids, lines, sizes = shared.value
        blocks = [(at, (lines[at : at + BLOCK], sizes[at : at + BLOCK], _units(lines[at : at + BLOCK], sizes[at : at + BLOCK]))) for at in range(0, len(ids), BLOCK)]
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            order = pc.sort_indices(batch.column("chunk_id"), null_placement="at_start").to_numpy()
            group = batch.column("collection_id").dictionary_encode(null_encoding="encode")
            codes = group.indices.to_numpy(zero_copy_only=False)[order]
            rows, lengths = _matrix(batch.column("embedding"))
            for code in np.unique(codes):
                own, name = order[codes == code], group.dictionary[int(code)].as_py()
                if name not in held:
                    if (len(held) + 1) * len(ids) * k > STATE:
                        for other in held.values():
                            yield from other.found(ids, names)
                        held.clear()
                    held[name] = _Best(len(ids), k)
                best = held[name]
                base = best.carry(batch.select(names).take(pa.array(own)))
                for begin, end in ((0, HEAD), (HEAD, len(own))):  # the first rows give each query a bound for the others
                    part = own[begin:end]
                    if len(part):
                        given = rows[part], lengths[part], _units(rows[part], lengths[part])
                        for at, block in blocks:
                            _offer(best, at, block, given, base + begin, k)
            if not dealt:  # ties go to the smaller id, which a later batch may have
                for best in held.values():
                    yield from best.found(ids, names)
                held.clear()
        for best in held.values():
            yield from best.found(ids, names)

    def one_pass(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((pa.array([r[0] for r in block], id_type), *_matrix(pa.array([r[1] for r in block], pa.list_(pa.float64())))))
        dealt = len(block) > BLOCK
        rows = chunks.select(*names, "embedding")
        if dealt:
            rows = rows.repartitionByRange(max(spark.sparkContext.defaultParallelism, 1), "collection_id", "chunk_id").sortWithinPartitions("collection_id", "chunk_id")
        return rows.mapInArrow(lambda batches: score(batches, shared, dealt), schema)

    passes = [one_pass(b) for b in _query_blocks(query)]
    scored = reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id", "collection_id").orderBy(F.desc("_key"), "chunk_id")
    found = scored.withColumn("vec_rank", F.row_number().over(order)).where(F.col("vec_rank") <= k)
    return found.drop("_key") if many else found.drop("_key", "query_id")


def _lowered(corpus: DataFrame, *columns: str) -> DataFrame:
    return corpus.select(*columns, F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one has COUNTED bytes of texts at most, or one text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED, "right")))
            yield batch.slice(at, end - at)
            at = end


def _word_counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of lower-cased texts, cut as :func:`orrery.functions.text.tokens` cuts them; (text, word, times) of
    each word of a text, by its place; and how many words each text has."""
    lists = pc.ascii_split_whitespace(texts)
    flat, rows = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    words, rows = flat.filter(some).dictionary_encode(), rows.filter(some).to_numpy(zero_copy_only=False)
    n = max(len(words.dictionary), 1)
    keys, times = np.unique(rows * np.int64(n) + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return words.dictionary, keys // n, keys % n, times, np.bincount(rows, minlength=len(texts))


def _said(corpus: DataFrame) -> DataFrame:
    """(collection_id, chunk_id, dl, term, tf) of each text by itself, a row for each of its words; nothing is shuffled.

    Words are cut in a step of their own: as an expression Spark would work them out a second
    time to drop texts without words, and do so for all texts, before any join.
    """
    texts = _lowered(corpus, "collection_id", "chunk_id")
    schema = T.StructType([texts.schema["collection_id"], texts.schema["chunk_id"], T.StructField("dl", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            words, rows, places, times, sizes = _word_counts(part.column("text"))
            keys = [part.column(c).take(pa.array(rows)) for c in ("collection_id", "chunk_id")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(sizes[rows].astype(np.int32)), words.take(pa.array(places)), pa.array(times)], schema.names)

    return texts.mapInArrow(count, schema)


def postings(corpus: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(collection_id, chunk_id, dl, term, tf) from (collection_id, chunk_id, text).

    With ``terms`` (term, times), the few words of a query, only theirs, with their
    times (and query_id): other words are dropped before anything is shuffled.
    """
    each, keys = _said(corpus), ["collection_id", "chunk_id", "dl", "term"]
    if terms is not None:
        few = "query_id" not in terms.columns
        each, keys = each.join(F.broadcast(terms) if few else terms, "term"), [*keys_of(terms, *keys), "times"]
    return each.groupBy(*keys).agg(F.sum("tf").alias("tf"))


def corpus_statistics(corpus: DataFrame) -> DataFrame:
    """(collection_id, term, df, words): the chunks that have a term; the row of no term counts all chunks and their words.

    One pass over the texts, whose words a task counts by parts, and one aggregation.
    :mod:`orrery.operators.index` keeps it by version, for :func:`search`.
    """
    texts = _lowered(corpus, "collection_id")
    schema = T.StructType([texts.schema["collection_id"], T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("words", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            group = part.column("collection_id").dictionary_encode(null_encoding="encode")
            codes, m = group.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(group.dictionary)
            words, rows, places, _, sizes = _word_counts(part.column("text"))
            n = max(len(words), 1)
            keys, df = np.unique(codes[rows] * n + places, return_counts=True)
            whole = [group.dictionary, pa.nulls(m, pa.string()), pa.array(np.bincount(codes, minlength=m)), pa.array(np.bincount(codes, sizes, minlength=m).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(whole, schema.names)
            yield pa.RecordBatch.from_arrays([group.dictionary.take(pa.array(keys // n)), words.take(pa.array(keys % n)), pa.array(df), pa.array(np.zeros(len(df), np.int64))], schema.names)

    return texts.mapInArrow(count, schema).groupBy("collection_id", "term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))


def document_frequencies(statistics: DataFrame) -> DataFrame:
    """(collection_id, term, df) of :func:`corpus_statistics`."""
    return statistics.where("term IS NOT NULL").select("collection_id", "term", "df")


def corpus_sizes(statistics: DataFrame) -> DataFrame:
    """(collection_id, n, avgdl, and mean_raw if it is kept) of :func:`corpus_statistics`; chunks without words count in both."""
    kept = ["mean_raw"] if "mean_raw" in statistics.columns else []
    return statistics.where("term IS NULL").select("collection_id", F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avgdl"), *kept)


def raw_frequency() -> Column:
    return F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)


def exact_mean(value: Column) -> Column:
    """The mean of a double by decimals of 18 places, whose sum hangs on no order."""
    return (F.sum(value.cast("decimal(28,18)")).cast("double") / F.count(value)).cast("double")


def inverse_frequencies(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(collection_id, term, df, idf); a negative value becomes EPSILON times the mean over all terms.

    ``counted`` may be the rows of some terms alone where ``sizes`` has the mean.
    """
    raw = counted.join(F.broadcast(sizes), "collection_id").withColumn("raw", raw_frequency())  # a row for each collection
    if "mean_raw" not in sizes.columns:
        raw = raw.join(raw.groupBy("collection_id").agg(exact_mean(F.col("raw")).alias("mean_raw")), "collection_id")
    return raw.select("collection_id", "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf"))


def query_terms(query: DataFrame) -> DataFrame:
    """(query_id, term, times) of rows (query_id, query_text), or (term, times) of one row (query_text); repeated words count as often."""
    if "query_id" not in query.columns:
        texts = query.agg(F.collect_list(F.struct("query_text")).alias("q"))
        one = F.when(F.size("q") <= 1, F.col("q")).otherwise(F.raise_error(F.lit("several queries need a query_id")))
        query = texts.select(F.explode(one).alias("q")).select("q.query_text")
    keys = keys_of(query, "term")
    return query.select(*keys[:-1], F.explode(tokens(F.col("query_text"))).alias("term")).groupBy(*keys).agg(F.count("*").alias("times"))


def _damping() -> Column:
    return F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))


def _share() -> Column:
    return F.col("tf") * (K1 + 1) / _damping()


def _weights(asked: DataFrame, statistics: DataFrame) -> DataFrame:
    """(collection_id, term, df, idf) of the asked words."""
    return inverse_frequencies(document_frequencies(statistics), corpus_sizes(statistics)).join(asked, "term", "left_semi")


def _weighted(corpus: DataFrame, asked: DataFrame, statistics: DataFrame) -> DataFrame:
    """(collection_id, chunk_id, ct, cw): the asked words of each text, and what each adds to the score of a query that has it once."""
    sizes = corpus_sizes(statistics)
    weights = _weights(asked, statistics)
    said = _said(corpus).join(weights, ["collection_id", "term"]).join(F.broadcast(sizes), "collection_id").repartition("collection_id", "chunk_id")
    said = said.groupBy("collection_id", "chunk_id", "dl", "term").agg(F.sum("tf").alias("tf"), F.first("idf").alias("idf"), F.first("avgdl").alias("avgdl"))  # a chunk may be there twice
    said = said.groupBy("collection_id", "chunk_id").agg(F.collect_list(F.struct("term", (F.col("idf") * _share()).alias("w"))).alias("c"))
    return said.select("collection_id", "chunk_id", F.col("c.term").alias("ct"), F.col("c.w").alias("cw"))


def _lists(values: pa.Array, other: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The bounds of the lists of two columns, which are equally long, and their values one after another."""
    n = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n)]), values.flatten(), other.flatten().to_numpy(zero_copy_only=False)


def _card_schema(rows: DataFrame, ids: list[str], prefix: str) -> T.StructType:
    return T.StructType([*(T.StructField(prefix + c, T.ArrayType(rows.schema[c].dataType)) for c in ids), T.StructField(f"{prefix}words", T.ArrayType(T.StringType())), *(T.StructField(prefix + c, T.BinaryType()) for c in ("ends", "rows", "values"))])


def _turned(ids: list[pa.Array], words: pa.Array, place: np.ndarray, rows: np.ndarray, values: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A card: ids of rows, and their words with a value for each, turned round: each word once, where its rows end, the rows that have it and their values."""
    order = np.argsort(place, kind="stable")
    flat = np.cumsum(np.bincount(place, minlength=len(words))).astype(np.int64), rows[order].astype(np.int32), values[order].astype(float)
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (*ids, words)]
    return pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in flat)], names)


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``size`` rows at most, which are alike in size."""
    step = -(-batch.num_rows // max(1, -(-batch.num_rows // size)))
    for at in range(0, batch.num_rows, max(1, step)):
        yield batch.slice(at, step)


def _cards(rows: DataFrame, ids: list[str], words: str, values: str, size: int, prefix: str) -> DataFrame:
    """Rows (``ids``, lists of ``words`` and ``values``) as cards of about ``size``, gathered within a task, so nothing is shuffled."""
    schema = _card_schema(rows, ids, prefix)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, size):
                bounds, said, numbers = _lists(part.column(words), part.column(values))
                said = said.dictionary_encode()
                yield _turned([part.column(c) for c in ids], said.dictionary, said.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(part.num_rows), np.diff(bounds)), numbers, schema.names)

    return rows.select(*ids, words, values).mapInArrow(gather, schema)


def _text_cards(corpus: DataFrame, weights: DataFrame, sizes: DataFrame, size: int, prefix: str) -> DataFrame:
    """The cards of texts, as those of :func:`_weighted`, where no chunk is there twice: with the ``weights`` (collection_id,
    term, idf) in each task a text is cut once and its words are never rows, so nothing is shuffled."""
    schema = _card_schema(corpus, ["collection_id", "chunk_id"], prefix)
    shared = corpus.sparkSession.sparkContext.broadcast((weights.select("collection_id", "term", "idf").toArrow().combine_chunks(), sizes.select("collection_id", "avgdl").toArrow().combine_chunks()))  # WEIGHTS rows at most, and one for each collection

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idfs, lengths = shared.value
        avgdl = dict(zip(lengths["collection_id"].to_pylist(), lengths["avgdl"].to_pylist(), strict=True))
        asked: dict = {}
        for text in _parts(batches):
            for part in _slices(text, size):
                words, rows, place, times, dl = _word_counts(part.column("text"))
                group = part.column("collection_id").dictionary_encode(null_encoding="encode")
                code, value = group.indices.to_numpy(zero_copy_only=False)[rows], np.full(len(rows), np.nan)
                for i in np.unique(code):
                    name = group.dictionary[int(i)].as_py()
                    if avgdl.get(name) is None:  # is in no collection
                        continue
                    if name not in asked:
                        own = idfs.filter(pc.equal(idfs["collection_id"], name)).combine_chunks()
                        asked[name] = own["term"].combine_chunks(), np.append(own["idf"].to_numpy(), np.nan)
                    terms, idf = asked[name]
                    here = code == i
                    said = np.unique(place[here])
                    idf_of = np.full(len(words), np.nan)
                    idf_of[said] = idf[pc.fill_null(pc.index_in(words.take(pa.array(said)), terms), -1).to_numpy(zero_copy_only=False)]
                    tf = times[here]
                    value[here] = idf_of[place[here]] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[rows[here]] / avgdl[name])))
                hit = ~np.isnan(value)
                used, spots = np.unique(place[hit], return_inverse=True)
                yield _turned([part.column(c) for c in ("collection_id", "chunk_id")], words.take(pa.array(used)), spots, rows[hit], value[hit], schema.names)

    return _lowered(corpus, "collection_id", "chunk_id").mapInArrow(gather, schema)


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run of n."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def _product(q: tuple, c: tuple) -> np.ndarray:
    """Sums over words of the products of the values of two cards (how many rows, words, ends, rows, values), for all their rows.

    Words that many pairs share are columns of two matrices, COLUMNS at a time; for the others
    only the pairs that share them are worked out, HITS at a time.
    """
    found = pc.index_in(c[1], q[1])
    cw, qw = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)), found.drop_null().to_numpy(zero_copy_only=False)
    nq, nc = (np.diff(x[2], prepend=0)[w] for x, w in ((q, qw), (c, cw)))
    bq, bc = q[2][qw] - nq, c[2][cw] - nc
    sums, hits = np.zeros((q[0], c[0])), nq * nc
    common, few = np.flatnonzero(hits * DENSE > sums.size), np.flatnonzero(hits * DENSE <= sums.size)
    for at in range(0, len(common), COLUMNS):
        own = common[at : at + COLUMNS]
        sides = []
        for (n, _, _, rows, values), begin, count in ((q, bq[own], nq[own]), (c, bc[own], nc[own])):
            places = _spread(begin, count)
            sides.append(np.bincount(rows[places] * len(own) + np.repeat(np.arange(len(own)), count), values[places], minlength=n * len(own)).reshape(n, -1))
        sums += sides[0] @ sides[1].T
    run = np.cumsum(hits[few]) // HITS
    for at in np.unique(run):
        own = few[run == at]
        asks, n = _spread(bq[own], nq[own]), np.repeat(nc[own], nq[own])
        every, places = np.repeat(asks, n), _spread(np.repeat(bc[own], nq[own]), n)
        sums += np.bincount(q[3][every] * c[0] + c[3][places], q[4][every] * c[4][places], minlength=sums.size).reshape(sums.shape)
    return sums


def _every_score(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, collection_id, chunk_id, bm25) of all texts, of which ``texts`` are the cards, for all of ``queries`` (query_id, qt, qn).

    A card of texts meets a card of queries as one row, by a product that shuffles nothing; a
    task holds the scores of one such pair of cards at a time.
    """
    left = stored(texts, "texts")
    queries = stored(queries, "asked")
    right = stored(_cards(queries.coalesce(max(1, -(-queries.count() // CARD))), ["query_id"], "qt", "qn", CARD, "q_"), "queries")  # full cards, as few as can be
    out = T.StructType([queries.schema["query_id"], *(T.StructField(c, texts.schema[f"c_{c}"].dataType.elementType) for c in ("collection_id", "chunk_id")), T.StructField("bm25", T.DoubleType())])

    def card(batch: pa.RecordBatch, i: int, prefix: str, first: str) -> tuple:
        ends, rows, values = (np.frombuffer(batch.column(prefix + c)[i].as_buffer(), kind) for c, kind in (("ends", np.int64), ("rows", np.int32), ("values", float)))
        return len(batch.column(prefix + first)[i]), batch.column(f"{prefix}words")[i].values, ends, rows.astype(np.int64), values

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sums = _product(card(batch, i, "q_", "query_id"), card(batch, i, "c_", "chunk_id"))
                ids, names, chunks = (batch.column(c)[i].values for c in ("q_query_id", "c_collection_id", "c_chunk_id"))
                names, chunks = (pa.concat_arrays([x] * min(STRIP, len(ids))) for x in (names, chunks))
                for at in range(0, len(ids), STRIP):
                    strip = sums[at : at + STRIP]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(at, at + len(strip)), strip.shape[1]))), names.slice(0, strip.size), chunks.slice(0, strip.size), pa.array(strip.reshape(-1))], out.names)

    return left.crossJoin(right).mapInArrow(score, out)


def bm25(corpus: DataFrame, query: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """(query_id, collection_id, chunk_id, bm25) of every chunk of the corpus, for every query; no hit is 0.0.

    The rows for many queries are the product of both tables; they are made where they are given back, and never shuffled.
    """
    terms, statistics = query_terms(query), stored(corpus_statistics(corpus), "statistics") if statistics is None else statistics
    if "query_id" in query.columns:
        asked = terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "times")).alias("q")).select("query_id", F.col("q.term").alias("qt"), F.col("q.times").alias("qn"))
        queries = query.select("query_id").distinct().join(asked, "query_id", "left")
        words, keys = terms.select("term").distinct(), ["collection_id", "chunk_id"]
        weights = stored(_weights(words, statistics), "weights")
        if weights.count() <= WEIGHTS and corpus.groupBy(*keys).count().where("count > 1").isEmpty():
            return _every_score(_text_cards(corpus, weights, corpus_sizes(statistics), CARD, "c_"), queries)
        texts = corpus.select(*keys).join(_weighted(corpus, words, statistics), keys, "left")
        return _every_score(_cards(texts, keys, "ct", "cw", CARD, "c_"), queries)
    sizes, asked = corpus_sizes(statistics), terms.select("term").distinct()
    weights = inverse_frequencies(document_frequencies(statistics), sizes).join(F.broadcast(asked), "term", "left_semi")
    hits = postings(corpus, terms).join(F.broadcast(weights), ["collection_id", "term"]).join(F.broadcast(sizes), "collection_id")
    scored = hits.groupBy("collection_id", "chunk_id").agg(F.sum(F.col("times") * F.col("idf") * (F.col("tf") * (K1 + 1)) / _damping()).alias("bm25"))
    return corpus.select("collection_id", "chunk_id").join(scored, ["collection_id", "chunk_id"], "left").fillna(0.0, ["bm25"])


def bm25_of_pairs(corpus: DataFrame, query: DataFrame, pairs: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """(query_id, collection_id, chunk_id, bm25) of the pairs that share a word: as :func:`bm25`, with
    the statistics of the whole corpus, without scoring all chunks for all queries. Only the
    texts of the pairs are cut into words again; ``statistics`` may be kept ones."""
    keys = ["query_id", "collection_id", "chunk_id"]
    pairs = pairs.select(*keys).distinct()
    terms, statistics = query_terms(query), stored(corpus_statistics(corpus), "statistics") if statistics is None else statistics
    asked = terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "times")).alias("q")).select("query_id", F.col("q.term").alias("qt"), F.col("q.times").alias("qn"))
    wanted = pairs.select("collection_id", "chunk_id").distinct()
    own = corpus.join(F.broadcast(wanted) if pairs.count() <= BROADCAST_PAIRS else wanted, ["collection_id", "chunk_id"], "left_semi")
    said = _weighted(own, terms.select("term").distinct(), statistics)
    joined = pairs.join(asked, "query_id").join(said, ["collection_id", "chunk_id"]).select(*keys, "qt", "qn", "ct", "cw")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (qs, qt, qn), (cs, ct, cw) = (_lists(batch.column(a), batch.column(b)) for a, b in (("qt", "qn"), ("ct", "cw")))
            sums = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                q, c = slice(qs[i], qs[i + 1]), slice(cs[i], cs[i + 1])
                place = pc.fill_null(pc.index_in(ct[c], value_set=qt[q]), -1).to_numpy(zero_copy_only=False)  # of each word of the text among those of the query
                sums[i] = (cw[c] * np.append(qn[q], 0)[place]).sum()
            yield batch.select(keys).append_column("bm25", pa.array(sums))

    return joined.mapInArrow(score, T.StructType([*(joined.schema[c] for c in keys), T.StructField("bm25", T.DoubleType())]))


def with_bm25_rank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds bm25 (0.0 if the corpus lacks the chunk; it still has a rank) and bm25_rank."""
    order = Window.partitionBy(*keys_of(candidates, "collection_id")).orderBy(F.desc(F.round("bm25", DECIMALS)), "vec_rank")
    return candidates.join(scores, keys_of(candidates, "collection_id", "chunk_id"), "left").fillna(0.0, ["bm25"]).withColumn("bm25_rank", F.row_number().over(order))


def reciprocal(rank: Column, weight: float = 1.0) -> Column:
    return F.lit(weight) * (F.lit(1.0) / (RRF_K + rank))


def fused(candidates: DataFrame, mode: str = "hybrid", alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Adds fused and rank from vec_rank and bm25_rank. A collection whose corpus is empty is ranked by vectors alone."""
    both = reciprocal(F.col("vec_rank"), alpha) + reciprocal(F.col("bm25_rank"), 1 - alpha)
    keys = {
        "hybrid": (both, [F.desc("fused"), F.col("bm25_rank")]),
        "semantic": (reciprocal(F.col("vec_rank")), [F.col("vec_rank")]),
        "bm25": (reciprocal(F.col("bm25_rank")), [F.col("bm25_rank")]),
    }[mode]
    return candidates.withColumn("fused", keys[0]).withColumn("rank", F.row_number().over(Window.partitionBy(*keys_of(candidates, "collection_id")).orderBy(*keys[1])))


def fuse_lists(semantic: DataFrame, lexical: DataFrame, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """(chunk_id, score, rank) of two ranked lists (chunk_id, rank) that may lack each other's rows.

    With query_id or collection_id in them, each query and collection has lists of its own, at
    most a pool of candidates each, so one task ranks one of them.
    """
    keys = [c for c in ("query_id", "collection_id") if c in semantic.columns]
    s, b = semantic.select(*keys, "chunk_id", F.col("rank").alias("s")), lexical.select(*keys, "chunk_id", F.col("rank").alias("b"))
    score = F.coalesce(reciprocal(F.col("s"), alpha), F.lit(0.0)) + F.coalesce(reciprocal(F.col("b"), 1 - alpha), F.lit(0.0))
    joined = s.join(b, [*keys, "chunk_id"], "full").withColumn("score", score)
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc("score"), F.asc_nulls_last("b"), F.asc_nulls_last("s"))
    return joined.withColumn("rank", F.row_number().over(order)).select(*keys, "chunk_id", "score", "rank")


def metadata_filter(filters: Mapping[str, object] | None) -> Column:
    """language and filename equal, tags a subset of the row's; no filter passes all."""
    out = F.lit(True)
    for key, value in (filters or {}).items():
        if value is None:
            continue
        if key == "tags":
            out = out & (F.size(F.array_except(F.array(*[F.lit(t) for t in value]).cast("array<string>"), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
        elif key in ("language", "filename"):
            out = out & F.coalesce(F.col(key) == value, F.lit(False))
    return out


def reranked(ranked: DataFrame, score: Column, top_n: int = 50) -> DataFrame:
    """The first top_n rows of each collection by ``score``, the others behind them as they were; one row stays as it is."""
    group = Window.partitionBy(*keys_of(ranked, "collection_id"))
    head = F.col("rank") <= top_n
    order = group.orderBy((~head).cast("int"), F.desc(F.when(head & (F.col("_rows") > 1), F.col("_score"))), "rank")
    return ranked.withColumn("_rows", F.count("*").over(group)).withColumn("_score", score.cast("double")).withColumn("_new", F.row_number().over(order)).drop("rank", "_rows", "_score").withColumnRenamed("_new", "rank")


def collection_results(ranked: DataFrame, top_k: int, filters: Mapping[str, object] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Filter after ranking, renumber, rerank, cut: the rows one collection gives back."""
    order = Window.partitionBy(*keys_of(ranked, "collection_id")).orderBy("rank")
    kept = ranked.where(metadata_filter(filters)).withColumn("rank", F.row_number().over(order))
    return (rerank(kept) if rerank else kept).where(F.col("rank") <= top_k)


def merged(results: DataFrame, collections: DataFrame, top_k: int) -> DataFrame:
    """One list over all collections, for each query: rows are rescored by their rank and never joined,
    ties go to the order of the request, ``collections`` (collection_id, ordinal)."""
    scored = results.join(F.broadcast(collections), "collection_id").withColumn("score", reciprocal(F.col("rank")))
    if "query_id" not in results.columns:
        return scored.orderBy(F.desc("score"), "ordinal").limit(top_k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")
    return scored.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top_k).drop("_place")


def search(
    chunks: DataFrame,
    corpus: DataFrame,
    query: DataFrame,
    *,
    mode: str = "hybrid",
    top_k: int = DEFAULT_TOP_K,
    alpha: float = DEFAULT_ALPHA,
    fan_out: int = DEFAULT_FAN_OUT,
    request: DataFrame | None = None,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Ranked candidates of each collection: chunk columns with vec_rank, bm25_rank, fused, rank.

    ``query`` is a table (query_id, query_vector, query_text), or one row without the id.
    With ``request`` (ordinal, collection_id), a few rows, only its collections are read.
    Candidates come first; BM25 is worked out for them alone.
    """
    check_request(top_k, alpha)
    if request is not None:
        check_request(top_k, alpha, [r[0] for r in request.select("collection_id").limit(1).collect()])
        only = F.broadcast(request.select("collection_id").distinct())
        chunks, corpus = (t.join(only, "collection_id", "left_semi") for t in (chunks, corpus))
    many = "query_id" in query.columns
    found = nearest(chunks, query.select(*keys_of(query, "query_vector")), pool_size(top_k, fan_out))
    texts = query.select(*keys_of(query, "query_text"))
    if not many:
        found, texts = (t.withColumn("query_id", F.lit(0).cast("long")) for t in (found, texts))
    found = stored(found, "candidates")  # k for each query and collection, read twice
    ranked = fused(with_bm25_rank(found, bm25_of_pairs(corpus, texts, found, statistics)), mode, alpha)
    return ranked if many else ranked.drop("query_id")


def collection_stats(ranked: DataFrame, returned: DataFrame, contributed: DataFrame) -> DataFrame:
    """(query_id, collection_id, retrieved, returned, contributed): before filters, after them, in the final list."""

    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias(name))

    keys = keys_of(ranked, "collection_id")
    out = counts(ranked, "retrieved").join(counts(returned, "returned"), keys, "left").join(counts(contributed, "contributed"), keys, "left")
    return out.fillna(0, ["returned", "contributed"])


def effective_mode(mode: str, corpus: DataFrame, collections: DataFrame) -> DataFrame:
    """One row: the mode of the whole response. A collection without corpus makes it semantic_only."""
    covered = collections.join(corpus.select("collection_id").distinct().withColumn("has", F.lit(True)), "collection_id", "left")
    return covered.agg(F.when(F.lit(mode == "semantic") | F.bool_or(F.col("has").isNull()), "semantic_only").otherwise(F.lit(mode)).alias("mode"))


def requested(known: DataFrame, request: DataFrame) -> DataFrame:
    """The collections of a request (ordinal, collection_id) that exist, in its order and as often as it names them."""
    return request.join(known.select("collection_id").distinct(), "collection_id", "left_semi")


def with_provenance(results: DataFrame, collections: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Adds ``source``: where a result comes from, as one struct. Results are few; names come by joins on their ids."""
    named = results.join(collections.select("collection_id", "workspace_id", F.col("name").alias("collection_name")), "collection_id")
    named = named.join(workspaces.select("workspace_id", F.col("name").alias("workspace_name")), "workspace_id")
    missing = {"document_id": "string", "filename": "string", "page_number": "int"}
    known = [F.col(c) if c in results.columns else F.lit(None).cast(kind).alias(c) for c, kind in missing.items()]
    place = F.struct("collection_id", "collection_name", "workspace_id", "workspace_name", *known)
    return named.select(*[c for c in results.columns if c != "source"], place.alias("source"))


def under_delivered(final: DataFrame, top_k: int, query: DataFrame | None = None) -> DataFrame:
    """One row: whether fewer results came than were asked for; with ``query`` (query_id), a row for each query."""
    if query is None:
        return final.agg((F.count("*") < top_k).alias("under_delivered"))
    came = final.groupBy("query_id").agg(F.count("*").alias("n"))
    return query.select("query_id").distinct().join(came, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) < top_k).alias("under_delivered"))
