"""Repeated substrings over all texts, by suffix order and longest previous factors.

A byte is repeated if a string of L bytes that covers it also starts at another
place of the corpus. Sorting all suffixes of a corpus takes as many rows as it has
bytes; instead, only those are sorted that can be repeated.

1. Anchors. In each string of L bytes, the G-byte gram with the smallest hash (the
   leftmost, if equal) is its anchor, so equal strings have equal anchors at equal
   offsets. Neighbouring strings share anchors: about one gram in (L - G + 2) / 2 is
   one. An anchor and the run of strings it stands for make an entry; the bytes that
   the run spans are its context. Strings whose anchor is nowhere else are unique.
2. Entries of equal anchor and equal context (128 bits of hashes) are one class; in
   a class of two and more, all strings are repeated. This is counted with partial
   aggregates, so passages and copies of any number collapse before the shuffle.
3. What is left are contexts of their own that share an anchor with others: the ends
   of repeated passages. The contexts of an anchor, one for each class, go to one
   task, which puts their strings in suffix order, by ranks that double their length
   up to L bytes, with the common prefixes of neighbours. From that come the arrays
   of factors: the longest previous factor of a string is the longer of its matches
   with the nearest smaller positions before and after it in suffix order, the longest
   next factor that with the nearest larger ones. A string whose previous factor
   reaches L bytes is a later copy, one whose next factor does has a copy behind it.
   An anchor with more than HOT contexts isn't gathered in a task: its strings become
   rows of their own, grouped by their bytes, and a group's smallest position tells
   the first from the later ones.

``keep_first`` removes later copies only and keeps the first, in the order of
(doc_id, place); without it, every copy goes.

Defined cases: a null text has no bytes; texts shorter than L keep all; equal rows
are copies of each other (with ``keep_first``, both keep what the first keeps); texts
under one id are judged each by itself, and rows without an id take part like others,
both under a hash of id and text; an empty table gives
an empty result; only doc_id and text are read, so other columns can't clash. A text
is held in a task as a whole, as any row is; its entries are found in runs of bounded
length. Classes rest on 64 bits of the anchor and 64 of the context: that two of 10^15
pairs of different contexts with one anchor agree has a chance below 10^-4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.shingles import BYTE, STEP, U64, mixed
from orrery.llm.support import by_ids, cut, small_batches, values, written

L, G = 200, 100
#: Contexts of an anchor that one task puts in order.
HOT = 1_000
#: Array elements (about 40 bytes each) up to which what was found of the documents is broadcast.
BROADCAST_PARTS = 2_000_000
#: Bytes that are hashed, or sorted, together; place and hash share 64 bits in the search for anchors.
BLOCK, PLACE = 1 << 19, 20
#: Bytes of contexts that are put in order together, but for the last anchor's.
ORDERED = 1 << 17
BACK = pow(STEP, -1, 2**64)
#: An entry's run is packed as first start * 2^16 + strings * 2^8 + offset of the anchor from the first start.
RUN = "doc_id long, run long"


class Hasher:
    """Hashes of substrings from running sums, for stretches of up to a bounded length."""

    def __init__(self, size: int):
        self.up, self.down = np.full(size, STEP, U64), np.full(size, BACK, U64)
        self.up[0] = self.down[0] = 1
        self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def stretches(ids: Iterable[int], texts: Iterable[str | None], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(ids, places, bytes) to look at together: whole texts, or overlapping parts of long ones."""
    out: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    size = 0
    for i, text in zip(ids, texts, strict=True):
        data = (text or "").encode()
        if len(data) < length:
            continue
        for at in range(0, len(data) - length + 1, BLOCK - length):
            part = data[at : at + BLOCK - 1]
            if size + len(part) > BLOCK:
                yield out
                out, size = ([], [], []), 0
            out[0].append(i)
            out[1].append(at)
            out[2].append(part)
            size += len(part)
    if out[0]:
        yield out


def entries_of(parts: list[bytes], hasher: Hasher, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(part, first start in it, strings, offset of the anchor, anchor hash, context hash) of each entry."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    n, wide = len(data), length - gram + 1
    sums = hasher.sums(data)
    at = np.arange(n - gram + 1)
    hashes = mixed(hasher.of(sums, at, at + gram))
    mask = U64((1 << PLACE) - 1)
    low, span = (hashes & ~mask) | at.astype(U64), 1
    keys = len(low)
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    count = keys - wide + 1
    anchor = (np.minimum(low[:count], low[wide - span : wide - span + count]) & mask).astype(np.int64)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    part = np.repeat(np.arange(len(parts)), sizes)[:count]
    start = np.flatnonzero(np.arange(count) + length <= ends[part])
    anchor, part = anchor[start], part[start]
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    first = start[new]
    last = start[np.append(new[1:], len(start)) - 1] if len(new) else first
    strings, offset = last - first + 1, anchor[new] - first
    context = mixed(hasher.of(sums, first, last + length) + mixed((strings * 256 + offset).astype(U64)))
    return part[new], first - (ends - sizes)[part[new]], strings, offset, hashes[anchor[new]], context


def entries(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, run, h, c): every entry of every text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BLOCK + 1)
        for batch in batches:
            for ids, places, parts in stretches(values(batch.column("doc_id")), values(batch.column("text")), length):
                part, first, strings, offset, h, c = entries_of(parts, hasher, length, gram)
                run = ((first + np.array(places)[part]) << 16) | (strings << 8) | offset
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[part]), pa.array(run), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], ["doc_id", "run", "h", "c"])

    return docs.mapInArrow(find, RUN + ", h long, c long")


def suffix_order(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of ``length`` bytes of the contexts in suffix order: (context, start in it, position, common).

    Positions run through the contexts in their order; ``common`` is the prefix that a string has in common
    with the one before it, in bytes.
    """
    sizes = np.array([len(x) for x in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    ranks = [data.astype(np.int32)]  # ranks[k] orders stretches of 2^k bytes
    while 2 << len(ranks) - 1 <= length:
        rank, reach = ranks[-1].astype(np.int64), 1 << len(ranks) - 1
        pair = rank[: len(rank) - reach] * (int(rank.max(initial=0)) + 1) + rank[reach:]
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    at = np.flatnonzero(np.arange(len(data)) + length <= ends[owner])
    top = ranks[-1].astype(np.int64)
    whole = top[at] * (int(top.max(initial=0)) + 1) + top[at + length - (1 << len(ranks) - 1)]
    order = np.argsort(whole, kind="stable")
    at, whole = at[order], whole[order]
    common = np.zeros(len(at), np.int32)
    one, two = at[:-1], at[1:]
    for k in reversed(range(len(ranks))):
        i, j = one + common[1:], two + common[1:]
        inside = np.maximum(i, j) < len(ranks[k])
        last = len(ranks[k]) - 1
        common[1:] += ((ranks[k][np.minimum(i, last)] == ranks[k][np.minimum(j, last)]) & inside).astype(np.int32) << k
    common[1:][whole[1:] == whole[:-1]] = length
    return owner[at], at - (ends - sizes)[owner[at]], at, np.minimum(common, length)


def match_before(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of each string in suffix order, the match with the nearest one before it of a smaller position; 0 if there is none.

    Minima over stretches of 2^k strings let all of them step back together, in log2(n) steps.
    """
    n = len(position)
    low, match = [position.astype(np.int32)], [common]
    while 2 << len(low) - 1 <= n:
        half = 1 << len(low) - 1
        for table in (low, match):
            table.append(np.minimum(table[-1][half:], table[-1][:-half]))  # of the stretch that begins here
    back, found = np.arange(-1, n - 1), common.copy()
    for k in reversed(range(len(low))):
        start = back - (1 << k) + 1
        over = np.flatnonzero(start >= 0)
        over = over[low[k][start[over]] > position[over]]
        found[over] = np.minimum(found[over], match[k][start[over]])
        back[over] -= 1 << k
    return np.where(back >= 0, found, 0)


def longest_factors(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each string in suffix order, up to the length of the strings."""
    after = np.append(common[1:], 0)[::-1] if len(common) else common
    return np.maximum(match_before(position, common), match_before(position[::-1], after)[::-1])


def _sized(rows: DataFrame, found: DataFrame, how: str, parts: str) -> DataFrame:
    """Join on doc_id; ``found`` (materialised) is broadcast if the counted elements of its arrays are few enough."""
    size = found.agg(F.coalesce(F.sum(F.size(parts)), F.lit(0))).first()[0]
    return rows.join(F.broadcast(found) if size <= BROADCAST_PARTS else found, "doc_id", how)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, own, text): doc_id is ``own``, or a hash of id and text where that is null or several texts have it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("own"), "text")
    h = F.xxhash64("text")
    shared = cut(rows.where("own IS NOT NULL").groupBy("own").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select("own", F.lit(True).alias("shared")))
    marked = by_ids(rows, shared, "left", "own")
    return marked.select(F.when(F.col("own").isNull() | F.col("shared"), F.xxhash64("own", "text")).otherwise(F.col("own")).alias("doc_id"), "own", "text")


def repeated_spans(docs: DataFrame, length: int = L, gram: int = G, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, spans array<struct<start, end>>): the disjoint repeated stretches of each text that has any (ids as in :func:`keyed`)."""
    return _spans(keyed(docs), length, gram, keep_first, hot)


def _spans(rows: DataFrame, length: int, gram: int, keep_first: bool, hot: int) -> DataFrame:
    """:func:`repeated_spans` of :func:`keyed` rows."""
    small_batches(rows.sparkSession)
    texts = rows.select("doc_id", "text")
    every = written(entries(texts, length, gram), "entries")
    # what is joined on an anchor is a table of its own, so that Spark can split the entries of a frequent one
    often = cut(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    shared = written(every.join(often, "h"), "shared-anchors")

    place = F.struct("doc_id", "run")
    classes = shared.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    classes = cut(classes.select("h", "n", "at.doc_id", "at.run"))
    sizes = cut(classes.groupBy("h").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1"))
    open_ = sizes if keep_first else sizes.where("least = 1")
    wanted = classes.join(open_, "h").select("doc_id", F.struct("run", "h", "n", (F.col("contexts") > hot).alias("hot")).alias("x"))
    by_doc = cut(wanted.groupBy("doc_id").agg(F.collect_list("x").alias("x")))  # some entries of one text

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*[values(batch.column(c)) for c in ("doc_id", "text", "x")], strict=True):
                data = (text or "").encode()
                for x in found:
                    at, strings = x["run"] >> 16, x["run"] >> 8 & 255
                    rows.append((x["h"], doc_id, x["run"], x["n"], x["hot"], data[at : at + strings - 1 + length]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["h", "doc_id", "run", "n", "hot", "context"])

    told = written(_sized(texts, by_doc, "inner", "x").mapInArrow(contexts, "h long, doc_id long, run long, n long, hot boolean, context binary"), "contexts")

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: list[tuple]) -> pa.RecordBatch:
            rows = sorted(set(rows), key=lambda r: (r[0], r[1], r[2]))  # places in order, anchor by anchor
            owner, start, position, common = suffix_order([r[4] for r in rows], length) if rows else (np.zeros(0, np.int64),) * 4
            hit = longest_factors(position, common) >= length
            if not keep_first:  # copies behind count as well: positions the other way round
                hit |= longest_factors(position.max(initial=0) - position, common) >= length
            found: dict[int, list[int]] = {i: [] for i, r in enumerate(rows) if keep_first or r[3] == 1}
            for i, s in zip(owner[hit].tolist(), start[hit].tolist(), strict=True):
                if i in found:
                    found[i].append(s)
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][1] for i in found], pa.int64()), pa.array([rows[i][2] for i in found], pa.int64()), pa.array([sorted(s) for s in found.values()], pa.list_(pa.int32()))], ["doc_id", "run", "hits"]
            )

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("h", "doc_id", "run", "n", "context")], strict=True):
                if size > ORDERED and held[-1][0] != row[0]:
                    yield judged(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        yield judged(held)

    cold = told.where("NOT hot").repartition("h").sortWithinPartitions("h").select("h", "doc_id", "run", "n", "context")
    verdicts = cold.mapInArrow(factors, RUN + ", hits array<int>")

    def strings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, doc_id, run, n, context in zip(*[batch.column(c).to_pylist() for c in ("h", "doc_id", "run", "n", "context")], strict=True):
                m = len(context) - length + 1
                keys = [context[s : s + length] for s in range(m)]
                yield pa.RecordBatch.from_arrays([pa.array([v] * m, pa.int64()) for v in (h, doc_id, run, n)] + [pa.array(range(m), pa.int32()), pa.array(keys, pa.binary())], ["h", "doc_id", "run", "n", "s", "key"])

    single = told.where("hot").select("h", "doc_id", "run", "n", "context").mapInArrow(strings_of, "h long, doc_id long, run long, n long, s int, key binary")
    first = single.groupBy("key").agg(F.count("*").alias("m"), F.min(place).alias("first")).where("m > 1")
    again = single.join(first, "key").where(F.struct("doc_id", "run") > F.col("first") if keep_first else F.lit(True))
    known = told.where("hot").select("doc_id", "run", "n") if keep_first else told.where("hot AND n = 1").select("doc_id", "run", "n")
    hot_hits = again.groupBy("doc_id", "run").agg(F.sort_array(F.collect_set("s")).alias("hits"))  # strings of one entry
    hot_verdicts = known.select("doc_id", "run").distinct().join(hot_hits, ["doc_id", "run"], "left").select("doc_id", "run", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"))

    marks = verdicts.unionByName(hot_verdicts)
    if keep_first:
        # the first place of a class is kept unless told otherwise; the others go
        marks = marks.unionByName(classes.join(sizes, "h", "left_anti").select("doc_id", "run", F.array().cast("array<int>").alias("hits")))
    listed = shared.select("doc_id", "run", F.lit(None).cast("array<int>").alias("hits")).unionByName(marks)
    grouped = listed.groupBy("doc_id").agg(F.collect_list(F.struct("run", "hits")).alias("x"))  # the entries of one text

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = [], []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), batch.column("x").to_pylist(), strict=True):
                told_of = {x["run"]: x["hits"] for x in found if x["hits"] is not None}
                starts = [(x["run"] >> 16) + s for x in found if x["hits"] is not None for s in x["hits"]]
                pieces = [(s, s + length) for s in starts]
                pieces += [(x["run"] >> 16, (x["run"] >> 16) + (x["run"] >> 8 & 255) - 1 + length) for x in found if x["run"] not in told_of]
                out: list[list[int]] = []
                for a, b in sorted(pieces):
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(b, out[-1][1])
                    else:
                        out.append([a, b])
                if out:
                    ids.append(doc_id)
                    spans.append([{"start": a, "end": b} for a, b in out])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])

    return cut(grouped.mapInArrow(merged, "doc_id long, spans array<struct<start:long,end:long>>"))


def removal_report(docs: DataFrame, length: int = L, gram: int = G, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = keyed(docs)
    spans = _spans(rows, length, gram, keep_first, hot)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*[values(batch.column(c)) for c in ("own", "text", "spans")], strict=True):
                data, kept, at = (text or "").encode(), hashlib.sha256(), 0
                for s in found or []:
                    kept.update(data[at : s["start"]])
                    at = s["end"]
                kept.update(data[at:])
                rows.append((doc_id, len(data), sum(s["end"] - s["start"] for s in found or []), len(found or []), kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _sized(rows, spans, "left", "spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(0, n - 199)) AS p, h FROM d WHERE n >= 200),
s AS (SELECT doc_id, p, md5_number(h[p + 1:p + 200]) AS k FROM p),
again AS (SELECT doc_id, p FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS first FROM again),
numbered AS (SELECT doc_id, p, sum(first) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY doc_id, run),
placed AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (
  SELECT placed.doc_id, string_agg(hex(h[before + 1:a]), '' ORDER BY a) AS head, max(b) AS last, count(*) AS n_spans, sum(b - a) AS n_removed
  FROM placed JOIN d ON d.doc_id = placed.doc_id GROUP BY placed.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || hex(h[coalesce(last, 0) + 1:n]))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
