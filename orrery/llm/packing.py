"""Packing of tokenized documents into sequences: first-fit decreasing in random groups.

A document is the ids that a public tokenizer gives its whole text, and an end id. It
is cut every LENGTH ids; a whole piece is a sequence of its own and isn't moved. What
is left of each document, less than LENGTH ids, is dealt to groups of about GROUP
pieces by a hash of its place in the stored table, which is random to its length, and
each group is packed by itself: pieces in falling length go to the first bin that has
room. The capacities of the bins are the leaves of a tournament tree, in which a node
has the larger capacity of its two children, so the first bin with room is found by
one walk from the root.

First fit leaves gaps. A sequence isn't padded if its length is a power of two;
otherwise it is padded to LENGTH. So the emptiest bins are taken apart, and their
pieces are cut to fill gaps of LEAST_GAP ids and more in the other bins, and what
remains of the last one is cut into sequences whose lengths are powers of two. A gap
smaller than LEAST_GAP isn't worth a cut document and is padded.

Tokenization is done once: pieces are a table in the shared folder, with their ids as
little-endian 32-bit integers. The tokenizer cuts a text into words by a fixed pattern
before it merges bytes, so ids of a word hang on that word alone; a worker keeps the
ids of the words it met last, up to CACHE of them, and asks the tokenizer for others.
Texts with characters for which the pattern of two libraries might differ go through
the tokenizer as they are, in runs that end before a single space between two
characters that aren't white space, where the pattern always cuts.

Defined cases: a null or empty text is its end id alone; repeated rows and ids are
packed each for itself, null ids too; equal lengths keep their stored order; a very
long text is tokenized in runs and cut; an empty table gives an empty result; only
doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import bpe
from orrery.llm.support import small_batches, values, written

LENGTH = 1024
END_ID = 0
GROUP = 4096
LEAST_GAP = 16
#: Words whose ids a worker keeps, and characters of a text that the tokenizer sees at once.
CACHE, RUN = bpe.CACHE, bpe.RUN
VOCABULARY = "byte_bpe_50k.json"

def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(bpe.Encoder):
    """The encoder with the bounds of this module."""

    def bounds(self) -> tuple[int, int]:
        return CACHE, RUN


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) of every document cut at multiples of ``length``."""
    names = ["doc_id", "start", "length", "doc_tokens", "ids"]

    sent = docs.sparkSession.sparkContext.broadcast(Encoder(path))  # its path; a worker makes the encoder once, and its words outlive a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = sent.value, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, start, total, data = [], [], [], []
            for i, text in enumerate(values(batch.column("text"))):
                ids = encode(text or "") + end
                cuts = range(0, len(ids), 4 * length)
                row += [i] * len(cuts)
                start += [at // 4 for at in cuts]
                total += [len(ids) // 4] * len(cuts)
                data += [ids[at : at + 4 * length] for at in cuts]
            doc = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array(total, pa.int64()), pa.array(data, pa.binary())], names)

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, ids binary")


class Tournament:
    """Capacities of bins as the leaves of a tree whose nodes have the larger of two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``, which it then holds."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        bin_ = at - self.leaves
        most[at] -= size
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, size); no item is larger than ``capacity``."""
    tree, bins = Tournament(len(sizes), capacity), []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        at = tree.place(size)
        if at == len(bins):
            bins.append([])
        bins[at].append((item, 0, size))
    return bins


def is_power(n: int) -> bool:
    return n & (n - 1) == 0


def filled(bins: list[list[tuple[int, int, int]]], capacity: int, least_gap: int = LEAST_GAP) -> list[list[tuple[int, int, int]]]:
    """The bins with larger gaps filled from the emptiest ones, and the last of those as sequences of powers of two."""

    def load(b: list) -> int:
        return sum(p[2] for p in b)

    order = sorted(bins, key=load, reverse=True)
    done, low, loose = [], len(order), []  # loose: pieces of the bins taken apart
    for at, b in enumerate(order):
        if at >= low:
            break
        gap = capacity - load(b)
        while gap >= least_gap and not (gap and not loose and low == at + 1):
            if not loose:
                low -= 1
                loose = order[low][::-1]
                continue
            item, start, size = loose.pop()
            taken = min(size, gap)
            b = [*b, (item, start, taken)]
            gap -= taken
            if taken < size:
                loose.append((item, start + taken, size - taken))
        if gap >= least_gap:  # the last bin: nothing is left to fill it with
            loose = b[::-1]
        else:
            done.append(b)
    rest = sum(p[2] for p in loose)
    for bit in reversed(range(rest.bit_length())):
        room, own = rest & (1 << bit), []
        while room:
            item, start, size = loose.pop()
            taken = min(size, room)
            own.append((item, start, taken))
            room -= taken
            if taken < size:
                loose.append((item, start + taken, size - taken))
        if own:
            done.append(own)
    return done


#: Sequences of a group have numbers from group * 2^GROUP_BITS on.
GROUP_BITS = 20


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP, seed: int = 0) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset) of every piece of every document."""
    stored = written(pieces(docs, path or vocabulary_path(), length, end_id), "pieces").withColumn("row", F.monotonically_increasing_id())
    columns = ["doc_id", "start", "length", "doc_tokens", "ids"]
    whole = stored.where(F.col("length") == length).select(*columns, (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = stored.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.select(*columns, F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)).alias("group"))

    def pack(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        bins = filled(first_fit_decreasing(sizes, length), length)
        item, start, size = (np.array(x, np.int64) for x in zip(*(p for b in bins for p in b), strict=True))
        sequence = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        ends = np.cumsum(size)
        counts = np.array([len(b) for b in bins])
        base = np.repeat((ends - size)[np.cumsum(counts) - counts], counts)
        all_ids = table.column("ids").to_pylist()
        own = [all_ids[i][4 * s : 4 * (s + n)] for i, s, n in zip(item.tolist(), start.tolist(), size.tolist(), strict=True)]
        rows = table.take(pa.array(item))
        number = ((table.column("group")[0].as_py() << GROUP_BITS) + sequence) * 2 + 1
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "start": pa.array(rows.column("start").to_numpy() + start),
                "length": pa.array(size),
                "doc_tokens": rows.column("doc_tokens"),
                "ids": pa.array(own, pa.binary()),
                "sequence_id": pa.array(number),
                "offset": pa.array(ends - size - base),
            }
        )

    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
    return whole.unionByName(dealt.groupBy("group").applyInArrow(pack, schema))


def sequences(packs: DataFrame, length: int = LENGTH, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, tokens, ids, doc_ids): what a trainer reads; ``ids`` are padded unless their number is a power of two."""
    parts = packs.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))  # LENGTH ids at most
    tokens = F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    pad = F.unhex(F.lit(int(pad_id).to_bytes(4, "little").hex()))
    missing = F.when(F.bit_count(F.col("tokens")) == 1, 0).otherwise(F.lit(length) - F.col("tokens")).cast("int")
    ids = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    padding = F.unhex(F.repeat(F.hex(pad), missing))
    return parts.withColumn("tokens", tokens).select("sequence_id", "tokens", F.concat(ids, padding).alias("ids"), F.transform("p", lambda p: p["doc_id"]).alias("doc_ids"))


def pack_report(packs: DataFrame) -> DataFrame:
    """Places of the pieces, with the CRC-32 of their ids."""
    return packs.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
