"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are folded: lower-cased, and each run of other characters than
letters and digits becomes one space. An item of L characters may differ from its
place in a text by a budget of floor(BUDGET * L) insertions, deletions or
substitutions. Cut into budget + 1 pieces, at least one piece stands in the text
unchanged, so one pass of an automaton over a whole text finds every place that
can match; each is verified with Myers' bit-parallel distance in the window that
the budget allows, after joining hits whose windows overlap.

Items and texts keep a space at either end, so an item matches at word edges: an edge
inside a word costs an edit. Items of fewer than SHORT characters say too little to be
looked for inside texts, where short answers are everywhere; such an item is found
only where it is all that a text says.

The items are the stated query set: they are read in blocks of at most BLOCK
characters, one block at a time on the driver, and sent to the tasks, one pass over
the documents for each block, whatever their number. A worker builds the automaton of
a block once, in the broadcast value, which outlives its tasks. Documents are never
shuffled and a text stays within its task.

Defined cases: null texts and items, and those without a letter or digit, match
nothing; equal items are found under each id; a repeated row gives repeated results;
a row without an id is searched like others and its results have none; a very long
text is searched as a whole; an empty table gives an empty result; only doc_id and
text, item_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.support import small_batches, values

BUDGET = 0.05
BLOCK = 4_000_000
SHORT = 20
OTHERS = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    return OTHERS.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> Iterator[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    at = 0
    for left in range(budget + 1, 0, -1):
        n = (len(item) - at) // left
        yield at, item[at : at + n]
        at += n


def best_match(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to a stretch of ``text``, and where that stretch ends (the first such)."""
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score, best = full, 0, len(item), (len(item), 0)
    for end, c in enumerate(text, 1):
        equal = where.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(across | plus))
        down = plus & across
        score += bool(up & top) - bool(down & top)
        if score < best[0]:
            best = (score, end)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return best


#: An item: its id, its folded text between spaces, and its budget; -1 for one that has to be the whole text.
Item = tuple[int, str, int]


def edged(text: str | None) -> str:
    """The folded text between spaces."""
    return f" {folded(text)} "


def blocks_of(items: DataFrame, budget: float) -> Iterator[list[Item]]:
    block: list[Item] = []
    size = 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        item = edged(row["text"])
        if item.strip():
            if size > BLOCK:
                yield block
                block, size = [], 0
            block.append((row["item_id"], item, int(budget * (len(item) - 2)) if len(item) - 2 >= SHORT else -1))
            size += len(item)
    if block:
        yield block


def automaton_of(shared) -> ahocorasick.Automaton:
    """The automaton of a broadcast block, built once in each worker."""
    block = shared.value
    if block["automaton"] is None:
        hooks: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, item, errors) in enumerate(block["items"]):
            for offset, piece in pieces(item, max(errors, 0)):
                hooks[piece].append((i, offset))
        block["automaton"] = ahocorasick.Automaton()
        for piece, places in hooks.items():
            block["automaton"].add_word(piece, (len(piece), places))
        block["automaton"].make_automaton()
    return block["automaton"]


def _shared(docs: DataFrame, block: list[Item]):
    """A block for the tasks: about BLOCK characters at most."""
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast({"items": block, "automaton": None})


def matches(text: str | None, texts: list[Item], automaton: ahocorasick.Automaton) -> Iterator[tuple[int, int, int, int]]:
    """(item_id, distance, budget, n_places) of each item found in a text."""
    text = edged(text)
    starts: dict[int, set[int]] = defaultdict(set)
    for end, (n, places) in automaton.iter(text):
        for i, offset in places:
            starts[i].add(end + 1 - n - offset)
    for i, found in starts.items():
        item_id, item, errors = texts[i]
        if errors < 0:
            if text == item:
                yield item_id, 0, 0, 1
            continue
        near, n_places, edge = None, 0, None
        found = sorted(found)
        for k, at in enumerate(found):
            if edge is None:
                edge = at
            if k + 1 < len(found) and found[k + 1] - at <= 2 * errors:
                continue
            if edge == at and text.startswith(item, max(at, 0)) and at >= 0:
                distance = 0
            else:
                distance = best_match(item, text[max(0, edge - errors) : at + len(item) + errors])[0]
            edge = None
            if distance <= errors:
                n_places += 1
                near = distance if near is None else min(near, distance)
        if near is not None:
            yield item_id, near, errors, n_places


def contaminations(docs: DataFrame, items: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(doc_id, item_id, distance, budget, n_places) of each item found in a document, with its closest place."""
    schema = "doc_id long, item_id long, distance int, budget int, n_places int"

    def search(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        texts, automaton = shared.value["items"], automaton_of(shared)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), values(batch.column("text")), strict=True):
                rows.extend((doc_id, *found) for found in matches(text, texts, automaton))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "distance", "budget", "n_places"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def one_pass(block: list[Item]) -> DataFrame:
        shared = _shared(docs, block)
        return texts.mapInArrow(lambda batches: search(batches, shared), schema)

    passes = [one_pass(b) for b in blocks_of(items, budget)]
    return reduce(DataFrame.unionByName, passes) if passes else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, items: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` in which no item is found, each judged by its own text, whatever its id."""

    def leak(shared) -> Column:
        def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            texts, automaton = shared.value["items"], automaton_of(shared)
            for batch in batches:
                yield pa.array([any(True for _ in matches(text, texts, automaton)) for text in values(batch)], pa.bool_())

        return F.arrow_udf(search, "boolean")("text")

    for block in blocks_of(items, budget):
        docs = docs.where(~leak(_shared(docs, block)))
    return docs
