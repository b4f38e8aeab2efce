"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is folded to lower-case letters with one space between words. Its n-grams
of 1 to 3 characters are hashed into BUCKETS cells. Training counts cells by
language on the executors; what comes back are the summed counts (languages x
cells). The matrix of log-probabilities is broadcast, and tasks score batches of
texts at once: a batch is one sparse matrix of counts, in compressed rows (text by
text the cells it has, and how often), and its product with the dense matrix gives
the scores of all its texts. The score is the posterior of the language, with
equal priors.

``MAX_TRAINING`` bounds the texts that the counts come from: an equal share for each
label, or all that a rare one has, drawn by a hash of the id; texts are read whole. All
labels are learned: LANGUAGES of them make one matrix, more make further ones, and a text
passes through them one after the other with its best language so far and the sum of all.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as
are all texts if there is nothing to learn from; a null id is neither held out nor
learned from; equal scores go to the language that comes first by code point;
repeated rows get equal results; a very long text is counted in runs of bounded
length; an empty table gives an empty result; only doc_id, text and lang are read,
so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.support import BROADCAST_IDS, cut, small_batches, unit_hash, values, written

BUCKETS = 1 << 15
MAX_TRAINING = 20_000
#: Languages of one matrix; more make further matrices.
LANGUAGES = 500
#: Characters that are looked at together, and numbers that one step of the product holds.
BLOCK, STEP = 1 << 18, 1 << 21
KNUTH = np.uint32(2654435761)


def fold(code: int) -> int:
    """The lower-case letter of a code point, or a space."""
    c = chr(code)
    if not c.isalpha():
        return 32
    low = c.lower()
    return ord(low) if len(low) == 1 else code


def folding() -> np.ndarray:
    """:func:`fold` of the basic plane."""
    return np.array([fold(i) for i in range(0x10000)], np.uint32)


def folded(text: str | None, table: np.ndarray) -> np.ndarray:
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = table[np.minimum(codes, 0xFFFF)]
    for code in np.unique(codes[codes > 0xFFFF]):
        low[codes == code] = fold(int(code))
    space = low == 32
    return low[~(space & np.concatenate([[False], space[:-1]]))]


def stretches(codes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, texts they belong to, whether an n-gram may begin there): folded texts in runs of about BLOCK characters.

    A longer text is cut into parts; each part also shows the two characters after it.
    """
    held: list[tuple[int, np.ndarray, int]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = [len(p) for _, p, _ in held]
        own = np.concatenate([np.arange(len(p)) < n for _, p, n in held])
        return np.concatenate([p for _, p, _ in held]), np.repeat([i for i, _, _ in held], lengths), own

    for i, c in enumerate(codes):
        for at in range(0, len(c), BLOCK):
            held.append((i, c[at : at + BLOCK + 2], min(BLOCK, len(c) - at)))
            size += len(held[-1][1])
            if size >= BLOCK:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def sparse(codes: np.ndarray, owner: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The count matrix of a run of texts: (text, cell, count) of its entries, in the order of texts and cells."""
    h, found = np.zeros(len(codes), np.uint32), []
    for j in range(3):
        if len(codes) <= j:
            break
        n = len(codes) - j
        h = (h[:n] + codes[j:] + np.uint32(1)) * KNUTH
        h ^= h >> np.uint32(15)
        inside = (owner[:n] == owner[j:]) & own[:n]
        found.append(owner[:n][inside] * BUCKETS + (h[inside] & np.uint32(BUCKETS - 1)).astype(np.int64))
    entries, counts = np.unique(np.concatenate(found), return_counts=True)
    return entries // BUCKETS, entries % BUCKETS, counts


def product(n_texts: int, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], dense: np.ndarray) -> np.ndarray:
    """The sparse count matrix of n texts, given in parts, times the dense matrix (cells x languages)."""
    out = np.zeros((n_texts, dense.shape[1]))
    step = max(1, STEP // max(1, dense.shape[1]))
    for text, cell, count in parts:
        for at in range(0, len(text), step):
            row = text[at : at + step]
            terms = dense.take(cell[at : at + step], axis=0) * count[at : at + step, None]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[first]] += np.add.reduceat(terms, first, axis=0, dtype=np.float64)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, cell, n) over the texts of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = folding(), dict[str, np.ndarray]()
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            for part in stretches([folded(t, table) for t in values(batch.column("text"))]):
                text, cell, n = sparse(*part)
                lang = codes[text]
                for i in np.unique(lang):
                    own = lang == i
                    sums = np.bincount(cell[own], n[own], BUCKETS).astype(np.int64)
                    total[names[i]] = total[names[i]] + sums if names[i] in total else sums
        for lang, n in total.items():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(hit), pa.array(n[hit])], ["lang", "cell", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


Model = list[tuple[list[str], np.ndarray]]


def learn(docs: DataFrame, max_training: int = MAX_TRAINING, languages: int = LANGUAGES) -> Model:
    """Blocks of languages, each with its matrix of log-probabilities (cells x languages), from (doc_id, text, lang).

    Of more texts than ``max_training``, each language gives an equal share, or all it has.
    """
    ready = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    sizes = cut(ready.groupBy("lang").agg(F.count("*").alias("n")))
    total, every = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if total > max_training:
        shares = ready.join(F.broadcast(sizes) if every <= BROADCAST_IDS else sizes, "lang")
        ready = shares.where(unit_hash("doc_id", F.lit(11)) < F.lit(max_training / every) / F.col("n")).drop("n")
    counted = written(counts(ready), "cells")
    names = sorted(r["lang"] for r in counted.select("lang").distinct().toLocalIterator())  # labels, not rows
    model: Model = []
    for at in range(0, len(names), languages):
        own = names[at : at + languages]
        place = {name: i for i, name in enumerate(own)}
        found = counted.where(F.col("lang").between(own[0], own[-1])).toPandas()  # at most ``languages`` x BUCKETS rows
        matrix = np.full((BUCKETS, len(own)), 0.5)
        matrix[found["cell"].to_numpy(), found["lang"].map(place).to_numpy()] += found["n"].to_numpy()
        model.append((own, np.log(matrix / matrix.sum(axis=0)).astype(np.float32)))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of (doc_id, text).

    One pass of Arrow batches for each block of languages, within one stage; a row carries
    the best language so far, its log-probability, and the sum of all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit("und").alias("lang_pred"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("every"))

    def scored(rows: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast(matrix)  # BUCKETS x LANGUAGES at most

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, logs = folding(), shared.value
            for batch in batches:
                langs, tops, sums = [], [], []
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    codes = [folded(t, table) for t in values(part.column("text"))]
                    lettered = np.array([bool((c != 32).any()) for c in codes], bool)
                    total = product(len(codes), (sparse(*p) for p in stretches(codes)), logs)
                    best, top = total.argmax(axis=1), total.max(axis=1)
                    every = top + np.log(np.exp(total - top[:, None]).sum(axis=1))
                    old, before = part.column("top").to_numpy(zero_copy_only=False), part.column("every").to_numpy(zero_copy_only=False)
                    newer = np.isnan(old) | (top > old)
                    langs += [(names[b] if new else was) if ok else "und" for b, new, was, ok in zip(best, newer, part.column("lang_pred").to_pylist(), lettered, strict=True)]
                    tops += np.where(lettered, np.where(newer, top, old), np.nan).tolist()
                    sums += np.where(lettered, np.where(np.isnan(before), every, np.logaddexp(np.nan_to_num(before), every)), np.nan).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(langs, pa.string()), pa.array(tops, from_pandas=True), pa.array(sums, from_pandas=True)], ["doc_id", "text", "lang_pred", "top", "every"])

        return rows.mapInArrow(score, "doc_id long, text string, lang_pred string, top double, every double")

    for names, matrix in model:
        rows = scored(rows, names, matrix)
    return rows.select("doc_id", "lang_pred", F.least(F.lit(1.0), F.coalesce(F.exp(F.col("top") - F.col("every")), F.lit(0.0))).alias("score"))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; what is held out is not learned from."""
    small_batches(docs.sparkSession)
    found = predict(docs, learn(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
