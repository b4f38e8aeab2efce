"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade > k) = 1 / (1 + exp(-(x w - b_k))) with one weight vector w for all
thresholds b_0 < b_1 < ...; the expected severity is the sum over k. Features are
the words of a text (lower-cased runs of letters and digits) and their beginnings
of 4 to 6 characters, present or not, out of a vocabulary of those that go with
high grades: of the labelled rows Spark counts, for every feature, the texts that
have it, and those with the most significant excess (log-likelihood ratio) among
texts of grade 1 and more are kept.

Grades are what the label column says, if it has more values than 0 and 1: 0 is clean,
and each value above it a threshold more. Binary labels tell toxic from clean only;
then the grade of a toxic text comes from its labelled words: 1, or 2 with SEVERE or
more different words that show a feature. So the second threshold says how dense the
marks are, not what a person graded; ``grades_from`` in the report says which it was.

``MAX_LABELLED`` bounds the labelled rows the model is fitted on (a seeded sample
by a hash of the id, texts whole); only the sparse rows of that sample, and those
features of it that are significant, reach the driver, which fits their weights by
gradient steps. Scoring covers all rows, in Arrow batches.

Defined cases: a null or wordless text has severity 0 and is not rejected; null
labels and labels without an id are ignored, and of repeated labels the highest
counts; labels below 0 count as 0; without two grades nothing is rejected; a row
without an id is scored like others; repeated rows get equal results; a very long
text is scored as a whole; an empty table gives an empty result; only doc_id and text
are read of the documents, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.support import by_ids, cut, sampled, small_batches, values

MAX_LABELLED = 20_000
#: A word counts if the chance of so large an excess is below about 1 in 10^7 and so many texts have it.
LEAST_RATIO, LEAST_TEXTS = 28.0, 5
SEVERE = 3
#: Rejected from this expected severity on.
REJECT_FROM = 0.75
WORD = re.compile(r"\w+")


def parts(word: str) -> list[str]:
    """The word and its beginnings, which end in a star."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


def vocabulary(rows: DataFrame) -> list[str]:
    """Features that mark grades above 0, from rows (grade, text)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = Counter(), Counter()
            for text, grade in zip(values(batch.column("text")), batch.column("grade").to_pylist(), strict=True):
                (high if grade > 0 else low).update({p for w in set(WORD.findall((text or "").lower())) for p in parts(w)})
            every = sorted(high | low)
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array([high[x] for x in every]), pa.array([high[x] + low[x] for x in every])], ["word", "a", "c"])

    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col("grade") > 0).alias("m")).first()
    n, m = total["n"], total["m"]
    if not m or m == n:
        return []
    each = rows.select("grade", "text").mapInArrow(features, "word string, a long, c long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(F.lit(0.0))

    a, c = F.col("a"), F.col("c")
    ratio = 2 * (part(a, c * m / n) + part(c - a, c * (n - m) / n) + part(m - a, (n - c) * m / n) + part(n - m - c + a, (n - c) * (n - m) / n))
    marked = each.where((c >= LEAST_TEXTS) & (a * n > c * m)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    return [r["word"] for r in marked.orderBy(F.desc("ratio"), "word").collect()]  # features of a bounded sample


class Marks:
    """Finds the features of a vocabulary in a text."""

    def __init__(self, words: list[str]):
        self.place = {w: i for i, w in enumerate(words)}
        self.heads = {w.rstrip("*")[:4] for w in words}

    def of(self, text: str | None) -> tuple[list[int], int]:
        """Places of the features present, in order, and the number of different words that show any."""
        found, shown = set(), 0
        for w in set(WORD.findall((text or "").lower())):
            if w[:4] in self.heads:
                hit = [self.place[p] for p in parts(w) if p in self.place]
                found.update(hit)
                shown += bool(hit)
        return sorted(found), shown


class OrdinalModel:
    """Weights of the words and the ordered thresholds."""

    def __init__(self, words: list[str], weights: np.ndarray, thresholds: np.ndarray, grades_from: str = "labels"):
        self.words, self.weights, self.thresholds, self.grades_from = words, weights, thresholds, grades_from

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def fit(texts: list[list[int]], grades: list[int], words: list[str], ridge: float = 1e-6, steps: int = 2000) -> OrdinalModel:
    """Accelerated gradient descent on the mean loss of the cumulative links, in a bounded sample.

    Each parameter has its own pace, from the row sums that bound the curvature.
    """
    grade = np.array(grades)
    top = int(grade.max())
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    col = np.fromiter((i for x in texts for i in x), np.int64, len(row))
    y = (grade[:, None] > np.arange(top)[None, :]).astype(float)
    share = np.clip(y.mean(axis=0), 1e-6, 1 - 1e-6)
    params = np.concatenate([np.zeros(len(words)), np.log(1 / share - 1)])
    reach = 1.0 + np.array([len(x) for x in texts])
    bound = np.concatenate([np.bincount(col, reach[row], len(words)) * top, np.full(top, reach.sum())]) / len(texts)
    seen, pace = params.copy(), 1 / (bound / 4 + ridge)
    for t in range(steps):
        ahead = params + t / (t + 3) * (params - seen)
        model = OrdinalModel(words, ahead[: len(words)], ahead[len(words) :])
        score = np.bincount(row, model.weights[col], len(texts))
        error = (model.above(score) - y) / len(texts)
        slope = np.concatenate([np.bincount(col, error.sum(axis=1)[row], len(words)) + ridge * model.weights, -error.sum(axis=0)])
        seen, params = params, ahead - pace * slope
    return OrdinalModel(words, params[: len(words)], np.sort(params[len(words) :]))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> OrdinalModel | None:
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).alias("label"))
    known = sampled(known, known.count(), max_labelled, 7)
    labelled = by_ids(docs.select("doc_id", "text"), cut(known), "inner")
    rows = cut(labelled.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.greatest(F.max(F.col("label").cast("int")), F.lit(0)).alias("grade")))  # a copy shows nothing new
    words = vocabulary(rows)
    if not words:
        return None

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(words)
        for batch in batches:
            found = [marks.of(t) for t in values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.int32())], ["doc_id", "grade", "marks", "shown"]
            )

    sparse = rows.mapInArrow(marked, "doc_id long, grade int, marks array<int>, shown int").orderBy("doc_id").collect()  # at most max_labelled short rows
    graded = max(r["grade"] for r in sparse) > 1
    grades = [r["grade"] if graded else int(r["grade"] > 0) + int(r["grade"] > 0 and r["shown"] >= SEVERE) for r in sparse]
    model = fit([r["marks"] for r in sparse], grades, words)
    model.grades_from = "labels" if graded else "labels and marked words"
    return model


def judged(texts: pa.Array, ordinal: OrdinalModel | None, marks: Marks) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Severity, most likely grade and number of marked words of each text."""
    found, blank = [], []
    for t in values(texts):
        found.append(marks.of(t))
        blank.append(t is None or not t.strip())
    sums, words = [float(ordinal.weights[m].sum()) if m else 0.0 for m, _ in found], [n for _, n in found]
    if ordinal is None:
        severity, grade = np.zeros(len(sums)), np.zeros(len(sums), np.int32)
    else:
        above = ordinal.above(np.array(sums, float))
        severity = above.sum(axis=1)
        chance = -np.diff(np.concatenate([np.ones((len(sums), 1)), above, np.zeros((len(sums), 1))], axis=1), axis=1)
        grade = chance.argmax(axis=1).astype(np.int32)
    blank = np.array(blank, bool)
    return np.where(blank, 0.0, severity), np.where(blank, 0, grade).astype(np.int32), words


def severities(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """doc_id, severity (expected grade), grade (the most likely one), toxic of every row."""
    ordinal = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(ordinal.words if ordinal else [])
        for batch in batches:
            severity, grade, words = judged(batch.column("text"), ordinal, marks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(severity), pa.array(grade), pa.array(severity >= REJECT_FROM), pa.array(words, pa.int32())], ["doc_id", "severity", "grade", "toxic", "n_marks"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, severity double, grade int, toxic boolean, n_marks int")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels)
    return severities(docs, model).withColumn("grades_from", F.lit(model.grades_from if model else "labels"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, each by its own text, whatever its id."""
    ordinal = learn(docs, labels)
    if ordinal is None:
        return docs

    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = Marks(ordinal.words)
        for texts in batches:
            yield pa.array(judged(texts, ordinal, marks)[0] >= REJECT_FROM)

    return docs.where(~F.arrow_udf(toxic, "boolean")("text"))
