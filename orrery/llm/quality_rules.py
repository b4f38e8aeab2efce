"""Quality rules: a learned decision list, in Spark expressions.

Statistics of every text are computed by expressions over its array of words. A
decision list is then learned from labelled rows by sequential covering: a rule is
grown, one threshold condition at a time, on two thirds of the labelled rows by
FOIL's information gain until it covers hardly any good document, pruned from its
end on the remaining third, and kept if it is still precise there; rows that it
covers are set aside and the next rule is grown. Each step is one small Spark
aggregation (feature, bin) -> (bad, all); the driver sees some hundred counts. The
list becomes one ordered CASE expression over the statistics.

``MAX_LABELLED`` bounds the labelled rows that the list is learned from (a seeded
sample of them, by a hash of the id); the statistics and the verdict cover all
rows. A list has no bound of its own: it ends when the next rule isn't precise, and a
rule when no condition tells more.

Defined cases: a null text has no words and fails the base rule; labels that are
null are ignored and of repeated labels the lowest counts; without labelled rows,
or if all are of one class, the list is empty and the base rule decides; repeated
rows get equal results; a very long text is one row, worked on as a whole; an empty
table gives an empty result; of the input, only doc_id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.support import cut, sampled, words_of

MAX_LABELLED = 100_000
#: A rule has to be right for so many of the rows it covers, and cover so many.
PRECISION, LEAST_COVER = 0.9, 5
QUANTILES = [i / 40 for i in range(1, 40)] + [0.99, 0.995]


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words of whole texts.

    Windows of three words are hashed to 64 bits; each hash is paired with its
    place, the pairs are sorted, and places whose hash equals a neighbour's start
    a repeated window. Everything happens inside the row.
    """
    words = docs.select("doc_id", "text", words_of(F.col("text")).alias("w"))
    n = F.size("w")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    hashed = words.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).alias("n_symbols"),
        lines.alias("lines"),
        F.when(n < 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
        .alias("h"),
    )
    paired = hashed.select(
        "doc_id",
        "n_words",
        "word_chars",
        F.coalesce("n_symbols", F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.array().cast("array<struct<h:bigint,i:int>>"))
        .otherwise(F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .alias("s"),
    )
    twice = F.transform(
        "s",
        lambda x, k: F.when((x["h"] == F.get("s", k + 1)["h"]) | ((k > 0) & (x["h"] == F.get("s", k - 1)["h"])), x["i"]),
    )
    placed = paired.withColumn("p", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return placed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "words_per_line": F.col("n_words") / lines,
    }


class DecisionList:
    """Ordered rules; a rule is a list of (feature, at_least, threshold), and a text that meets all of one is rejected."""

    def __init__(self, rules: list[list[tuple[str, bool, float]]]):
        self.rules = rules

    def column(self) -> Column:
        """Place of the first rule that a row meets, from 0; null if there is none."""
        of = features()
        out = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules))):
            met = F.lit(True)
            for name, at_least, threshold in rule:
                met = met & (of[name] >= threshold if at_least else of[name] < threshold)
            out = F.when(met, F.lit(i)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{n} {'>=' if g else '<'} {t:.6g}" for n, g, t in r) for r in self.rules)


def learn(stats: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """A list that tells rows labelled 0 from the others."""
    names = list(features())
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("label"))
    known = sampled(known, known.count(), max_labelled, 5)
    rows = cut(
        stats.join(known, "doc_id").select(
            *[c.alias(k) for k, c in features().items()],
            (F.col("label") == 0).cast("int").alias("bad"),
            (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) > 0).alias("grow"),
        )
    )
    # exact quantiles of each class; the sample is bounded
    per_class = rows.groupBy("bad").agg(*[F.percentile(k, F.array(*[F.lit(q) for q in QUANTILES])).alias(k) for k in names]).collect()
    if len(per_class) < 2:
        return DecisionList([])
    steps = {k: sorted({v for r in per_class for v in r[k]}) for k in names}

    def bin_of(name: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(t)) for t in steps[name]]), lambda t: t <= F.col(name))).alias(name)

    binned = [bin_of(k) for k in names]
    rows = cut(rows.select("bad", "grow", *binned))  # from here on a row is six small bins

    def met(rule: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for name, at_least, i in rule:
            out = out & (F.col(name) > i if at_least else F.col(name) <= i)
        return out

    def counts(where: Column) -> dict[str, dict[int, tuple[int, int]]]:
        long = rows.where(where).select("bad", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("bin")) for k in names])).alias("x"))
        out: dict[str, dict[int, tuple[int, int]]] = {k: {} for k in names}
        for r in long.groupBy("x.name", "x.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect():  # features x bins
            out[r["name"]][r["bin"]] = (r["bad"], r["n"])
        return out

    rules: list[list[tuple[str, bool, int]]] = []
    left = F.lit(True)
    aside: set[tuple[str, bool]] = set()  # first conditions (feature and direction) that led to imprecise rules
    while True:
        rule: list[tuple[str, bool, int]] = []
        while True:
            have = counts(F.col("grow") & left & met(rule))
            bad, n = (sum(x[i] for x in have[names[0]].values()) for i in (0, 1))
            if not bad or bad == n:
                break
            best = (0.0, ("", True, 0))
            for name in names:
                low_bad = low_n = 0
                for i in range(len(steps[name])):
                    b, m = have[name].get(i, (0, 0))
                    low_bad, low_n = low_bad + b, low_n + m
                    for p, c, at_least in ((bad - low_bad, n - low_n, True), (low_bad, low_n, False)):
                        if p >= LEAST_COVER and (rule or (name, at_least) not in aside):
                            best = max(best, (p * (math.log2(p / c) - math.log2(bad / n)), (name, at_least, i)))
            if not best[0]:
                break
            rule.append(best[1])
        if not rule:
            break
        # prune: the prefix that is best on the other third, by (right - wrong) / covered
        tried = rows.where(~F.col("grow") & left).agg(*[F.sum(F.when(met(rule[:k]), x)).alias(f"{c}{k}") for k in range(1, len(rule) + 1) for c, x in (("p", F.col("bad")), ("c", F.lit(1)))]).first()
        worth = max((((2 * (tried[f"p{k}"] or 0) - tried[f"c{k}"]) / tried[f"c{k}"], -k) for k in range(1, len(rule) + 1) if tried[f"c{k}"]), default=(-1.0, 0))
        k = -worth[1]
        if not k or tried[f"p{k}"] < PRECISION * tried[f"c{k}"]:
            aside.add(rule[0][:2])  # grown anew from the next best first condition
            continue
        aside.clear()
        rules.append(rule[:k])
        left = left & ~met(rule[:k])
    return DecisionList([[(name, at_least, float(steps[name][i])) for name, at_least, i in rule] for rule in rules])


def judge(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """The statistics of every row, base_failed, rule (place of the rule that rejects it) and kept."""
    stats = cut(text_statistics(docs.select("doc_id", "text")))
    rule = learn(stats, labels, label_col).column()
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def statistics_report(docs: DataFrame) -> DataFrame:
    """The part of :func:`quality_report` that isn't learned."""
    stats = text_statistics(docs.select("doc_id", "text")).withColumn("base_failed", base_failed())
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


#: Of the statistics and the base rule; the list itself is learned, which SQL can't express.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS g FROM t WHERE len(w) > 2),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN lines ON lines.doc_id = t.doc_id LEFT JOIN covered ON covered.doc_id = t.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""
