"""Cutting texts into chunks: row groups, line windows, token windows, packed paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.bpe import Encoder
from orrery.sources.shared import stored

MAX_TOKENS, OVERLAP, ROWS_PER_CHUNK, FALLBACK_LINES = 512, 64, 10, 50


def row_groups(rows: DataFrame, key: str, order: str, text: str = "text", size: int = ROWS_PER_CHUNK) -> DataFrame:
    """(key, chunk_index, row_range, total_rows, text): ``size`` rows a chunk, in order.

    A key's rows are dealt by a range exchange, numbered slice by slice after the counted rows of the
    key's slices before, and gathered by chunk, so a key of any number of rows is many tasks.
    """
    if size < 1:
        raise ValueError("a chunk has at least one row")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = stored(rows.select(key, order, text).repartitionByRange(parts, key, order).withColumn("_slice", F.spark_partition_id()), "slices")
    sums = dealt.groupBy(key, "_slice").agg(F.count("*").alias("n"))  # a row for each key and slice
    before = Window.partitionBy(key).orderBy("_slice")
    offsets = sums.select(key, "_slice", (F.sum("n").over(before) - F.col("n")).alias("_before"), F.sum("n").over(Window.partitionBy(key)).alias("total_rows"))
    numbered = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_slice").orderBy(order)) - 1).join(offsets, [key, "_slice"]).withColumn("_i", F.col("_place") + F.col("_before"))
    return numbered.groupBy(key, F.floor(F.col("_i") / size).cast("int").alias("chunk_index")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("text"),  # at most ``size`` rows
        F.concat_ws("-", F.min("_i").cast("string"), F.max("_i").cast("string")).alias("row_range"),
        F.max("total_rows").alias("total_rows"),
    )


def _pieces(units: Column, starts: Column, size: int, separator: str) -> Column:
    return F.transform(starts, lambda s: F.array_join(F.slice(units, s + 1, F.lit(size)), separator))


def line_windows(texts: DataFrame, text: str = "text", lines: int = FALLBACK_LINES) -> DataFrame:
    """Adds chunk_index and chunk: windows of so many lines, trimmed, blank ones left out."""
    step = max(lines, 1)
    rows = texts.withColumn("_l", F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"))
    starts = F.sequence(F.lit(0), F.size("_l") - 1, F.lit(step))
    cut = F.filter(F.transform(_pieces(F.col("_l"), starts, step, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return rows.select(*texts.columns, F.posexplode(cut).alias("chunk_index", "chunk"))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """0, step, 2 step, ... up to the window that reaches the end."""
    if overlap >= size:
        raise ValueError("the overlap has to be smaller than the window")
    step = size - overlap
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int") * step), F.lit(step))


def windows_of(text: Column, size: int, overlap: int) -> Column:
    """Windows over the words of a text; a text of one window stays as it is, a blank one has none."""
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) <= size, F.array(text)).otherwise(_pieces(words, window_starts(F.size(words), size, overlap), size, " "))


def sliding_windows(texts: DataFrame, text: str = "text", size: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Adds chunk_index and chunk, with words as tokens; see :func:`token_windows` for a real tokenizer."""
    rows = texts.withColumn("_w", F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))
    small = F.when(F.size("_w") == 0, F.array().cast("array<string>")).when(F.size("_w") <= size, F.array(text))
    cut = small.otherwise(_pieces(F.col("_w"), window_starts(F.size("_w"), size, overlap), size, " "))
    return rows.select(*texts.columns, F.posexplode(cut).alias("chunk_index", "chunk"))


def token_windows(texts: DataFrame, tokenizer_file: str, text: str = "text", size: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """As :func:`sliding_windows`, with the tokens of a public tokenizer file (tokenizer.json)."""
    if overlap >= size:
        raise ValueError("the overlap has to be smaller than the window")

    sent = texts.sparkSession.sparkContext.broadcast(Encoder(tokenizer_file))  # its path; a worker makes the encoder once

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = sent.value
        tokenizer = encode.tokenizer

        def ids_of(value: str) -> list[int]:
            if encode.by_words and not any(a in value for a in encode.added):
                return np.frombuffer(encode(value), "<u4").tolist()
            tokenizer.encode_special_tokens = False
            try:
                return tokenizer.encode(value, add_special_tokens=False).ids
            finally:
                tokenizer.encode_special_tokens = True

        def one(value: str | None) -> list[str]:
            if not value or not value.strip():
                return []
            ids = ids_of(value)
            if len(ids) <= size:
                return [value]
            starts = range(0, len(ids) - overlap, size - overlap)
            return [w for w in (tokenizer.decode(ids[s : s + size]).strip() for s in starts) if w]

        for batch in batches:
            yield batch.map(one)

    return texts.select(*texts.columns, F.posexplode(cut(text)).alias("chunk_index", "chunk"))


def token_counts(texts: DataFrame, tokenizer_file: str, text: str = "text") -> DataFrame:
    """Adds n_tokens: how many tokens a public tokenizer file (tokenizer.json) makes of each text; a null text has none."""

    sent = texts.sparkSession.sparkContext.broadcast(Encoder(tokenizer_file))  # its path; a worker makes the encoder once

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = sent.value
        for batch in batches:
            yield batch.map(lambda t: len(encode(t)) // 4 if t else 0)

    return texts.withColumn("n_tokens", count(text))


def packed_paragraphs(texts: DataFrame, text: str = "text", size: int = MAX_TOKENS, overlap: int = OVERLAP, separator: str = "\n\n") -> DataFrame:
    """Adds chunk_index and chunk: paragraphs packed up to ``size`` words; a longer one is cut into windows."""
    state = "struct<done:array<string>,held:string,n:int>"
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    def flushed(acc: Column) -> Column:
        return F.when(acc["held"] != "", F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])

    def step(acc: Column, p: Column) -> Column:
        n = F.size(F.split(p, r"\s+"))
        long = F.struct(F.concat(flushed(acc), windows_of(p, size, overlap)).alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))
        full = F.struct(flushed(acc).alias("done"), p.alias("held"), n.alias("n"))
        fits = F.struct(acc["done"].alias("done"), F.when(acc["held"] == "", p).otherwise(F.concat(acc["held"], F.lit(separator), p)).alias("held"), (acc["n"] + n).alias("n"))
        return F.when(n > size, long).when(acc["n"] + n > size, full).otherwise(fits).cast(state)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("n")).cast(state)
    rows = texts.withColumn("_p", paragraphs)
    return rows.select(*texts.columns, F.posexplode(F.aggregate("_p", start, step, flushed)).alias("chunk_index", "chunk"))
