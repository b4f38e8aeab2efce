"""Files of a directory tree as chunks.

Files come in through Spark's ``binaryFile`` source (any file system, partition by
partition; files above a size are listed without their content) and pass once through Arrow
batches: the extension picks a parser, which turns the bytes of one file into sections, or into
a reason why there are none. Everything after that is Spark expressions on the sections of a
row: cutting long ones into windows, numbering, chunk ids. Nothing is shuffled.

A table too large for one file's row is read with :func:`csv_rows`, which Spark splits.

A folder may hold anything. Encodings are told from the bytes; a file that can't be
parsed (too large, of an unknown kind, malformed, empty) gives no chunks and one row with the
reason, and stops no other.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.structured import _leaves, _levels
from orrery.functions.text import EXTENSION_LANGUAGE, chunk_id, extension, language_of, serialize_row
from orrery.operators.chunking import FALLBACK_LINES, MAX_TOKENS, OVERLAP, ROWS_PER_CHUNK, windows_of
from orrery.sources import markdown, office, pdf, symbols
from orrery.sources.encodings import decoded

MAX_FILE_BYTES = 50 * 2**20
MAX_SYMBOL_TOKENS = 4096
#: The parser of each extension.
PARSERS = {".txt": "txt", ".md": "markdown", ".markdown": "markdown", ".csv": "csv", ".json": "json", ".pdf": "pdf", ".docx": "docling", ".pptx": "docling"} | dict.fromkeys(EXTENSION_LANGUAGE, "code")
SECTION = "struct<text:string,heading_path:string,heading_level:int,symbol_name:string,symbol_type:string,start_line:int,end_line:int,row_range:string,total_rows:int,columns:array<string>,json_shape:string,depth:int,key_count:int,page_number:int,total_pages:int>"
FIELDS = re.findall(r"(\w+):(array<string>|\w+)", SECTION.removeprefix("struct<"))
META = [name for name, _ in FIELDS if name != "text"]
#: Parsers whose sections are never cut into windows: rows, pages, and what is cut already.
WHOLE = ("csv", "pdf", "code", "txt")
#: Bytes of files that give one Arrow batch.
BATCH_BYTES = 16 << 20

#: A parser from the bytes of a file to dicts with a text and, if known, page_number and the like.
Parser = Callable[[bytes], Iterable[dict]]


def parser_of(path: Column) -> Column:
    """The parser's name; null for an unknown extension."""
    known = F.create_map(*[F.lit(x) for pair in PARSERS.items() for x in pair])
    return F.element_at(known, extension(path))


def files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, filename, file_size, modified, content) of all files; larger ones aren't read, their content is null."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    columns = ["path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified")]
    small = found.where(F.col("length") <= max_bytes).select(*columns, "content")
    return small.unionByName(found.where(F.col("length") > max_bytes).select(*columns, F.lit(None).cast("binary").alias("content")))


def with_document_id(found: DataFrame) -> DataFrame:
    return found.withColumn("document_id", F.concat(F.lit("doc_"), F.substring(F.sha2("path", 256), 1, 12)))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """One ``col=val; col=val`` text for each record of CSV files with a header; every value is text."""
    table = spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(path)
    return table.select(serialize_row(table.columns).alias("text"))


def _grouped(rows: list[str], size: int) -> Iterator[tuple[str, str]]:
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        yield "\n".join(part), f"{at}-{at + len(part) - 1}"


def _csv(text: str, size: int) -> Iterator[dict]:
    csv.field_size_limit(MAX_FILE_BYTES)
    header, *records = list(csv.reader(io.StringIO(text, newline=""))) or [[]]
    rows = ["; ".join(f"{c}={v}" for c, v in zip(header, r + [""] * (len(header) - len(r)), strict=False)) for r in records if r]
    for part, span in _grouped(rows, size):
        yield {"text": part, "row_range": span, "total_rows": len(rows), "columns": header}


def _json(text: str, size: int) -> Iterator[dict]:
    value = json.loads(text)
    if isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
        rows = ["; ".join(f"{k}={v}" for k, v in _leaves(x)) for x in value]
        for part, span in _grouped(rows, size):
            yield {"text": part, "row_range": span, "total_rows": len(rows), "json_shape": "array"}
    else:
        leaves = list(_leaves(value))
        yield {"text": "\n".join(f"{k}={v}" for k, v in leaves), "json_shape": "object", "depth": _levels(value), "key_count": len(leaves)}


def _windows(words: list[str], size: int, overlap: int) -> Iterator[str]:
    step, n = size - overlap, len(words)
    for at in range(0, max(0, -(-(n - size) // step) * step) + 1, step):
        yield " ".join(words[at : at + size])


def _paragraphs(text: str, size: int, overlap: int) -> Iterator[dict]:
    """Paragraphs packed up to ``size`` words; a longer one is cut into windows."""
    held: list[str] = []
    n = 0
    for paragraph in (p.strip() for p in re.sub(r"\r\n?", "\n", text).split("\n\n")):
        words = paragraph.split()
        if held and n + len(words) > size:
            yield {"text": "\n\n".join(held)}
            held, n = [], 0
        if len(words) > size:
            yield from ({"text": w} for w in _windows(words, size, overlap))
        elif words:
            held.append(paragraph)
            n += len(words)
    if held:
        yield {"text": "\n\n".join(held)}


def _line_windows(text: str, lines: int) -> Iterator[str]:
    every = text.splitlines()
    step = max(lines, 1)
    yield from filter(None, ("\n".join(every[i : i + step]).strip() for i in range(0, len(every), step)))


def _code(text: str, language: str, lines: int) -> Iterator[dict]:
    """Symbols, the long ones as windows of lines; a file without any as windows of lines."""
    some = False
    for symbol in symbols.symbols_of(text, language):
        some = True
        if len(symbol["text"].split()) <= MAX_SYMBOL_TOKENS:
            yield symbol
        else:
            yield from (symbol | {"text": w} for w in _line_windows(symbol["text"], lines))
    if not some:
        yield from ({"text": w} for w in _line_windows(text, lines))


def parsed(
    found: DataFrame,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    fallback_lines: int = FALLBACK_LINES,
    parsers: Mapping[str, Parser] | None = None,
) -> DataFrame:
    """Each file (document_id, path, filename, content) with its parser, encoding, sections, and the reason if it has none.

    A parser in ``parsers`` replaces the one that goes by its name in PARSERS.
    """
    if overlap >= max_tokens:
        raise ValueError("the overlap has to be smaller than the window")
    own = dict(parsers or {})
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    struct = pa.struct([(name, kinds[kind]) for name, kind in FIELDS])

    def sections(name: str, language: str | None, data: bytes) -> tuple[Iterable[dict], str | None]:
        if name in own:
            return own[name](data), None
        if name in ("pdf", "docling"):
            return (pdf if name == "pdf" else office).sections_of(data), None
        text, encoding = decoded(data)
        if name == "csv":
            return _csv(text, rows_per_chunk), encoding
        if name == "json":
            return _json(text, rows_per_chunk), encoding
        if name == "markdown":
            return markdown.sections_of(text), encoding
        if name == "code":
            return _code(text, language, fallback_lines), encoding
        return _paragraphs(text, max_tokens, overlap), encoding

    names = ["document_id", "path", "filename", "parser", "encoding", "sections", "reason"]
    schema = pa.schema([(n, pa.list_(struct) if n == "sections" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("document_id", "path", "filename", "parser", "language", "ext", "content")}
                name, data, language, ext = row["parser"], row.pop("content"), row.pop("language"), row.pop("ext")
                row |= {"encoding": None, "sections": None, "reason": None}
                if name is None:
                    row["reason"] = f"no parser for {ext or 'a name without extension'}"
                elif data is None:
                    row["reason"] = "too large"
                else:
                    try:
                        out, row["encoding"] = sections(name, language, data)
                        row["sections"] = [{k: s.get(k) for k, _ in FIELDS} for s in out if s["text"].strip()]
                        row["reason"] = None if row["sections"] else "no text"
                    except Exception as e:  # whatever a parser raises concerns this file alone
                        row["reason"] = f"malformed: {type(e).__name__}: {e}"[:500]
                    size += len(data)
                rows.append(row)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    name = parser_of(F.col("path"))
    base = found.select("document_id", "path", "filename", name.alias("parser"), language_of(F.col("path")).alias("language"), extension(F.col("path")).alias("ext"), F.when(name.isNotNull(), F.col("content")).alias("content"))
    out = base.mapInArrow(run, f"document_id string, path string, filename string, parser string, encoding string, sections array<{SECTION}>, reason string")
    cut = F.when(F.col("parser").isin(*WHOLE), F.transform("sections", lambda s: F.array(s["text"]))).otherwise(F.transform("sections", lambda s: windows_of(s["text"], max_tokens, overlap)))
    return out.withColumn("pieces", cut)


def chunks_of(rows: DataFrame) -> DataFrame:
    """Chunks of :func:`parsed` files: chunk_id, document_id, path, filename, parser, encoding, chunk_index, language, char_count, text, and what the parser knows."""
    known = F.col("sections")
    each = F.flatten(F.transform("pieces", lambda texts, i: F.transform(texts, lambda t: F.struct(t.alias("text"), *[F.get(known, i)[m].alias(m) for m in META]))))
    keys = ["document_id", "path", "filename", "parser", "encoding"]
    # A piece has what the parser knows with it, so no row of a chunk carries all sections of its file.
    one = rows.where("sections IS NOT NULL").select(*keys, F.posexplode(each).alias("chunk_index", "piece")).select(*keys, "chunk_index", "piece.text", F.col("piece").alias("meta"))
    return one.select(
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), *keys, "chunk_index", F.when(F.col("parser") == "code", language_of(F.col("path"))).alias("language"), F.char_length("text").alias("char_count"), "text", *[F.col(f"meta.{m}").alias(m) for m in META]
    )


def rejected_of(rows: DataFrame) -> DataFrame:
    """(document_id, path, filename, reason) of the :func:`parsed` files that have no chunks."""
    return rows.where("reason IS NOT NULL").select("document_id", "path", "filename", "reason")


def parse_files(found: DataFrame, **options) -> DataFrame:
    """Chunks of files; for chunks and rejected files together, write :func:`parsed` once and take both from it."""
    return chunks_of(parsed(found, **options))


def rejected_files(found: DataFrame, **options) -> DataFrame:
    return rejected_of(parsed(found, **options))
