"""Queries of ingestion: files of each kind are made from the driver's tables, read back and parsed.

Texts, CSV, JSON, Markdown and source code are written to the shared folder by Spark's writers, one
file for each range of ids, so their number grows with the table. Office files and PDF are
made as bytes in Arrow batches, as no writer makes them.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import catalog
from orrery.plans import model
from orrery.sources import files, snapshots, tables
from orrery.sources.shared import shared_path
from orrery.streaming import ingest

#: Rows of a table that make one file.
PER_FILE = 100
#: A window that no file exceeds: for queries that look at what a parser gives, not at windows.
WIDE = 1 << 30


def _file_id(path: Column) -> Column:
    return F.regexp_extract(path, r"file_id=(-?\d+)", 1).cast("long")


def _write_texts(rows: DataFrame, path: str, line: str = "\n") -> None:
    """(file_id, content) as one file each, in UTF-8 or, if content is binary, with its very bytes. Spark's writer ends their names in .txt, see :func:`_found`."""
    rows.select("file_id", F.col("content").cast("string").alias("content")).repartition("file_id").write.mode("append").partitionBy("file_id").option("lineSep", line).option("compression", "none").text(path)


def _found(spark: SparkSession, path: str, ending: Column | None = None) -> DataFrame:
    """The files below ``path``; the parser goes by the ``ending`` that is given to their paths, so no file has to be renamed by the driver."""
    found = files.files(spark, path).where(F.col("filename").startswith("part-"))
    if ending is not None:
        found = found.withColumns({c: F.concat(F.regexp_replace(c, r"\.txt$", ""), ending) for c in ("path", "filename")})
    return files.with_document_id(found)


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content): the texts of PER_FILE neighbouring ids, as paragraphs."""
    rows = model.table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))  # PER_FILE texts
    return rows.groupBy(F.floor(F.col("doc_id") / PER_FILE).alias("file_id")).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("content"))


def encoded_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in four encodings, told from their bytes: the encoding of each file, and what was read."""
    path, rows = shared_path(spark, "texts"), _bundles(spark, sf_dir)
    kind, latin = F.pmod("file_id", F.lit(4)), F.col("content").rlike(r"\A[\x00-\x7F\xA0-\xFF]*\z")
    _write_texts(rows.where((kind == 0) | (kind == 1) & ~latin), path)
    _write_texts(rows.where((kind == 1) & latin).withColumn("content", F.encode("content", "ISO-8859-1")), path)
    _write_texts(rows.where(kind == 2).withColumn("content", F.encode("content", "UTF-16LE")), path, "\n\0")
    _write_texts(rows.where(kind == 3).withColumn("content", F.concat(F.encode("content", "UTF-16"), F.unhex(F.lit("00")))), path)
    chunks = files.parse_files(_found(spark, path), max_tokens=WIDE)
    return chunks.select(_file_id(F.col("path")).alias("file_id"), "encoding", "parser", "chunk_index", F.col("char_count").cast("long").alias("char_count"), F.md5("text").alias("text_md5"))


def csv_file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV files, ten rows a chunk; values hold the marks of the format."""
    path = shared_path(spark, "csv")
    rows = model.table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("c_label"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.floor(F.col("c_custkey") / PER_FILE).alias("file_id")
    )
    rows.repartition("file_id").sortWithinPartitions("file_id", "c_custkey").write.partitionBy("file_id").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    chunks = files.parse_files(_found(spark, path))
    return chunks.select(_file_id(F.col("path")).alias("file_id"), "chunk_index", "row_range", "total_rows", F.array_join("columns", ",").alias("columns"), F.md5("text").alias("text_md5"))


def json_file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON arrays, ten a chunk, with their nested properties as paths."""
    path = shared_path(spark, "json")
    one = F.to_json(F.struct("event_id", "event_type", "user_id", F.from_json("props", "map<string,string>").alias("props")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("e")))), lambda x: x["e"])  # PER_FILE events
    rows = model.table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / PER_FILE).alias("file_id")).agg(F.concat(F.lit("["), F.array_join(parts, ",\n"), F.lit("]")).alias("content"))
    _write_texts(rows, path)
    chunks = files.parse_files(_found(spark, path, F.lit(".json")), max_tokens=WIDE)
    return chunks.select(_file_id(F.col("path")).alias("file_id"), "chunk_index", "json_shape", "row_range", "total_rows", F.md5("text").alias("text_md5"))


def _lines(text: Column) -> Column:
    """A text as lines without blanks at their ends, and without blank lines."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections of Markdown files, with marks that the plain text lacks."""
    path = shared_path(spark, "markdown")
    rows = model.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", _lines(F.col("text")).alias("text"))
    escaped = F.regexp_replace("text", r"([!-/:-@\[-`{-~])", r"\\$1")
    body = F.concat(
        F.lit("## *Document* `"), "doc_id", F.lit("` ##\n\n"), escaped, F.lit("\n\n- from [the **"), "source", F.lit("**](http://example.org/"), "doc_id", F.lit(' "title")\n- in __'), "lang",
        F.lit("__ &amp; ~~not~~ kept\n\n> a quote\n> `of *two*`\n\n```sql\n# SELECT 1\n```\n"),
    )
    parts = F.array_sort(F.collect_list(F.struct("doc_id", body.alias("b"))))  # PER_FILE texts
    made = rows.groupBy(F.floor(F.col("doc_id") / PER_FILE).alias("file_id")).agg(F.concat(F.lit("Bundle\n======\n\n"), F.array_join(F.transform(parts, lambda x: x["b"]), "\n")).alias("content"))
    _write_texts(made, path)
    chunks = files.parse_files(_found(spark, path, F.lit(".md")), max_tokens=WIDE)
    return chunks.select(_file_id(F.col("path")).alias("file_id"), "chunk_index", "heading_path", "heading_level", F.md5("text").alias("text_md5"))


#: A class with a method in each language, eight lines; braces in strings and comments aren't brackets.
SOURCES = {
    ".py": ["class P{k}:", "    # not a class: class X", "    def get(self, a):", '        text = "{name} }{ def no(self):"', "        return text", "", "", ""],
    ".js": ["export class P{k} extends Q {", "  /* } class No { */", "  async get(a = {}) {", "    const t = `{name} ${ {b: '}'}.b } }{`", "    return /[}]{/.test(t)", "  }", "}", ""],
    ".ts": ["export abstract class P{k}<T> {", "  // } class No {", "  public get<U>(a: { u: U }): Promise<{ u: U }> {", "    return `{name} }{` as any;", "  }", "  abstract none(): void;", "}", ""],
    ".go": ["type P{k} struct {", '\ta int `json:"}"`', "}", "// func no() {", "func (p P{k}) get(a struct{ b int }) string {", "\treturn `{name} }{` + string('}')", "}", ""],
    ".rs": ["/* } /* nested */ struct No; */", "pub(crate) struct P{k}<'a> {", "    a: &'a str,", "}", "impl<'a> P{k}<'a> {", "    pub fn get(&self) -> char { let t = r#\"{name} \"}{\"#; '}' }", "}", ""],
    ".java": ["@Table(\"{\")", "public class P{k} extends Q<R> {", "  private final int[] a = { 1, 2 };", "  @Override public String get(Map<String, int[]> a) throws E {", "    return \"{name} }{\" + new Object() { }.hashCode(); // }", "  }", "  abstract void none();", "}"],
}


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as classes with methods in six languages, a file for each range of parts: the symbols with their lines."""
    path, endings = shared_path(spark, "code"), list(SOURCES)
    rows = model.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.floor(F.col("p_partkey") / PER_FILE).alias("file_id"))
    for i, ending in enumerate(endings):
        text = F.replace(F.replace(F.lit("\n".join(SOURCES[ending]) + "\n"), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{name}"), F.col("p_name"))
        own = rows.where(F.pmod("file_id", F.lit(len(endings))) == i).select("file_id", "p_partkey", text.alias("t"))
        made = own.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "t"))), lambda x: x["t"]), "").alias("content"))  # PER_FILE classes
        _write_texts(made, f"{path}/{ending[1:]}")
    found = _found(spark, path, F.concat(F.lit("."), F.regexp_extract("path", r"/(\w+)/file_id=", 1)))
    chunks = files.parse_files(found)
    return chunks.select(_file_id(F.col("path")).alias("file_id"), "language", "symbol_name", "symbol_type", "start_line", "end_line", (F.col("chunk_index")).alias("chunk_index"))


CONTENT = '<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


def _paragraph(text: str, level: int = 0) -> str:
    style = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if level else ""
    runs = '<w:r><w:br/></w:r>'.join(f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>' for t in text.split("\n"))
    return f"<w:p>{style}{runs}</w:p>"


def _docx(title: str, parts: list[tuple[str, str, str]]) -> bytes:
    """A text document: a title, and for each part a heading, a text and a table of one row."""
    body = [_paragraph(title, 1)]
    for head, text, cell in parts:
        row = "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in ("source", cell))
        body += [_paragraph(head, 2), _paragraph(text), f"<w:tbl><w:tr>{row}</w:tr></w:tbl>"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", CONTENT.format("".join(body)))
    return out.getvalue()


def _pdf(pages: list[str]) -> bytes:
    """A document of one page a text, in WinAnsi; an empty text gives a page without any."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
    streams, kids, number = {}, [], 4
    for text in pages:
        shown = (b"(" + line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b") Tj T*" for line in text.split("\n"))
        content = zlib.compress(b"BT /F1 12 Tf 14 TL 72 700 Td " + b" ".join(shown) + b" ET" if text else b"0 0 m 9 9 l S")
        streams[number] = b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(content) + content + b"\nendstream"
        objects[number + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % number
        kids.append(b"%d 0 R" % (number + 1))
        number += 2
    objects[2] = b"<< /Type /Pages /Resources << /Font << /F1 3 0 R >> >> /Count %d /Kids [ %s ] >>" % (len(kids), b" ".join(kids))
    every = sorted((objects | streams).items())
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in every) + b"trailer << /Root 1 0 R >>\n%%EOF\n"


def _made(rows: DataFrame, ending: str, make) -> DataFrame:
    """(document_id, path, filename, content) of files that ``make`` builds from (file_id, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("file_id").to_pylist()
            content = [make(i, parts) for i, parts in zip(ids, batch.column("parts").to_pylist(), strict=True)]
            paths = [f"/made/file_id={i}/part-0{ending}" for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([f"part-{i}{ending}" for i in ids]), pa.array(content, pa.binary())], ["path", "filename", "content"])

    return files.with_document_id(rows.mapInArrow(run, "path string, filename string, content binary"))


def _parts(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    rows = model.table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text"))
    return rows.groupBy(F.floor(F.col("doc_id") / PER_FILE).alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "source", "text"))).alias("parts"))  # PER_FILE texts


def office_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as headed parts of text files of an office: headings, paths, paragraphs, tables."""
    rows = _parts(spark, sf_dir, _lines(F.regexp_replace("text", r"[^\n -~\xA0-\uD7FF]", " ")))
    made = _made(rows, ".docx", lambda i, parts: _docx(f"Bundle {i}", [(f"Document {p['doc_id']}", p["text"], str(p["source"])) for p in parts]))
    chunks = files.parse_files(made, max_tokens=WIDE)
    return chunks.select(_file_id(F.col("path")).alias("file_id"), "chunk_index", "heading_path", "heading_level", F.md5("text").alias("text_md5"))


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of PDF files, every seventh page a drawing: pages with text and their numbers."""
    latin = _lines(F.regexp_replace("text", r"[^\n -~\xA0-\xFF]", "?"))
    rows = _parts(spark, sf_dir, F.when(F.col("doc_id") % 7 == 0, "").otherwise(latin))
    made = _made(rows, ".pdf", lambda i, parts: _pdf([p["text"] for p in parts]))
    chunks = files.parse_files(made)
    return chunks.select(_file_id(F.col("path")).alias("file_id"), "chunk_index", "page_number", "total_pages", F.md5("text").alias("text_md5"))


def _text_files(rows: DataFrame) -> DataFrame:
    """(path, filename, content) of bundles."""
    name = F.concat(F.lit("part-"), "file_id", F.lit(".txt"))
    return rows.select(F.concat(F.lit("/made/file_id="), "file_id", F.lit("/"), name).alias("path"), name.alias("filename"), F.encode("content", "UTF-8").alias("content"))


def ingested_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two ingested batches, the second of which is committed twice: it changes a third of the files and empties others."""
    root, rows = shared_path(spark, "ingested"), _bundles(spark, sf_dir)
    ingest.ingest(spark, _text_files(rows), root, batch="0")
    kind = F.pmod("file_id", F.lit(3))
    second = _text_files(rows.where(kind < 2).withColumn("content", F.when(kind == 0, F.concat(F.lit("changed\n\n"), "content")).otherwise("")))
    for _ in range(2):
        ingest.ingest(spark, second, root, batch="1")
    chunks = catalog.documents_of_chunks_by_id(tables.read(spark, root, "chunks"))
    words = tables.read(spark, root, "chunks").groupBy("document_id").agg(F.min_by(F.substring("text", 1, 7), "chunk_index").alias("head"))
    done = tables.read(spark, root, "documents").select("document_id", "path", F.col("chunk_count").alias("counted"), "job_status")
    rejected = tables.read(spark, root, "rejected").select("document_id", "reason")
    all_ = done.join(chunks, "document_id", "left").join(words, "document_id", "left").join(rejected, "document_id", "left")
    return all_.select(_file_id(F.col("path")).alias("file_id"), (F.col("counted") == F.coalesce("chunk_count", F.lit(0))).alias("counts_agree"), F.coalesce(F.col("head") == "changed", F.lit(False)).alias("is_changed"), "job_status", "reason")


def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora kept as JSON lists, one a range of documents, some with short entries and one in a hundred broken; rows appended to them."""
    rows = model.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("doc_id") / PER_FILE).alias("range"))
    entry = F.when(F.col("doc_id") % 10 == 3, F.array(F.concat(F.lit("k"), "doc_id"))).otherwise(F.array(F.concat(F.lit("k"), "doc_id"), F.concat(F.lit("d"), "doc_id"), F.col("text")))
    lists = rows.groupBy("range").agg(F.to_json(F.collect_list(entry)).alias("entries"))  # PER_FILE texts
    kept = lists.select(F.concat(F.lit("c"), "range").alias("collection_id"), F.when(F.col("range") % 5 == 4, F.concat(F.lit("["), "entries")).otherwise(F.col("entries")).alias("entries"))
    new = rows.where(F.col("doc_id") % 10 == 3).select(F.concat(F.lit("c"), "range").alias("collection_id"), F.concat(F.lit("k"), "doc_id").alias("chunk_id"), F.concat(F.lit("d"), "doc_id").alias("document_id"), "text")
    corpus = snapshots.append_corpus(snapshots.corpus_of_json(kept), new)
    return corpus.select("collection_id", "chunk_id", "document_id", F.md5("text").alias("text_md5"))


QUERIES = {f.__name__: f for f in (encoded_text_files, csv_file_chunks, json_file_chunks, markdown_sections, code_symbols, office_sections, pdf_pages, ingested_in_batches, corpus_round_trip)}

_BUNDLES = """
bundles AS (
  SELECT doc_id // 100 AS file_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS content FROM documents WHERE text IS NOT NULL GROUP BY doc_id // 100)"""
_LINES = r"regexp_replace(regexp_replace({}, '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')"

SQL = {
    "encoded_text_files": rf"""
WITH {_BUNDLES},
p AS (SELECT file_id, content, list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM bundles),
t AS (SELECT file_id, content, array_to_string(p, chr(10) || chr(10)) AS t FROM p)
SELECT file_id, 'txt' AS parser, CAST(0 AS INTEGER) AS chunk_index, length(t) AS char_count, md5(t) AS text_md5,
  CASE WHEN file_id % 4 = 2 THEN 'utf-16-le' WHEN file_id % 4 = 3 THEN 'utf-16'
       WHEN file_id % 4 = 1 AND regexp_full_match(content, '[\x{{00}}-\x{{7F}}\x{{A0}}-\x{{FF}}]*', 's') AND NOT regexp_full_match(content, '[\x{{00}}-\x{{7F}}]*', 's') THEN 'cp1252' ELSE 'utf-8' END AS encoding
FROM t WHERE t <> ''""",
    "csv_file_chunks": """
WITH r AS (
  SELECT c_custkey // 100 AS file_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY c_custkey // 100) AS n,
    'c_custkey=' || c_custkey || '; c_label=' || c_name || ', "' || c_mktsegment || '"; c_mktsegment=' || CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment ELSE '' END AS t
  FROM customer WINDOW w AS (PARTITION BY c_custkey // 100 ORDER BY c_custkey))
SELECT file_id, CAST(i // 10 AS INTEGER) AS chunk_index, min(i) || '-' || max(i) AS row_range, CAST(n AS INTEGER) AS total_rows, 'c_custkey,c_label,c_mktsegment' AS columns, md5(string_agg(t, chr(10) ORDER BY i)) AS text_md5
FROM r GROUP BY file_id, i // 10, n""",
    "json_file_chunks": """
WITH r AS (
  SELECT event_id // 100 AS file_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_id // 100) AS n,
    'event_id=' || event_id || '; event_type=' || event_type || '; user_id=' || user_id || coalesce((SELECT string_agg('; props.' || k || '=' || (CAST(props AS JSON) ->> k), '') FROM (SELECT unnest(json_keys(CAST(props AS JSON))) AS k)), '') AS t
  FROM events WINDOW w AS (PARTITION BY event_id // 100 ORDER BY event_id))
SELECT file_id, CAST(i // 10 AS INTEGER) AS chunk_index, 'array' AS json_shape, min(i) || '-' || max(i) AS row_range, CAST(n AS INTEGER) AS total_rows, md5(string_agg(t, chr(10) ORDER BY i)) AS text_md5
FROM r GROUP BY file_id, i // 10, n""",
    "markdown_sections": rf"""
WITH t AS (SELECT doc_id, lang, source, {_LINES.format("coalesce(text, '')")} AS text FROM documents),
s AS (
  SELECT doc_id // 100 AS file_id, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS chunk_index, 'Bundle > Document ' || doc_id AS heading_path, 2 AS heading_level,
    'Document ' || doc_id || chr(10) || chr(10) || CASE WHEN text <> '' THEN text || chr(10) || chr(10) ELSE '' END || 'from the ' || source || chr(10) || 'in ' || lang || ' & not kept' || chr(10) || chr(10) || 'a quote' || chr(10) || 'of *two*' || chr(10) || chr(10) || '# SELECT 1' AS text FROM t)
SELECT file_id, CAST(chunk_index AS INTEGER) AS chunk_index, heading_path, heading_level, md5(text) AS text_md5 FROM s
UNION ALL SELECT DISTINCT doc_id // 100, 0, 'Bundle', 1, md5('Bundle') FROM documents""",
    "code_symbols": """
WITH p AS (SELECT p_partkey AS k, p_partkey // 100 AS file_id, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1 AS i FROM part),
kinds AS (
  SELECT * FROM (VALUES (0, 'python', 0, 'P', 'class', 1, 5), (0, 'python', 1, 'get', 'function', 3, 5), (1, 'javascript', 0, 'P', 'class', 1, 7), (1, 'javascript', 1, 'get', 'method', 3, 6),
    (2, 'typescript', 0, 'P', 'class', 1, 7), (2, 'typescript', 1, 'get', 'method', 3, 5), (3, 'go', 0, NULL, 'class', 1, 3), (3, 'go', 1, 'get', 'method', 5, 7),
    (4, 'rust', 0, 'P', 'class', 2, 4), (4, 'rust', 1, NULL, 'class', 5, 7), (4, 'rust', 2, 'get', 'function', 6, 6),
    (5, 'java', 0, 'P', 'class', 1, 8), (5, 'java', 1, 'get', 'method', 4, 6), (5, 'java', 2, 'none', 'method', 7, 7)) AS v(kind, language, pos, name, symbol_type, a, b))
SELECT file_id, language, CASE WHEN name = 'P' THEN 'P' || k ELSE name END AS symbol_name, symbol_type, CAST(8 * i + a AS INTEGER) AS start_line, CAST(8 * i + b AS INTEGER) AS end_line,
  CAST(i * CASE WHEN kind < 4 THEN 2 ELSE 3 END + pos AS INTEGER) AS chunk_index
FROM p JOIN kinds ON kind = file_id % 6""",
    "office_sections": rf"""
WITH t AS (SELECT doc_id, source, {_LINES.format(r"regexp_replace(coalesce(text, ''), '[^\n -~\x{A0}-\x{D7FF}]', ' ', 'g')")} AS text FROM documents)
SELECT doc_id // 100 AS file_id, CAST(row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS INTEGER) AS chunk_index, 'Bundle ' || (doc_id // 100) || ' > Document ' || doc_id AS heading_path, 2 AS heading_level,
  md5('Bundle ' || (doc_id // 100) || chr(10) || 'Document ' || doc_id || chr(10) || CASE WHEN text <> '' THEN text || chr(10) ELSE '' END || 'source | ' || source) AS text_md5 FROM t""",
    "pdf_pages": rf"""
WITH t AS (
  SELECT doc_id, row_number() OVER w AS page, count(*) OVER (PARTITION BY doc_id // 100) AS pages, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {_LINES.format(r"regexp_replace(coalesce(text, ''), '[^\n -~\x{A0}-\x{FF}]', '?', 'g')")} END AS text
  FROM documents WINDOW w AS (PARTITION BY doc_id // 100 ORDER BY doc_id))
SELECT doc_id // 100 AS file_id, CAST(row_number() OVER (PARTITION BY doc_id // 100 ORDER BY page) - 1 AS INTEGER) AS chunk_index, CAST(page AS INTEGER) AS page_number, CAST(pages AS INTEGER) AS total_pages, md5(text) AS text_md5 FROM t WHERE text <> ''""",
    "ingested_in_batches": f"""
WITH {_BUNDLES}
SELECT file_id, true AS counts_agree, file_id % 3 = 0 AS is_changed, CASE WHEN file_id % 3 = 1 THEN 'failed' ELSE 'done' END AS job_status, CASE WHEN file_id % 3 = 1 THEN 'no text' END AS reason FROM bundles""",
    "corpus_round_trip": """
SELECT 'c' || (doc_id // 100) AS collection_id, 'k' || doc_id AS chunk_id, 'd' || doc_id AS document_id, md5(coalesce(text, '')) AS text_md5 FROM documents
WHERE doc_id % 10 = 3 OR (doc_id // 100) % 5 <> 4""",
}
