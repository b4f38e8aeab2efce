"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Writing. A page becomes a ``response`` record with an HTTP block in chunked transfer
framing; of pages with equal payloads, that with the largest id is the response and
the others are ``revisit`` records that refer to it. A block of more than
``segment_bytes`` is cut into a first record and ``continuation`` records. All of
this is built by Spark expressions on binary columns; a record is written as one
"line" of Spark's text writer whose line separator is the blank lines that end a
WARC record, so archives go through any file system that Spark writes, gzipped,
under its commit protocol.

Reading. Archives are read once, as binary files bounded in size by the writer, and
parsed by the lengths in their headers. Whole records are decoded where they are
found; segments are set aside. Segments are grouped by the record id of their origin, ordered by segment
number, joined, and checked against the total length that the last one states; then
the chunked framing is decoded and the SHA-1 digest of the payload is verified.
Revisits take the length of the payload from the record that they refer to.

Defined cases: a null or empty page has an empty payload; null urls are written as
empty; rows that repeat a page are each a record, and all rows of the largest id of
a payload are responses; a null id comes before all others; an empty table gives an
empty archive and result; a missing or short segment raises an error that names the
record; only page_id, url and html are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.support import cut, values, written

#: Bytes of a block beyond which it is segmented, and of a chunk of the transfer framing.
SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4_096
#: About so many bytes go into one archive, so a task can hold one.
ARCHIVE_RECORDS = 2_000
#: Digests (about 80 bytes each) of repeated payloads up to which they are broadcast.
BROADCAST_DIGESTS = 500_000
#: Fixed values of the format.
CRLF = "\r\n"
RECORD_END = CRLF + CRLF


def _b(text: Column | str) -> Column:
    return F.encode(F.lit(text) if isinstance(text, str) else text, "UTF-8")


def _utf8(col: Column) -> Column:
    """Bytes as a string column, as they are: what the text writer writes out again."""
    return col.cast("string")


def _urn(name: Column) -> Column:
    """A record id: an UUID made from a digest of the name."""
    h = F.md5(name)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-"))][:-1], F.lit(">"))


def chunked(payload: Column, size: int = CHUNK_BYTES) -> Column:
    """The payload in chunked transfer framing."""
    n = F.ceil(F.octet_length(payload) / size).cast("int")
    parts = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(_b(F.lower(F.hex(F.octet_length(F.substr(payload, i * size + 1, F.lit(size))).cast("long")))), _b(CRLF), F.substr(payload, i * size + 1, F.lit(size)), _b(CRLF)),
    )
    return F.concat(F.array_join(F.transform(parts, _utf8), "").cast("binary"), _b("0" + RECORD_END))


def _base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 digest: eight groups of 20 bits, four letters each."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*[F.substr(alphabet, F.shiftright(x, 5 * k).bitwiseAND(31) + 1, F.lit(1)) for x in groups for k in (3, 2, 1, 0)])


def records_of(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``record``: the text of each WARC record, without the blank lines that end it."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        _b(F.coalesce("html", F.lit(""))).alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    # one row for each payload that several pages have; beyond the limit, a join that Spark can split where one payload is very frequent
    groups = cut(rows.groupBy("sha").agg(F.max("page_id").alias("origin"), F.count("*").alias("n")).where("n > 1 AND origin IS NOT NULL").drop("n"))
    known = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_DIGESTS else groups, "sha", "left")
    revisit = F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"))
    block = F.when(F.col("revisit"), _b(head)).otherwise(F.concat(_b(head), chunked(F.col("payload"))))
    names = F.concat(F.lit("page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    made = known.withColumn("revisit", revisit).select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_id"),
        F.regexp_replace("url", r"[\r\n]", "").alias("url"),
        "revisit",
        _urn(F.concat(names, F.lit(":"), F.monotonically_increasing_id().cast("string"))).alias("record_id"),
        _urn(names).alias("name"),
        _urn(F.concat(F.lit("page:"), F.col("origin").cast("string"))).alias("refers_to"),
        _base32_sha1(F.col("payload")).alias("digest"),
        block.alias("block"),
    )
    n = F.greatest(F.ceil(F.octet_length("block") / segment_bytes).cast("int"), F.lit(1))
    cutup = made.withColumn("total", F.octet_length("block")).withColumn("n", n).select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    part = F.substr(F.col("block"), (F.col("i") - 1) * segment_bytes + 1, F.lit(segment_bytes))
    kind = F.when(F.col("i") > 1, "continuation").when(F.col("revisit"), "revisit").otherwise("response")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit(CRLF))

    first, last = F.col("i") == 1, F.col("i") == F.col("n")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(_urn(F.concat(F.col("record_id"), F.col("i").cast("string"))))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("url")),
        F.when(first, F.concat(line("WARC-Page-ID", F.col("page_id")), line("WARC-Name", F.col("name")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))))).otherwise(F.lit("")),
        F.when(first & F.col("revisit"), line("WARC-Refers-To", F.col("refers_to"))).otherwise(F.lit("")),
        F.when(F.col("n") > 1, line("WARC-Segment-Number", F.col("i").cast("string"))).otherwise(F.lit("")),
        F.when(~first, line("WARC-Segment-Origin-ID", F.col("record_id"))).otherwise(F.lit("")),
        F.when(~first & last, line("WARC-Segment-Total-Length", F.col("total").cast("string"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(part).cast("string")),
        F.lit(CRLF),
    )
    return cutup.select(_utf8(F.concat(_b(header), part)).alias("record"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Gzipped archives in ``path``, of at most ARCHIVE_RECORDS records each."""
    writer = records_of(pages, segment_bytes).write.mode("overwrite").option("lineSep", RECORD_END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        start, n = end + 4, int(fields["content-length"])
        if data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} isn't as long as it says")
        yield fields, data[start : start + n]
        at = start + n + 4


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked transfer; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk isn't as long as it says")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:])
    return unchunked(body) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else body


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGE = "name string, page_id long, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
SEGMENT = PAGE + ", record_id string, number int, total long, block binary"
KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], KINDS[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _decoded(name, page_id, kind, refers_to, digest, block: bytes, payloads: bool) -> tuple:
    """A record as a row of PAGE; the payload is verified."""
    payload = payload_of(block) if kind == "response" else None
    own = digest if payload is None else base32_sha1(payload)
    if digest is not None and own != digest:
        raise ValueError(f"payload digest {own} isn't {digest}")
    return name, page_id, kind, refers_to, own, None if payload is None else len(payload), payload if payloads else None


def _parsed(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """Rows of SEGMENT: whole records, decoded, and segments (with their number), as they stand in the archives."""
    import gzip

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data, rows = content.as_py(), []
                for f, block in parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    page, total = f.get("warc-page-id"), f.get("warc-segment-total-length")
                    head = (f.get("warc-name"), int(page) if page else None, f["warc-type"], f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None)
                    if "warc-segment-number" in f:
                        rows.append((*head, None, None, f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]), int(total) if total else None, block))
                    else:
                        rows.append((*_decoded(*head, block, payloads), None, None, None, None))
                yield _batch(rows, SEGMENT)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, SEGMENT)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """name, page_id, record_type, refers_to, payload_digest, payload_bytes, payload of every page in the archives.

    Without ``payloads``, they are decoded and verified just so, and left out of the result.
    """
    found = written(_parsed(spark, path, payloads), "records")
    columns = [f.split()[0] for f in PAGE.split(", ")]
    segments = found.where("number IS NOT NULL").groupBy("record_id").agg(
        *[F.max(c).alias(c) for c in ("name", "page_id", "refers_to", "payload_digest", "total")],
        F.max(F.when(F.col("number") == 1, F.col("record_type"))).alias("record_type"),
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),  # the segments of one record
    )
    joined = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    in_order = F.col("parts.number") == F.sequence(F.lit(1), F.size("parts"))
    whole = segments.withColumn("block", joined)
    whole = whole.withColumn("block", F.when(in_order & (F.octet_length("block") == F.col("total")), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments are missing of "), "record_id"))))
    taken = ["name", "page_id", "record_type", "refers_to", "payload_digest", "block"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_decoded(*row, payloads) for row in zip(*[values(batch.column(c)) for c in taken], strict=True)], PAGE)

    return found.where("number IS NULL").select(columns).unionByName(whole.select(taken).mapInArrow(decode, PAGE))


def page_report(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id) from the archives."""
    pages = cut(read_archives(spark, path, payloads=False).drop("payload"))
    # a table of its own, so that Spark can split the revisits of a very frequent page
    origins = written(pages.where("record_type = 'response'").groupBy("name").agg(F.first("page_id").alias("of"), F.first("payload_bytes").alias("n"), F.first("payload_digest").alias("d")), "origins")
    revisits = pages.where("record_type = 'revisit'").drop("name").join(origins, F.col("refers_to") == F.col("name"), "left")
    same = F.when(F.col("payload_digest") == F.col("d"), F.col("n"))
    return (
        pages.where("record_type = 'response'")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
        .unionByName(revisits.select("page_id", same.alias("payload_bytes"), "payload_digest", "record_type", F.col("of").alias("refers_to")))
    )


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS sha FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS origin FROM p),
b AS (SELECT *, list_transform(range(0, 40), lambda i: CAST(('0x' || substr(sha, i + 1, 1)) AS INTEGER)) AS hex FROM g)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         (((hex[CAST((i * 5) // 4 + 1 AS BIGINT)] * 16 + coalesce(hex[CAST((i * 5) // 4 + 2 AS BIGINT)], 0)) // CAST(2 ** (3 - (i * 5) % 4) AS INTEGER)) % 32) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = origin THEN NULL ELSE origin END AS refers_to
FROM b
"""
