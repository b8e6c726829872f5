"""WARC derivatives: metadata and plain-text conversion records of response records."""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: (pattern, replacement) in order, in the syntax that RE2 and Java share.
TEXT_RULES = (
    (r"(?is)<(script|style|template)[^>]*>.*?</(script|style|template)[^>]*>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)</?(address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|title|tr|ul)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))
SPACE_RULES = ((r"[ \t\r\f\x0B]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""))
TITLE = r"(?is)<title[^>]*>(.*?)</title"
VERSION = "WARC/1.1\r\n"


def plain_text(html: Column) -> Column:
    """Visible text of a page: markup, scripts and comments out, blocks on lines, common and numeric entities decoded."""
    for pattern, new in TEXT_RULES:
        html = F.regexp_replace(html, pattern, new)
    html = F.when(html.contains("&#"), _numeric(html)).otherwise(html)
    for name, char in ENTITIES:
        html = F.replace(html, F.lit(name), F.lit(char))
    for pattern, new in SPACE_RULES:
        html = F.regexp_replace(html, pattern, new)
    return html


#: Numeric entities after their mark, in the syntax that RE2 and Java share.
DECIMAL, HEXADECIMAL = "^[0-9]{1,7};", "^[xX][0-9a-fA-F]{1,6};"


def _numeric(html: Column) -> Column:
    """Numeric entities as characters; those that name no visible character stay as they are."""
    parts = F.split(html, "&#")

    def char(part: Column) -> Column:
        digits = F.substring_index(part, ";", 1)
        n = F.when(part.rlike(DECIMAL), digits.cast("int")).when(part.rlike(HEXADECIMAL), F.conv(F.substring(digits, 2, 6), 16, 10).cast("int"))
        fine = n.between(32, 126) | n.between(160, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        new = F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
        return F.when(fine, F.concat(new, F.substring(part, F.length(digits) + 2, F.length(part)))).otherwise(F.concat(F.lit("&#"), part))

    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), char)
    return F.concat(parts[0], F.array_join(rest, ""))


def urn(*parts: Column) -> Column:
    """A record id of the parts, the same on every run."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(block, "utf-8"), 256))


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as response records. Null urls and bodies count as empty."""
    url, body = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "html"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return pages.select("page_id", urn(F.lit("response"), page, url).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), body.alias("payload"), digest(body).alias("payload_digest"))


def derive(responses: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Two rows for each response: its metadata record and its conversion record.

    ``responses`` has record_id, target_uri, warc_date, http_headers, payload and
    payload_digest; ``keys`` are further columns to carry along. Both derived
    records name the response in refers_to and each other in concurrent_to, and keep
    the response's target, date, payload digest and HTTP headers. Null payloads and headers count as empty, a missing payload digest is
    computed. Repeated responses give repeated records; other columns are left out.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = responses.select(*keys, text("record_id").alias("refers_to"), text("target_uri").alias("target_uri"), text("warc_date").alias("warc_date"), text("http_headers").alias("h"), text("payload").alias("p"), F.col("payload_digest").alias("d"))
    base = base.withColumn("source_digest", F.coalesce("d", digest(F.col("p"))))
    base = base.withColumn("conversion_id", urn(F.lit("conversion"), F.col("refers_to"))).withColumn("title", F.regexp_replace(F.regexp_extract("p", TITLE, 1), r"\s+", " "))
    fields = F.concat(
        F.lit("conversion-record: "), F.col("conversion_id"), F.lit("\r\nsource-payload-digest: "), F.col("source_digest"), F.lit("\r\nsource-payload-bytes: "), F.octet_length("p").cast("string"),
        F.lit("\r\ntitle: "), F.col("title"), F.lit("\r\nsource-http: "), F.replace(F.col("h"), F.lit("\r\n"), F.lit("\r\nsource-http: ")), F.lit("\r\n"),
    )
    record = lambda kind, rid, other, media, block: F.struct(F.lit(kind).alias("warc_type"), rid.alias("record_id"), other.alias("concurrent_to"), F.lit(media).alias("content_type"), block.alias("block"))
    meta, text_id = urn(F.lit("metadata"), F.col("refers_to")), F.col("conversion_id")
    both = F.array(record("metadata", meta, text_id, "application/warc-fields", fields), record("conversion", text_id, meta, "text/plain; charset=utf-8", plain_text(F.col("p"))))
    out = base.select(*keys, "refers_to", "target_uri", "warc_date", "source_digest", F.col("h").alias("source_headers"), F.explode(both).alias("r"))
    return out.select(*keys, "r.warc_type", "r.record_id", "refers_to", "r.concurrent_to", "target_uri", "warc_date", "r.content_type", F.octet_length("r.block").cast("long").alias("content_length"), digest(F.col("r.block")).alias("block_digest"), "source_digest", "source_headers", "r.block")


def render(records: DataFrame) -> DataFrame:
    """``record``: the WARC form of each derived record, the source's digest and headers in it as extension fields."""
    named = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "block_digest"), ("Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n")) for name, c in named]
    source = F.when(F.col("source_headers") == "", "").otherwise(F.concat(F.lit("Source-HTTP: "), F.replace(F.col("source_headers"), F.lit("\r\n"), F.lit("\r\nSource-HTTP: ")), F.lit("\r\n")))
    return records.select(F.concat(F.lit(VERSION), *lines, source, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write derived records as WARC files, one for each partition."""
    render(records).select(F.expr("left(record, length(record) - 1)").alias("value")).write.option("lineSep", "\n").text(path)


BEGIN = re.compile(rb"WARC/1\.[01]\r?\n")
LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$")
#: Bytes of a line, and of a header, that a record may have; and bytes of blocks that are handed on at once.
LINE, HEADER, BATCH = 1 << 16, 1 << 20, 4 << 20


def parse_warc(file) -> Iterator[tuple[bytes, bytes | None, str | None]]:
    """(header, block, problem) of the records of an open file, read by their lengths.

    A block may hold anything, version lines too. What isn't a whole record has a
    problem and no block; reading goes on at the next version line after it.
    """
    held = b""  # read already

    def next_line() -> bytes:
        nonlocal held
        first, end, held = held.partition(b"\n")
        return first + end if end else first + file.readline(LINE)

    while line := next_line():
        if line in (b"\r\n", b"\n"):
            continue
        if not BEGIN.fullmatch(line):
            yield line[:200], None, "not the beginning of a record"
            while line and not BEGIN.fullmatch(line):
                line = next_line()
            held = line + held
            continue
        head = line
        while (line := next_line()) not in (b"\r\n", b"\n", b"") and len(head) < HEADER:
            head += line
        length = LENGTH.search(head)
        if not line or length is None or len(head) >= HEADER:
            yield head, None, "no Content-Length" if line else "header is cut off"
            continue
        size = int(length[1])
        block, held = held[:size], held[size:]
        block += file.read(size - len(block))
        if len(block) < size:
            yield head, None, "block shorter than its Content-Length"
            return
        end, held = held[:4], held[4:]
        end += file.read(4 - len(end))
        if end in (b"\r\n\r\n", b"\r\n", b""):
            yield head, block, None
        else:
            yield head, None, "block longer than its Content-Length"
            held = end + held


def _opened(path: str):
    """A file by Arrow's file systems, unzipped if it is gzip: as many members as it has, one after another."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    file = io.BufferedReader(system.open_input_stream(name, compression=None), 1 << 20)
    return io.BufferedReader(gzip.GzipFile(fileobj=file)) if file.peek(2)[:2] == b"\x1f\x8b" else file


@dataclass
class WarcFile(InputPartition):
    path: str


class WarcFiles(DataSource):
    """Records of WARC files, plain or gzip: a file or folder (option path), a task for each file, a record at a time in memory."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_warc"

    def schema(self) -> str:
        return "head string, block binary, problem string"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[WarcFile]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(name).is_file:
            return [WarcFile(self.path)]
        hidden = lambda f: any(part[0] in "._" for part in f.path.removeprefix(name).strip("/").split("/"))
        files = [f for f in system.get_file_info(fs.FileSelector(name, recursive=True)) if f.is_file and f.size and not hidden(f)]
        base = self.path.rstrip("/")
        return [WarcFile(base + f.path.removeprefix(name.rstrip("/"))) for f in files]

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        rows, size = [], 0
        with _opened(partition.path) as file:
            for row in parse_warc(file):
                rows.append(row)
                size += len(row[0]) + len(row[1] or b"")
                if size > BATCH:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[bytes, bytes | None, str | None]]) -> pa.RecordBatch:
        head, block, problem = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([h.decode("utf-8", "replace") for h in head], pa.string()), pa.array(block, pa.binary()), pa.array(problem, pa.string())], ["head", "block", "problem"])


def read_warc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of WARC/1.0 and 1.1 files, plain or gzip: header fields and the block as bytes.

    Blocks are as many bytes as their records say, whatever they hold. What isn't a
    whole record (a cut-off file, a wrong length) is never returned as one: it fails
    the read, or without ``strict`` comes with what is wrong in ``problem``, and
    reading goes on at the next version line.
    """
    spark.dataSource.register(WarcFiles)
    rows = spark.read.format(WarcFiles.name()).option("path", path).load()
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    names = (("warc_type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("refers_to", "WARC-Refers-To"), ("concurrent_to", "WARC-Concurrent-To"), ("target_uri", "WARC-Target-URI"), ("warc_date", "WARC-Date"), ("payload_digest", "WARC-Payload-Digest"), ("block_digest", "WARC-Block-Digest"), ("source_digest", "Source-Payload-Digest"))
    source = F.array_join(F.regexp_extract_all("head", F.lit(r"(?m)^Source-HTTP: ([^\r\n]*)"), 1), "\r\n")
    size = F.expr("try_cast(n as long)").alias("content_length")
    out = rows.withColumn("n", field("Content-Length")).select(*[field(n).alias(c) for c, n in names], size, source.alias("source_headers"), "block", "problem")
    if not strict:
        return out
    checked = F.when(F.col("problem").isNull(), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("WARC record "), F.coalesce("record_id", F.lit("?")), F.lit(": "), "problem")).cast("binary"))
    return out.withColumn("block", checked).drop("problem")


def decoded(block: bytes) -> tuple[str, bytes, str]:
    """(headers, body, text) of an HTTP message: chunks joined, gzip and deflate undone, the text by its charset."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = head.decode("utf-8", "replace")
    value = lambda name: (re.search(rf"(?im)^{name}:[ \t]*([^\r\n]*)", headers) or ("", ""))[1].strip().lower()
    if "chunked" in value("Transfer-Encoding"):
        parts, at = [], 0
        while True:
            end = body.index(b"\r\n", at)
            size = int(body[at:end].split(b";")[0], 16)
            if not size:
                break
            if end + 2 + size > len(body):
                raise ValueError("a chunk is cut off")
            parts.append(body[end + 2 : end + 2 + size])
            at = end + 4 + size
        body = b"".join(parts)
    for coding in reversed([c.strip() for c in value("Content-Encoding").split(",")]):
        if coding in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif coding == "deflate":
            body = zlib.decompress(body, -15 if body[:1] and body[0] & 15 != 8 else 15)
        elif coding not in ("", "identity"):
            raise ValueError(f"unknown content encoding {coding}")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", value("Content-Type"))
    try:
        text = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return headers, body, text


def responses_of_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, ready for ``derive``; one whose body can't be decoded has ``problem`` and an empty payload.

    The payload digest is the record's own; where it has none it is that of the
    decoded body.
    """
    found = read_warc(spark, path).where("lower(warc_type) = 'response'").select("record_id", "target_uri", "warc_date", "payload_digest", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, block in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                try:
                    headers, body, text = decoded(block)
                    out.append((headers, text, own or f"sha256:{sha256(body).hexdigest()}", None))
                except (ValueError, OSError, EOFError, zlib.error) as e:
                    out.append((block.partition(b"\r\n\r\n")[0].decode("utf-8", "replace"), "", own, str(e)))
            columns = [pa.array([r[j] for r in out], pa.string()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest", "problem"])

    return found.mapInArrow(scan, "record_id string, target_uri string, warc_date string, http_headers string, payload string, payload_digest string, problem string")


def derivatives(pages: DataFrame) -> DataFrame:
    """Derived records of a table of pages, with the page_id."""
    return derive(responses_of_pages(pages), ("page_id",))


def _sql_rules(expr: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    nl = lambda s: quote(s).replace("\n", "'||chr(10)||'")
    for pattern, new in TEXT_RULES:
        expr = f"regexp_replace({expr}, {quote(pattern)}, {nl(new)}, 'g')"
    number = f"CASE WHEN regexp_matches(x, '{DECIMAL}') THEN split_part(x, ';', 1)::INT WHEN regexp_matches(x, '{HEXADECIMAL}') THEN ('0x' || substr(split_part(x, ';', 1), 2))::INT END"
    piece = f"CASE WHEN ({number}) BETWEEN 32 AND 126 OR ({number}) BETWEEN 160 AND 55295 OR ({number}) BETWEEN 57344 AND 1114111 THEN chr({number}) || substr(x, strpos(x, ';') + 1) ELSE '&#' || x END"
    expr = f"(SELECT pieces[1] || array_to_string(list_transform(pieces[2:], lambda x: {piece}), '') FROM (SELECT string_split({expr}, '&#') AS pieces))"
    for name, char in ENTITIES:
        expr = f"replace({expr}, {quote(name)}, {quote(char)})"
    for pattern, new in SPACE_RULES:
        expr = f"regexp_replace({expr}, {quote(pattern)}, {nl(new)}, 'g')"
    return expr


_URN = "'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"
_CRLF = "chr(13) || chr(10)"
ORACLE = f"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS p, {_URN.format(h="md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, ''))")} AS refers_to FROM pages
), s AS (
  SELECT *, 'sha256:' || sha256(p) AS source_digest, {_URN.format(h="md5('conversion|' || refers_to)")} AS conversion_id, {_URN.format(h="md5('metadata|' || refers_to)")} AS metadata_id,
    regexp_replace(regexp_extract(p, '{TITLE}', 1), '\\s+', ' ', 'g') AS title FROM r
), u AS (
  SELECT page_id, 'metadata' AS warc_type, metadata_id AS record_id, conversion_id AS concurrent_to, p, refers_to, target_uri, 'application/warc-fields' AS content_type, source_digest,
    'conversion-record: ' || conversion_id || {_CRLF} || 'source-payload-digest: ' || source_digest || {_CRLF} || 'source-payload-bytes: ' || strlen(p) || {_CRLF} || 'title: ' || title || {_CRLF}
    || 'source-http: HTTP/1.1 200 OK' || {_CRLF} || 'source-http: Content-Type: text/html; charset=utf-8' || {_CRLF} || 'source-http: Content-Length: ' || strlen(p) || {_CRLF} AS block FROM s
  UNION ALL
  SELECT page_id, 'conversion', conversion_id, metadata_id, p, refers_to, target_uri, 'text/plain; charset=utf-8', source_digest, {_sql_rules("p")} FROM s
)
SELECT page_id, warc_type, record_id, refers_to, concurrent_to, 'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(p) AS source_headers, target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, block FROM u
"""
