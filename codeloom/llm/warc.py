"""Web archives: writing of request, response, revisit and metadata records, reading, and assembly of captures.

A capture is a response (or revisit), the request that led to it and metadata about it; the latter two name the former
in WARC-Concurrent-To. Archives are written and read by Spark's own file sources, so any store that Spark reaches will
do: a record is a row of text, and the two line ends that close it are the row separator. Files are compressed, and
read record by record as they are decompressed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_rows, join_back, new_path, remove_path, stage_table

#: Payloads from this many bytes on are stored once.
SHARED_FROM = 100
#: Bytes of one archive file before compression, about.
FILE_BYTES = 64_000_000
#: Compressed archive files that a worker holds at a time, and bytes that are decompressed in one go.
FILES, PIECE = 1, 1 << 20
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"
_RECORD = "record_id string, type string, concurrent_to string, target_uri string, refers_to_id string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its closing line ends. Headers whose value is null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(_END, *lines), F.lit(_END * 2), block)


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, bytes, digest, first, first_url): the smallest page_id, then url, with the same payload of SHARED_FROM bytes or more."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    keys = stage_table(rows.where(F.col("bytes") >= SHARED_FROM).select("page_id", "url", "digest"), "digests").withColumn("key", F.xxhash64("digest"))
    total = keys.count()
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("least")
    first = keys.groupBy("key", "digest").agg(least, F.count("*").alias("c")).where("c > 1 and least is not null")
    first = first.select("key", "digest", "c", F.col("least.page_id").alias("first"), F.col("least.url").alias("first_url"))
    rows = rows.withColumn("key", F.when(F.col("bytes") >= SHARED_FROM, F.xxhash64("digest")))
    first = stage_table(first, "firsts")
    if first.count() <= 50_000:
        return rows.join(F.broadcast(first.select("key", "digest", "first", "first_url")), ["key", "digest"], "left").drop("key")
    return join_back(rows, first, ["key", "digest"], ["first", "first_url"], "c", max(1, total), F.struct("page_id", "url")).drop("key")


def records(pages: DataFrame) -> DataFrame:
    """Three rows ``value`` for each page: request, response or revisit, metadata."""
    rows = with_revisits(pages)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # rows that repeat a page_id with another payload or url have records of their own
    own = lambda kind: _uuid(F.lit(kind), F.col("page_id"), F.col("digest"), F.col("url"))
    rows = rows.withColumn("again", again).withColumn("id", own("response"))
    uri = F.regexp_replace("url", r"[\r\n]", "%0A")
    path = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(uri, F.lit("")), r"^[a-z]+://[^/]*(/[^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), r"^[a-z]+://([^/]*)", 1)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("bytes").cast("string"), F.lit(_END * 2))
    target, digest = ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    refers = ("WARC-Refers-To", F.when(F.col("again"), _uuid(F.lit("response"), F.col("first"), F.col("digest"), F.col("first_url"))))
    profile = ("WARC-Profile", F.when(F.col("again"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    answer = _record(F.when(F.col("again"), "revisit").otherwise("response"), F.col("id"), [target, kind, digest, profile, refers], F.concat(http, F.when(F.col("again"), F.lit("")).otherwise(F.col("html"))))
    near = ("WARC-Concurrent-To", F.col("id"))
    ask = F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{_END}Host: "), host, F.lit(_END * 2))
    request = _record("request", own("request"), [target, ("Content-Type", F.lit("application/http; msgtype=request")), near], ask)
    about = F.concat_ws(_END, F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.concat(F.lit("payloadBytes: "), F.col("bytes").cast("string")), F.when(F.col("again"), F.concat(F.lit("refersToPage: "), F.col("first").cast("string"))), F.lit(""))
    meta = _record("metadata", own("metadata"), [target, ("Content-Type", F.lit("application/warc-fields")), near], about)
    return rows.select(F.explode(F.array(request, answer, meta)).alias("value"))


def write_archives(pages: DataFrame, path: str) -> str:
    """Write ``pages`` (page_id, url, html) as gzip archives into the folder ``path``."""
    size, n = pages.agg(F.sum(F.octet_length("html")), F.count("*")).first()
    each = 3 * max(1, int(FILE_BYTES // (1000 + (size or 0) / max(1, n))))
    records(pages).write.option("lineSep", _END * 2).option("maxRecordsPerFile", str(each)).option("compression", "gzip").text(path)
    return path


def decompressed(data: bytes) -> Iterator[bytes]:
    """Pieces of about PIECE bytes of what one or more gzip members hold; a cut-off member gives what is there. Other data comes as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(data, PIECE)
            data = member.unconsumed_tail
            if piece:
                yield piece
            elif not data:
                break
        data = member.unused_data


def parse_archive(pieces: Iterable[bytes]) -> Iterator[tuple]:
    """Fields of _RECORD of each record; a truncated last record is given as far as it goes. Only the record at hand is held."""
    source, held, at = iter(pieces), bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(source, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while True:
        while (start := held.find(b"WARC/", at)) < 0:
            at = max(at, len(held) - 4)
            if not more():
                return
        at = start
        while (head_end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        head = {}
        for line in held[at:head_end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        at = head_end + 4
        length = int(head.get("content-length") or 0)
        while len(held) - at < length and more():
            pass
        block = bytes(held[at : at + length])
        at += len(block)
        kind, payload, fields = head.get("warc-type"), None, None
        if kind == "metadata":
            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if v]
        elif kind in ("request", "response", "revisit"):
            payload = block.partition(b"\r\n\r\n")[2]
        digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        if kind == "response":
            digest = hashlib.sha256(payload).hexdigest()
        yield head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-refers-to"), digest, None if payload is None else len(payload), fields, payload


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives in the folder ``path``. The digests of responses are worked out from their payloads.

    Run it under ``arrow_rows(spark, FILES)``: a row of the source is a whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [x.split()[0] for x in _RECORD.split(", ")]
        for b in batches:
            for data in b.column(0):
                rows: list[tuple] = []
                for r in parse_archive(decompressed(data.as_py())):
                    rows.append(r if with_payload else (*r[:-1], None))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, _RECORD)


def captures(found: DataFrame) -> DataFrame:
    """Records -> one nested row for each response or revisit: its request and metadata are those concurrent to it.

    Captures without a request or metadata have null there; of several, that with the smallest record id is taken.
    Requests and metadata that name no known response are left out.
    """
    base = ["record_id", "target_uri", "payload_digest", "payload_bytes"]
    main = found.where("type in ('response', 'revisit')")
    asks = found.where("type = 'request' and concurrent_to is not null").select(F.col("concurrent_to").alias("_q"), F.struct(*base, "payload").alias("request")).groupBy("_q").agg(F.min_by("request", "request.record_id").alias("request"))
    about = found.where("type = 'metadata' and concurrent_to is not null").select(F.col("concurrent_to").alias("_m"), F.struct("record_id", "fields").alias("metadata")).groupBy("_m").agg(F.min_by("metadata", "metadata.record_id").alias("metadata"))
    out = main.join(asks, F.col("record_id") == F.col("_q"), "left").join(about, F.col("record_id") == F.col("_m"), "left")
    return out.select(F.struct("type", *base, "refers_to_id", "payload").alias("response"), "request", "metadata")


def archive_report(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and report each capture.

    Null html is an empty payload; null urls have no target URI. Equal payloads of SHARED_FROM bytes or more are
    stored once, under the smallest page_id. Rows that repeat a page_id are captures of their own; all that have the
    smallest page_id of their payload are responses. Empty input: no rows. The archives are removed once they are read.
    """
    spark = pages.sparkSession
    path = write_archives(pages, new_path(spark, "warc"))
    with arrow_rows(spark, FILES):
        found = stage_table(read_archives(spark, path, with_payload=False), "records")
    remove_path(spark, path)
    rows = captures(found)
    field = lambda name: F.col("metadata.fields")[name].cast("long")
    return rows.select(
        field("pageId").alias("page_id"),
        F.when(F.col("response.type") == "revisit", field("payloadBytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        field("refersToPage").alias("refers_to"),
        F.col("response.target_uri").alias("url"),
    )
