"""WARC archives with segmented records: a writer, and a reader that puts segments together again.

A page becomes one ``response`` record (an HTTP message whose body is framed as ``Transfer-Encoding:
chunked``) or, if an equal body of at least ``LEAST_SHARED`` bytes belongs to a smaller page id, one
``revisit`` record without body, which names the record and target it stands for. A block over ``segment_bytes`` is cut into a first record and
``continuation`` records, which name the first by ``WARC-Segment-Origin-ID`` and are numbered by
``WARC-Segment-Number``; the last states ``WARC-Segment-Total-Length``.

The reader parses archives by their headers' lengths alone, groups continuation records by origin, orders
them by number, verifies that the numbers are gapless and the total length holds, and decodes the chunked
framing. A record that fails a check raises an error, so a damaged archive is never read as a shorter one. A record's
segments are joined in one pass, however many they are.

An archive is one gzip member, since Spark's writers close a stream once a file; readers that seek by record need them
written anew with a member each.

Defined results: null html is an empty body; a null url has the target ``urn:page:<id>``; null page ids come
after all others (they revisit, and are responses only among themselves); repeated page ids with equal bodies
are each responses if none is smaller; bodies of any length are segmented; an empty table gives no archives and an empty
result; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import bounded_batches, new_path, table

LEAST_SHARED = 100  # bytes: smaller bodies are never shared
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 4_000
DATE = "2024-01-01T00:00:00Z"  # archives of the same pages are the same bytes
VERSION = b"WARC/1.1"
STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def frame_chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def decode_chunked(framed: bytes) -> bytes:
    """The body of a chunked message; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter or longer than stated")
        out.append(framed[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _uri(*parts: object) -> str:
    h = hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def page_records(row: int, page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: dict | None, segment_bytes: int) -> Iterator[bytes]:
    """The WARC records of one page, in order. ``row`` tells repeated page ids apart; ``refers_to`` has the page_id, row
    and url of the page that a revisit stands for."""
    id = _uri(page_id, row)
    target_of = lambda url, page_id: " ".join((url or "").split()) or f"urn:page:{page_id}"
    common = [("WARC-Target-URI", target_of(url, page_id)), ("WARC-Date", DATE)]
    own = [("WARC-X-Page-Id", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        first = refers_to["page_id"]
        refers = [("WARC-Refers-To", _uri(first, refers_to["row"])), ("WARC-Refers-To-Target-URI", target_of(refers_to["url"], first)), ("WARC-Refers-To-Date", DATE), ("WARC-X-Refers-To-Page-Id", str(first)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", id), *common, *own, *refers, ("WARC-X-Payload-Length", str(len(body)))], b"")
        return
    block = STATUS + frame_chunked(body)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for k, part in enumerate(parts, 1):
        numbers = [("WARC-Segment-Number", str(k))] if len(parts) > 1 else []
        if k == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", id), *common, *own, *numbers], part)
        else:
            total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", _uri(page_id, row, k)), ("WARC-Segment-Origin-ID", id), *common, *numbers, *total], part)


def decide(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with row, body, digest and ``refers_to``: of the smallest page with an equal body
    its page_id, row and url."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", body.alias("body"), F.monotonically_increasing_id().alias("row")).withColumn("digest", F.sha2("body", 256))
    shared = own.where(F.octet_length("body") >= LEAST_SHARED)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row", "url"))).alias("first")
    shared = shared.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first"))
    return own.join(shared, "digest", "left").select("page_id", "url", "body", "digest", "row", other.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write all pages as ``.warc.gz`` archives under ``path`` through Spark's own writer.

    The text writer puts raw bytes and the line end that closes each record; nothing is kept on executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 64):
                out = []
                for r in b.slice(start, 64).to_pylist():
                    out += page_records(r["row"], r["page_id"], r["url"], r["body"], r["digest"], r["refers_to"], segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([x[:-2] for x in out], pa.binary())], names=["record"])

    records = decide(pages).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of one archive."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield headers, block
        at = end + 8 + length


SEGMENTS = "origin string, number int, total long, type string, page_id long, refers_to long, digest string, stated long, block binary"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``; whole gzip files, a bounded number of records each."""
    import zlib

    def inflate(data: bytes) -> bytes:
        out = []
        while data:  # members follow one another
            z = zlib.decompressobj(31)
            out.append(z.decompress(data) + z.flush())
            data = z.unused_data
        return b"".join(out)

    def whole(x: str | None) -> int | None:
        return int(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                size = 0
                for h, block in parse(inflate(content.as_py())):
                    origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    rows.append((origin, whole(h.get("warc-segment-number")), whole(h.get("warc-segment-total-length")), h["warc-type"], whole(h.get("warc-x-page-id")), whole(h.get("warc-x-refers-to-page-id")), digest, whole(h.get("warc-x-payload-length")), block))
                    size += len(block)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SEGMENTS)
    return files.select("content").mapInArrow(run, SEGMENTS)


def reassemble(segments: DataFrame) -> DataFrame:
    """One row per record: whole blocks pass, segmented ones are grouped by origin, ordered, verified and joined."""
    single = segments.where("number is null and type <> 'continuation'")
    cut = segments.where("number is not null or type = 'continuation'")
    heads = [F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c) for c in ("type", "page_id", "refers_to", "digest", "stated")]
    whole = F.expr("listagg(block) WITHIN GROUP (ORDER BY number)")
    joined = cut.groupBy("origin").agg(whole.alias("block"), F.sort_array(F.collect_list("number")).alias("numbers"), F.max("total").alias("total"), *heads)
    numbers = F.col("numbers") == F.sequence(F.lit(1), F.size("numbers"))
    sound = numbers & F.col("total").isNotNull() & (F.octet_length("block") == F.col("total")) & F.col("type").isNotNull()
    problem = F.raise_error(F.concat(F.lit("segments missing or of a wrong total length: "), F.col("origin")))
    joined = joined.withColumn("block", F.when(F.coalesce(sound, F.lit(False)), F.col("block")).otherwise(problem.cast("binary")))
    columns = ["origin", "type", "page_id", "refers_to", "digest", "stated", "block"]
    return single.select(columns).unionByName(joined.select(columns))


RECORDS = "page_id long, type string, refers_to long, digest string, body binary, stated long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record with its decoded body (none for revisits) and the digest it states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = []
            for kind, block, digest in zip(b.column(1).to_pylist(), b.column(4), b.column(3).to_pylist(), strict=True):
                if kind != "response":
                    bodies.append(None)
                    continue
                head, _, framed = block.as_py().partition(b"\r\n\r\n")
                body = decode_chunked(framed) if b"chunked" in head.lower() else framed
                if digest and hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError("a payload does not have its digest")
                bodies.append(body)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(bodies, pa.binary()), b.column(5)], names=["page_id", "type", "refers_to", "digest", "body", "stated"])

    whole = reassemble(read_segments(spark, path))
    return whole.select("page_id", "type", "refers_to", "digest", "block", "stated").mapInArrow(run, RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through written archives and back; one row per page."""
    bounded_batches(spark)
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    response = F.col("type") == "response"
    return read_archives(spark, path).select(
        "page_id",
        F.when(response, F.octet_length("body")).otherwise(F.col("stated")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("body", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )
