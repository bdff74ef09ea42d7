"""Web archives: writing captures as WARC files and assembling them again.

Each capture is a transaction of three records: a request, a response (or a revisit, where an earlier page has
the same payload) and a metadata record, tied to the response by WARC-Concurrent-To. Spark's text writer puts
the records into gzipped files in the shared folder, so a lost executor's file is written anew and never half
there. Files hold at most FILE_BYTES of pages, a larger page alone more, since a task reads a file at once. Reading
parses each file record by record by Content-Length, measures payloads, and joins the records of a transaction
through their concurrent-to identifiers, in whichever direction these point. A revisit's payload is that of the
record its refers-to identifier names, found by a join; where there is no such response, nothing is known of it.

Defined cases: null html is the empty payload; a null page_id counts after all others and reads back as null;
control characters and blanks of a url are percent-encoded, a null url has no target; rows equal in page_id, url
and html are one capture; an empty table writes an empty archive and reads back no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwire.plans.skew import salted_join

END = "\r\n\r\n"
FILE_BYTES = 128 << 20
#: Pages up to this many bytes share files.
SMALL_PAGE = 256 << 10
RECORD = (
    "record_id string, record_type string, concurrent_to array<string>, refers_to string, target string, date string, "
    "payload_digest string, payload string, payload_bytes long, fields map<string,string>"
)


def _urn(kind: str, *parts: str) -> Column:
    """A record id fixed by the capture: a name-based identifier of its parts."""
    h = F.md5(F.concat_ws("\x00", F.lit(kind), *[F.coalesce(F.col(p).cast("string"), F.lit("\x01")) for p in parts]))
    pieces = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a 160-bit digest: 32 letters of 5 bits, read 20 bits at a time."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(sha1_hex, 1 + 5 * n, 5), 16, 10).cast("int") for n in range(8)]
    picked = [
        F.substring(F.lit(letters), F.shiftright(g, shift).bitwiseAND(31) + 1, F.lit(1))
        for g in groups for shift in (15, 10, 5, 0)
    ]
    return F.concat(*picked)


def _safe(url: str) -> Column:
    """A url that fits on one header line."""
    return F.transform(
        F.split(F.col(url), ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.hex(F.encode(c, "UTF-8")))).otherwise(c)
    )


def _record(headers: list[tuple[str, Column]], body: Column) -> Column:
    """One record without its final blank lines. Headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"))
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("", *lines), length, F.lit("\r\n"), body)


def with_records(pages: DataFrame, date: str) -> DataFrame:
    """One row per capture with ``records``: its three records in one string."""
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.when(F.col("url").rlike(r"[\x00-\x20\x7F]"), F.array_join(_safe("url"), "")).otherwise(F.col("url")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    known = named.select("page_id", "url", F.sha1(F.encode("html", "UTF-8")).alias("sha1"))
    order = F.struct(F.col("page_id").isNull().alias("late"), F.col("page_id"), F.coalesce("url", F.lit("")).alias("at"), F.col("url"))
    # one row per payload, sums kept per task before the shuffle; a payload of very many pages is a hot key of
    # the join, which adaptive execution splits
    first = known.groupBy("sha1").agg(F.min(order).alias("first")).select(
        F.col("sha1").alias("of"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")
    )
    roles = known.join(first, F.col("sha1") == F.col("of")).select(
        F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("sha1").alias("s"), "first_id", "first_url"
    ).distinct()
    own = named.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    same = F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("sha1") == F.col("s"))
    placed = own.join(roles, same).drop("p", "u", "s")

    # further pages under the smallest id with the same payload are responses too
    response = F.col("page_id").eqNullSafe(F.col("first_id"))
    digest = F.concat(F.lit("sha1:"), _base32(F.col("sha1")))
    ids = {kind: _urn(kind, "page_id", "url", "sha1") for kind in ("response", "request", "metadata")}
    target = ("WARC-Target-URI", F.col("url"))
    when = ("WARC-Date", F.lit(date))
    path = F.coalesce("url", F.lit("/"))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", ids["request"]), when, target,
         ("WARC-Concurrent-To", ids["response"]), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\n\r\n")),
    )
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    content = ("Content-Type", F.lit("application/http;msgtype=response"))
    whole = _record(
        [("WARC-Type", F.lit("response")), ("WARC-Record-ID", ids["response"]), when, target, ("WARC-Payload-Digest", digest), content],
        F.concat(head, F.col("html")),
    )
    first_record = _urn("response", "first_id", "first_url", "sha1")
    revisit = _record(
        [("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", ids["response"]), when, target, ("WARC-Payload-Digest", digest),
         ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
         ("WARC-Refers-To", first_record), ("WARC-Refers-To-Target-URI", F.col("first_url")), content],
        head,
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", ids["metadata"]), when, target,
         ("WARC-Concurrent-To", ids["response"]), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(
            F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"),
        ),
    )
    records = F.concat_ws(END, request, F.when(response, whole).otherwise(revisit), metadata)
    return placed.select("page_id", records.alias("records"))


def write(pages: DataFrame, path: str, *, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files of at most FILE_BYTES of pages, but for larger
    ones, which have a file each."""
    size = F.octet_length(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    largest = pages.agg(F.max(size)).first()[0] or 0
    records = with_records(pages, date)
    large = F.octet_length("records") > SMALL_PAGE + 4096

    def put(some: DataFrame, per_file: int) -> None:
        some.select("records").write.mode("append").option("lineSep", END).option("compression", "gzip").option(
            "maxRecordsPerFile", per_file
        ).text(path)

    put(records if largest <= SMALL_PAGE else records.filter(~large), FILE_BYTES // SMALL_PAGE)
    if largest > SMALL_PAGE:
        put(records.filter(large), 1)


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The plain bytes of any number of gzip members, a piece at a time."""
    unzip, at = zlib.decompressobj(31), 0
    pending = b""
    while pending or at < len(data):
        if not pending:
            pending, at = data[at : at + step], at + step
        out = unzip.decompress(pending, step)
        pending = unzip.unconsumed_tail
        if unzip.eof:
            pending, unzip = unzip.unused_data, zlib.decompressobj(31)
        if out:
            yield out


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of every record in a stream of plain bytes."""
    held, over = bytearray(), False
    end = END.encode()

    def fill(wanted: int) -> bool:
        nonlocal over
        while len(held) < wanted and not over:
            piece = next(pieces, None)
            over = piece is None
            held.extend(piece or b"")
        return len(held) >= wanted

    while fill(1):
        at = 0
        while (found := held.find(end, at)) < 0:
            at = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("a record has no end of headers")
        lines = held[:found].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts here: {lines[0][:40]!r}")
        headers = [(n.strip().lower(), v.strip()) for n, _, v in (line.partition(":") for line in lines[1:])]
        size = int(dict(headers)["content-length"])
        if not fill(found + 4 + size):
            raise ValueError("a record is cut short")
        block = bytes(held[found + 4 : found + 4 + size])
        fill(found + 8 + size)
        del held[: found + 8 + size]
        yield headers, block


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for batch in batches:
        for content in batch.column("content"):
            for headers, block in parse(_inflated(content.as_py())):
                one = dict(headers)
                kind = one.get("warc-type")
                payload, fields = None, None
                if kind in ("response", "request", "revisit"):
                    payload = block.partition(END.encode())[2]
                elif kind == "metadata":
                    fields = [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in block.decode().split("\r\n") if x)]
                digest = one.get("warc-payload-digest")
                if kind == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest is not None and digest.rpartition(":")[2].upper() != found:
                        raise ValueError(f"payload of {one.get('warc-record-id')} does not match its digest")
                    digest = f"sha1:{found}"
                rows.append({
                    "record_id": one.get("warc-record-id"), "record_type": kind,
                    "concurrent_to": [v for n, v in headers if n == "warc-concurrent-to"], "refers_to": one.get("warc-refers-to"),
                    "target": one.get("warc-target-uri"), "date": one.get("warc-date"), "payload_digest": digest,
                    "payload": None if payload is None else payload.decode("utf-8", "replace"),
                    "payload_bytes": None if payload is None else len(payload), "fields": fields,
                })
                size += len(block)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzipped WARC files below ``path``."""
    text, strings = pa.string(), pa.list_(pa.string())
    schema = pa.schema([
        ("record_id", text), ("record_type", text), ("concurrent_to", strings), ("refers_to", text), ("target", text), ("date", text),
        ("payload_digest", text), ("payload", text), ("payload_bytes", pa.int64()), ("fields", pa.map_(text, text)),
    ])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(lambda batches: _rows(batches, schema), RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata.

    A response or revisit opens a capture; requests and metadata belong to the one they are concurrent to, or that
    names them. Records that belong to no response are left out. Only the response keeps its payload.
    """
    once = records.dropDuplicates(["record_id"])
    answer = F.col("record_type").isin("response", "revisit")
    responses = once.filter(answer)
    others = once.filter(~answer).drop("payload")
    pairs = once.select("record_id", F.explode("concurrent_to").alias("other"))
    linked = pairs.select(F.col("record_id").alias("x"), F.col("other").alias("y")).unionByName(
        pairs.select(F.col("other").alias("x"), F.col("record_id").alias("y"))
    ).distinct()

    def of(kind: str) -> DataFrame:
        fields = [c for c in others.columns]
        members = others.filter(F.col("record_type") == kind).join(linked, F.col("record_id") == F.col("x"))
        return members.groupBy("y").agg(F.min_by(F.struct(*fields), F.col("record_id")).alias(kind)).withColumnRenamed("y", f"of_{kind}")

    request, metadata = of("request"), of("metadata")
    nested = responses.select(F.col("record_id").alias("capture_id"), F.struct(*responses.columns).alias("response"))
    joined = nested.join(request, F.col("capture_id") == F.col("of_request"), "left").join(
        metadata, F.col("capture_id") == F.col("of_metadata"), "left"
    )
    return joined.select("capture_id", "response", "request", "metadata")


def with_originals(read: DataFrame) -> DataFrame:
    """Add ``original`` to captures: of a revisit, the capture that its record refers to (capture_id, payload_bytes,
    payload_digest as measured, fields of its metadata), null where that is missing or no response itself."""
    revisit = F.col("response.record_type") == "revisit"
    known = read.filter("response.record_type = 'response'").select(
        F.col("capture_id").alias("_ref"),
        F.struct("capture_id", "response.payload_bytes", "response.payload_digest", "metadata.fields").alias("original"),
    )
    pairs = read.filter(revisit).withColumn("_ref", F.col("response.refers_to"))
    known = known.join(pairs.select("_ref").distinct(), "_ref", "left_semi")
    # one payload may have very many revisits, hence the salt; responses need no partner
    found = salted_join(pairs, known, ["_ref"], [F.col("capture_id")]).drop("_ref")
    others = read.filter(~revisit).withColumn("original", F.lit(None).cast(found.schema["original"].dataType))
    return found.unionByName(others)
