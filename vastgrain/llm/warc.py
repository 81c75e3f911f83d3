"""WARC archives: write captures, read them back, and assemble transactions.

A capture is three records: the request, the response (or a revisit that refers to an earlier response with
the same payload), and a metadata record; request and metadata name the response in ``WARC-Concurrent-To``.
Reading joins the three through those identifiers and gives one nested row a capture.

Files are written with Spark's text writer and read with its binary reader, so they can be in any store Spark
reaches. A record ends with two line breaks, which is the writer's line separator, so the files are
WARC/1.1 byte for byte, plain or as one gzip member. A file holds captures of at most ``FILE_BYTES`` of payload, or one
capture that is larger; the reader holds one file at a time.

Every row is a capture of its own, known by a row key that is stored before anything is written. Of rows with equal
payloads one is the response, and revisits of it need no payload, so payloads cross the network only where a filter of
checked size says that they may repeat.

Cases: a null payload is empty; repeated rows are captures of their own, one of them the response and the others revisits
of it; a null id is smaller than any other and comes back as null; a null url becomes ``about:blank``; other columns are
ignored; records without a partner still give a row, with null for what is missing; an empty table makes an empty archive.
Payloads may hold anything, also text that looks like a record. A payload is one value of a column, so it has less than 2 GiB.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, forget, keyed_table, map_batches, materialize, maybe_among

BREAK = "\r\n"
VERSION = "WARC/1.1"
RECORDS_PER_FILE = 3000
#: Bytes of payload a file may hold, and the payload sizes that part pages into classes of their own files.
FILE_BYTES = 64 << 20
SIZE_CLASSES = (64 << 10, 4 << 20)


def _uri(kind: str, key: Column) -> Column:
    """A record id from its capture's key: stable, so a task that runs again writes the same."""
    return F.regexp_replace(F.md5(F.concat(F.lit(kind + ":"), key)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the two line breaks at its end. A null header is left out."""
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))).otherwise("") for name, value in headers]
    return F.concat(F.lit(VERSION + BREAK), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK * 2), block)


def base32_sha1(hex_digest: Column) -> Column:
    """RFC 4648 base32 (upper case) of a SHA-1 given in hexadecimal digits: 40 bits are eight digits of base 32."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def choose_responses(captures: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The response of each payload of at least ``min_bytes`` that several rows have, written: ``payload_sha1, payload_bytes, keeper``.

    ``captures`` has :data:`ROW`, ``capture_id, payload_sha1 (hex), payload_bytes``. The largest capture_id stays, of equal ones the
    largest row. Groups are reduced before the exchange.
    """
    same = captures.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_sha1", "payload_bytes").agg(F.max(F.struct("capture_id", ROW)).alias("best"), F.count(F.lit(1)).alias("n"))
    return materialize(same.filter("n > 1").select("payload_sha1", "payload_bytes", F.col(f"best.{ROW}").alias("keeper")), "keepers")


def split_roles(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(responses, revisits) of ``pages``, a table with :data:`ROW`, ``payload_sha1, payload_bytes`` and more; ``revisits`` has no ``payload`` but ``keeper``."""
    keepers = choose_responses(pages.select(ROW, "capture_id", "payload_sha1", "payload_bytes"), min_bytes)
    # A payload that many rows share is a hot key of this join; both sides are plain tables, so it is split.
    again = pages.drop("payload").join(keepers, ["payload_sha1", "payload_bytes"]).filter(F.col("keeper") != F.col(ROW))
    again = materialize(again, "revisits")
    mark = F.xxhash64("payload_sha1", "payload_bytes")
    maybe = maybe_among(keepers.select(mark.alias("mark")), "mark", keepers.count())
    gone = again.select(ROW)
    if maybe is None:
        return pages.join(gone, ROW, "left_anti"), again
    repeated = maybe(F.array(mark))
    return pages.filter(~repeated).unionByName(pages.filter(repeated).join(gone, ROW, "left_anti")), again


def _capture_records(captures: DataFrame, salt: str, date: str) -> DataFrame:
    """The records of captures, one a row (``value``): revisits where there is a ``keeper``."""
    revisit = "keeper" in captures.columns
    key = lambda row: F.concat(F.lit(salt + "/"), F.col(row).cast("string"))
    own, at, name = _uri("response", key(ROW)), F.lit(date), F.coalesce(F.col("capture_id").cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + BREAK + "Content-Type: text/html; charset=utf-8" + BREAK + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK * 2))
    response = _record(
        [
            ("WARC-Type", F.lit("revisit" if revisit else "response")), ("WARC-Record-ID", own), ("WARC-Date", at), ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload_sha1")))),
            *([("WARC-Refers-To", _uri("response", key("keeper"))), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))] if revisit else []),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        http if revisit else F.concat(http, F.col("payload")),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uri("request", key(ROW))), ("WARC-Date", at), ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + BREAK * 2)),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uri("metadata", key(ROW))), ("WARC-Date", at), ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("capture-id: "), name, F.lit(BREAK)),
    )
    return captures.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> None:
    """Write an archive of request, response or revisit, and metadata records of every page.

    Payloads under ``min_bytes`` are all responses. Folders of ``path`` hold responses by the size of their payloads, and revisits.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).alias("capture_id"), F.coalesce(F.regexp_replace(F.col(url_col), "[\\x00-\\x20]", ""), F.lit("about:blank")).alias("url"), payload.alias("payload"))
    keyed = keyed_table(base.withColumn("payload_sha1", F.sha1(F.col("payload").cast("binary"))).withColumn("payload_bytes", F.octet_length("payload").cast("long")))
    responses, revisits = split_roles(keyed, min_bytes)
    salt = uuid.uuid4().hex  # known before tasks begin, so one that runs again writes the same

    def write(captures: DataFrame, name: str, records: int) -> None:
        writer = _capture_records(captures, salt, date).write.option("lineSep", BREAK * 2).option("compression", compression)
        writer.option("maxRecordsPerFile", max(3, min(records_per_file, records) // 3 * 3)).text(f"{path}/{name}")

    edges = [0, *SIZE_CLASSES, 1 << 31]
    size_class = F.lit(0)
    for k, edge in enumerate(SIZE_CLASSES):
        size_class = F.when(F.col("payload_bytes") >= edge, k + 1).otherwise(size_class)
    held = {r[0] for r in keyed.select(size_class.alias("k")).distinct().collect()}  # of three
    for k in sorted(held):
        within = (F.col("payload_bytes") >= edges[k]) & (F.col("payload_bytes") < edges[k + 1])
        write(responses.filter(within), f"responses-{k}", 3 * (FILE_BYTES // edges[k + 1]))
    write(revisits, "revisits", RECORDS_PER_FILE)
    forget(keyed)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names; the last of a repeated name, but ``warc-concurrent-to`` joined by spaces) and block of each record.

    A gzip file, also one of many members, is unpacked first. What isn't a record is passed over to the next version line.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        lines = re.sub(rb"\r\n[ \t]+", b" ", data[at:stop]).split(b"\r\n")
        headers: dict[str, str] = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            key, text = name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()
            headers[key] = f"{headers[key]} {text}" if key == "warc-concurrent-to" and key in headers else text
        length = headers.get("content-length", "")
        if not length.isdigit():
            at += 5
            continue
        begin = stop + 4
        yield headers, data[begin : begin + int(length)]
        at = begin + int(length)


def _http(block: bytes) -> tuple[str, bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return head.decode("utf-8", "replace"), body


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row a record: ``record_id, type, target_uri, date, concurrent_to, refers_to, declared_digest, payload_digest, payload_bytes, http_head, fields, payload``.

    ``payload_digest`` and ``payload_bytes`` are of the payload as read (null for a revisit, whose payload is elsewhere);
    ``fields`` is the block of a metadata record. ``payload`` is null unless ``with_payload``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") > 0).select("content")
    names = ["record_id", "type", "target_uri", "date", "concurrent_to", "refers_to", "declared_digest", "payload_digest", "payload_bytes", "http_head", "fields", "payload"]
    kinds = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.string(), pa.binary()]

    def make():
        def rows(content: bytes) -> Iterator[tuple]:
            for h, block in parse(content):
                kind = h.get("warc-type", "")
                payload, head, fields, digest = None, None, None, None
                if kind in ("response", "request", "revisit"):
                    head, payload = _http(block)
                elif kind == "metadata":
                    fields = block.decode("utf-8", "replace")
                else:
                    payload = block
                if kind == "revisit":
                    payload = None
                if payload is not None:
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                declared = h.get("warc-payload-digest", "").rpartition(":")[2] or None
                yield (
                    h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), declared, digest,
                    None if payload is None else len(payload), head, fields, payload if with_payload else None,
                )

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for content in batch.column(0):
                held: list[tuple] = []
                for row in rows(content.as_py()):
                    held.append(row)
                    if len(held) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

        return step

    schema = "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, declared_digest string, payload_digest string, payload_bytes long, http_head string, fields string, payload binary"
    return map_batches(files, make, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: ``capture`` (the response's or revisit's record id), ``response``, ``request``, ``metadata``.

    Records meet by ``concurrent_to`` (the first identifier of several). Should two of a kind name one capture, the one
    with the smallest record id is taken, so no group is ever gathered; ``n_records`` tells how many there were.
    """
    main = F.col("type").isin("response", "revisit")
    key = F.when(main, F.col("record_id")).otherwise(F.coalesce(F.split(F.col("concurrent_to"), " ")[0], F.col("record_id")))
    slim = F.struct("record_id", "type", "target_uri", "date", "refers_to", "declared_digest", "payload_digest", "payload_bytes", "http_head", "fields", "payload")
    keyed = records.select(key.alias("capture"), F.col("type"), F.col("record_id"), slim.alias("record"), main.alias("main"))
    pick = lambda cond: F.min_by(F.when(cond, F.col("record")), F.when(cond, F.col("record_id")))
    return keyed.groupBy("capture").agg(pick(F.col("main")).alias("response"), pick(F.col("type") == "request").alias("request"), pick(F.col("type") == "metadata").alias("metadata"), F.count(F.lit(1)).alias("n_records"))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Add ``payload_bytes`` and ``payload_digest`` of the full payload, and ``refers_capture`` (its metadata fields), for revisits too.

    Revisits look up the response they refer to by record id; a response many revisits refer to is a skewed join key,
    which adaptive execution splits. Payload bodies take no part.
    """
    side = captures.select(
        "capture", F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("refers_to"), F.col("response.declared_digest").alias("declared_digest"),
        F.col("response.payload_digest").alias("digest"), F.col("response.payload_bytes").alias("bytes"), F.col("metadata.fields").alias("fields"), F.col("response.target_uri").alias("target_uri"),
    )
    side = materialize(side, "captures")  # read once, and plain, so that the join can be split
    kept = side.filter("record_type = 'response'").select(F.col("capture").alias("refers_to"), F.col("digest").alias("r_digest"), F.col("bytes").alias("r_bytes"), F.col("fields").alias("r_fields"))
    joined = side.join(kept, "refers_to", "left")
    return joined.select(
        "capture", "record_type", "target_uri", "fields", "refers_to", F.col("r_fields").alias("refers_fields"),
        F.coalesce("digest", "r_digest").alias("payload_digest"), F.coalesce("bytes", "r_bytes").alias("payload_bytes"), "declared_digest",
    )


def field(block: Column, name: str) -> Column:
    """A value out of a warc-fields block."""
    return F.regexp_extract(block, f"(?:^|\\n){re.escape(name)}: ([^\\r\\n]*)", 1)

