"""WARC archives: one gzip member per record, written and read by Spark tasks.

`write_archives` gives a table of the files written; `read_archives` reads them one after the
other per task, member by member. A file that a lost or repeated task has left is in no table and
is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resamplia.llm.shared import new_folder, stored

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

FILE_BYTES = 256 << 20
CHUNK = 1 << 16
MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload string, digest_ok boolean"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE}
    head |= fields | {"Content-Length": str(len(block))}
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _record(page_id: int | None, url: str | None, html: str | None, first: int | None, revisit: bool) -> bytes:
    payload = (html or "").encode()
    answer = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    fields = {"WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http;msgtype=response"}
    if page_id is not None:
        fields["X-Page-ID"] = str(page_id)
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="")  # any text, line ends included
    if not revisit:
        return _member("response", fields, answer + payload)
    fields |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": str(first)}
    return _member("revisit", fields, answer)


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        out, path, records, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict(
                {"path": [path], "records": [records], "bytes": [size]},
                pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
            )

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "first", "revisit")]
            for i in range(batch.num_rows):
                if out is None:
                    system.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, records = f"{folder}/{name}", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    info = _member("warcinfo", {"Content-Type": "application/warc-fields"}, b"format: WARC/1.1\r\n")
                    size = out.write(info)
                size += out.write(_record(*(c[i].as_py() for c in columns)))
                records += 1
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row of `pages` (page_id, url, html; other columns are ignored).

    Among rows of equal payload those with the smallest page_id are written in full, the others
    as revisits that name it. Null html is an empty payload; a null page_id never is the
    smallest unless all are null, and then every row is written in full. Files are closed at
    `file_bytes` of compressed records; each row of the result is one file.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_key", F.sha2("html", 256))
    again = rows.groupBy("_key").agg(F.count("*").alias("_n"), F.min("page_id").alias("first")).filter("_n > 1").drop("_n")
    marked = rows.join(again, "_key", "left").drop("_key")
    marked = marked.withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    return stored(marked.mapInArrow(_writer(folder, file_bytes), MANIFEST))


class _Members:
    """Records of one archive, decompressed piece by piece."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""

    def __iter__(self) -> Iterator[bytes]:
        while True:
            member, plain, begun = zlib.decompressobj(31), bytearray(), False
            while not member.eof:
                chunk = self.rest or self.stream.read(CHUNK)
                if not chunk:
                    if begun:
                        raise ValueError("an archive ends within a record")
                    return
                begun = True
                plain += member.decompress(chunk)
                self.rest = member.unused_data
            yield bytes(plain)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; the block has the stated length."""
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(VERSION.rstrip()):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is not the stated one")
    return fields, rest[:length]


def _reader(with_payload: bool, verify: bool):
    kinds = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
         ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string()), ("digest_ok", pa.bool_())]
    )

    def row(fields: dict[str, str], block: bytes) -> list:
        head, _, payload = block.partition(b"\r\n\r\n")
        answer = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        page, other = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
        full = fields["WARC-Type"] == "response"
        url = fields.get("WARC-Target-URI")
        own = digest(payload) if full else stated
        size = int(answer["Content-Length"])
        if verify and (own != stated or full and size != len(payload)):
            raise ValueError(f"the payload of page {page} has not the stated digest or length")
        return [
            int(page) if page else None, unquote(url) if url is not None else None, fields["WARC-Type"],
            int(other) if other else None, len(payload) if full else size, own,
            payload.decode(errors="strict" if verify else "replace") if full and with_payload else None, own == stated if full else None,
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                rows, size, found = [], 0, 0
                with system.open_input_stream(name, compression=None) as stream:
                    for record in _Members(stream):
                        fields, block = parse(record)
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        rows.append(row(fields, block))
                        found += 1
                        size += len(block)
                        if len(rows) >= 5000 or size > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), kinds)], schema=kinds)
                            rows, size = [], 0
                if expected is not None and found != expected:
                    raise ValueError(f"{path} has {found} records, {expected} were written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), kinds)], schema=kinds)

    return run


def read_archives(files: DataFrame, with_payload: bool = True, verify: bool = True) -> DataFrame:
    """The response and revisit records of the archives named in the column `path`.

    payload_digest is computed from the payload that was read; of a revisit, which has none, it is the stated one. A payload of another
    digest or length than stated is an error, and so are a broken or unfinished member, a wrong length of a record, and, where
    `files` has a column `records`, another number of them. With verify=False digest_ok tells instead whether the digest is the
    stated one (null for revisits). payload is null for revisits.
    """
    records = F.col("records").cast("long") if "records" in files.columns else F.lit(None).cast("long")
    files = files.select("path", records.alias("records"))
    count = files.count()
    return files.repartition(max(1, min(count, 100_000))).mapInArrow(_reader(with_payload, verify), RECORDS)


def revisits_ok(read: DataFrame) -> DataFrame:
    """`read`, an error where a revisit states another digest or length than the record it refers to has. Joined on page ids: no payload moves."""
    own = read.filter("record_type = 'response'").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
    # A page that was written several times has several full records; one of them is meant.
    own = own.groupBy("_page").agg(F.collect_set(F.struct("_digest", "_bytes")).alias("_own"))
    met = read.join(own, read["refers_to"] == own["_page"], "left")
    right = F.array_contains("_own", F.struct(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")))
    wrong = F.raise_error(F.concat(F.lit("a revisit does not fit the record of page "), F.col("refers_to").cast("string")))
    checked = F.when(F.col("refers_to").isNull() | F.coalesce(right, F.lit(False)), F.col("payload_digest")).otherwise(wrong)
    return met.withColumn("payload_digest", checked).select(read.columns)
