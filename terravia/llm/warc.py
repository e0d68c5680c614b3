"""WARC archives: written as one gzip stream, normalised to a member a record with a sidecar index, read back.

1. ``write_monolithic`` writes the pages of a task as whole-file gzip archives (a new one is begun
   after ROLL bytes), as crawlers do that compress a finished file: no record can be reached
   without inflating all before it. Its rows say what each record holds.
2. ``revisits`` finds, by payload digest, the page each later equal payload refers to. Only
   (digest, page_id) rows are shuffled, never a payload; minima are taken before the shuffle, so
   one payload that a third of the pages share costs no task more than others.
3. ``normalise`` inflates each archive once, as a stream, writes every record as a gzip member of
   its own (equal payloads as revisit records) and beside the archive ``.idx``: offset, length, type,
   digest and page of each record.
4. ``read`` goes by the index: one seek, one member, one record.

Files are named anew by each attempt of a task, and only names in stored rows are read: an executor
that is lost leaves files that nobody reads. All are written in the folder of spark.checkpoint.dir.

Defined results: null html is an empty payload; a null url becomes urn:page:<id>; line breaks in a
url are percent-encoded. A null page_id is never referred to; it revisits an equal payload that has
an id. Rows that repeat both page_id and payload are all response. No pages, no rows. A payload of any length
is one record; further columns are not read. The normalised archives and their indexes stay, as they are the result; the
monolithic ones and the tables of the way there are deleted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROLL, READ, DATE = 64 << 20, 1 << 20, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "WARC-Page-ID"  # a header of our own; unknown ones are ignored by readers


def files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}",
        *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"
    ]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def http_block(n: int, payload: bytes = b"") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + payload


def target(page_id, url: str | None) -> str:
    return f"urn:page:{page_id}" if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def response(page_id, url: str | None, payload: bytes, digest: str) -> bytes:
    return record(
        "response",
        [
            ("WARC-Target-URI", target(page_id, url)), (PAGE, json.dumps(page_id)),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")
        ],
        http_block(len(payload), payload)
    )


def revisit(headers: dict[str, str], n: int, refers_to: int) -> bytes:
    return record(
        "revisit",
        [
            ("WARC-Target-URI", headers["WARC-Target-URI"]), (PAGE, headers[PAGE]), ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Payload-Digest", headers["WARC-Payload-Digest"]),
            ("Content-Type", "application/http; msgtype=response")
        ],
        http_block(n)
    )


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Records of an uncompressed stream; holds one record and one chunk."""
    held = bytearray()
    size = -1
    for chunk in chunks:
        held += chunk
        while True:
            if size < 0:
                head = held.find(b"\r\n\r\n")
                if head < 0:
                    break
                length = next(x for x in bytes(held[:head]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                size = head + 4 + int(length.split(b":")[1]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
            size = -1
    if held:
        raise ValueError(f"the archive ends within a record: {len(held)} bytes are left")


def inflated(source) -> Iterator[bytes]:
    """The content of a gzip file, of one or more members, in chunks."""
    gz, rest = zlib.decompressobj(31), b""
    while chunk := rest or source.read(READ):
        yield gz.decompress(chunk, 4 * READ)
        while gz.unconsumed_tail:
            yield gz.decompress(gz.unconsumed_tail, 4 * READ)
        rest = gz.unused_data
        if gz.eof:
            gz = zlib.decompressobj(31)


def member(raw: bytes, level: int) -> bytes:
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


WRITTEN = "archive string, seq long, page_id long, payload_bytes long, digest string"
INDEXED = "archive string, page_id long, offset long, length long"
READ_BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def _arrow(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in ddl.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, {"long": pa.int64(), "string": pa.string()}[k]) for c, (_, k) in zip(cols, fields, strict=True)],
        [n for n, _ in fields]
    )


def _write(folder: str, level: int):
    def run(batches):
        fs, root = files(folder)
        out = gz = None
        archive, size, seq, rows = "", 0, 0, []

        def close():
            if out is not None:
                out.write(gz.flush())
                out.close()

        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or size >= ROLL:
                    close()
                    archive, size, seq = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs.create_dir(root, recursive=True)
                    out, gz = fs.open_output_stream(posixpath.join(root, archive), compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                payload = (html or "").encode()
                digest = base32_sha1(payload)
                raw = response(page_id, url, payload, digest)
                out.write(gz.compress(raw))
                size += len(raw)
                rows.append((archive, seq, page_id, len(payload), digest))
                seq += 1
            yield _arrow(rows, WRITTEN)
            rows = []
        close()

    return run


def write_monolithic(pages: DataFrame, folder: str, level: int = 3) -> DataFrame:
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(_write(folder, level), WRITTEN)


def revisits(written: DataFrame, min_bytes: int = 0) -> DataFrame:
    """archive and its revisit records as (seq, refers_to); archives without any are kept."""
    first = written.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1 and first is not null")
    again = written.join(first, ["digest", "payload_bytes"], "left").withColumn(
        "again", F.col("first").isNotNull() & ~F.coalesce(F.col("first") == F.col("page_id"), F.lit(False))
    )
    return again.groupBy("archive").agg(F.collect_list(F.when(F.col("again"), F.struct("seq", "first"))).alias("again"))


def _normalise(source: str, folder: str, level: int):
    def run(batches):
        fs, root = files(source)
        to, to_root = files(folder)
        to.create_dir(to_root, recursive=True)
        for batch in batches:
            for archive, again in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                refers = {x["seq"]: x["first"] for x in again or ()}
                name, offset, rows, lines = f"{uuid.uuid4().hex}.warc.gz", 0, [], []
                with fs.open_input_stream(
                    posixpath.join(root, archive), compression=None
                ) as f, to.open_output_stream(posixpath.join(to_root, name), compression=None) as out:
                    for seq, raw in enumerate(records(inflated(f))):
                        headers, block = parsed(raw)
                        if seq in refers:
                            raw = revisit(headers, len(block.partition(b"\r\n\r\n")[2]), refers[seq])
                        data = member(raw, level)
                        out.write(data)
                        lines.append(
                            f"{offset} {len(data)} {'revisit' if seq in refers else 'response'} {headers['WARC-Payload-Digest']} {headers[PAGE]}\n"
                        )
                        rows.append((name, json.loads(headers[PAGE]), offset, len(data)))
                        offset += len(data)
                with to.open_output_stream(posixpath.join(to_root, name + ".idx")) as out:
                    out.write("".join(lines).encode())
                yield _arrow(rows, INDEXED)

    return run


def normalise(archives: DataFrame, source: str, folder: str, level: int = 6) -> DataFrame:
    """archives: archive, again. The index of the normalised archives in folder."""
    return archives.select("archive", "again").mapInArrow(_normalise(source, folder, level), INDEXED)


def _read(folder: str):
    def run(batches):
        fs, root = files(folder)
        name = f = None
        for batch in batches:
            rows = []
            for archive, _, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    if f is not None:
                        f.close()
                    name, f = archive, fs.open_input_file(posixpath.join(root, archive))
                headers, block = parsed(zlib.decompress(f.read_at(length, offset), 31))
                head, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response":
                    n, refers_to = len(payload), None
                    if base32_sha1(payload) != digest:
                        raise ValueError(f"{archive}, offset {offset}: the payload doesn't match its digest")
                else:
                    n = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length:")).split(b":")[1])
                    refers_to = int(headers["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">"))
                rows.append((json.loads(headers[PAGE]), n, digest, kind, refers_to, archive, offset, length))
            yield _arrow(rows, READ_BACK)
        if f is not None:
            f.close()

    return run


def read(index: DataFrame, folder: str) -> DataFrame:
    return index.select("archive", "page_id", "offset", "length").mapInArrow(_read(folder), READ_BACK)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    spark = pages.sparkSession
    raw, final = common.fresh_path(spark, "warc-raw"), common.fresh_path(spark, "warc")
    written = common.stored(write_monolithic(pages, raw), "warc-written")
    plan = common.stored(revisits(written, min_bytes), "warc-plan")
    tasks = max(1, min(plan.count(), 100_000))
    index = common.stored(normalise(plan.repartition(tasks), raw, final), "warc-index")
    common.dropped(written)
    common.dropped(plan)
    common.removed(spark, raw)
    return read(index, final)


def op8(spark, sf_dir: str) -> DataFrame:
    records = archive_pages(common.table(spark, sf_dir, "pages"), 0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LETTERS = " || ".join(f"substr('{_BASE32}', CAST((v[{i}] >> {bits}) & 31 AS INTEGER) + 1, 1)" for i in range(1, 9) for bits in (15, 10, 5, 0))
#: The rows of op8: a digest's 160 bits are eight numbers of 20, each four letters.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first,
    list_transform(range(8), lambda i: CAST('0x' || substr(digest, CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT)) AS v
  FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
