"""WARC archives: a writer with revisit records and a splittable reader.

An archive is a sequence of gzip members, one record each, so a reader can
start at any member.  Files live in the cluster's shared folder and are
reached through pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, new_path, small_batches, written

REVISIT_BYTES = 1000
SPLIT_BYTES = 16 << 20
#: A writing task starts another file beyond this.
FILE_BYTES = 64 << 20
MAGIC = b"\x1f\x8b\x08"
#: So many bytes are decoded to tell a record's member from chance bytes.
PROBE = 1024
READ = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def planned(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to of each page; refers_to is null for responses.

    Digests of payloads of at least ``least`` bytes are grouped; the group's
    largest id is the response, the others refer to it.  Only digests and ids
    are shuffled for that, hot digests being broadcast.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    url = F.col(url_col) if url_col and url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first_id"))
    groups = written(large.where("n > 1"), "payloads")
    total = pages.count()
    key = F.when(F.octet_length("payload") >= least, F.col("digest"))
    out = attach(rows.withColumn("k", key), groups.withColumnRenamed("digest", "k"), "k", "n", total, F.col("page_id"))
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return out.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member.  A revisit keeps the HTTP head, whose Content-Length is the full payload's."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (b"" if refers_to is not None else payload)
    name = "null" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{digest}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or f'urn:page:{name}').split())}",
        f"X-Page-Id: {name}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>",
            f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + z.flush()


def write_archives(plan: DataFrame, path: str, date: str | None = None) -> DataFrame:
    """(file, bytes, records) of the archives written under ``path``.

    A task's files have names of their own, so a lost or doubled attempt
    leaves files that the returned rows do not name; readers go by the rows.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(path)
        where.create_dir(base, recursive=True)
        out, done, n, done_rows = None, 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done_rows.append((name, done, n))
                out = None

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                if out is None:
                    name, done, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member := record(*row, date))
                done, n = done + len(member), n + 1
                if done >= FILE_BYTES:
                    close()
        close()
        if done_rows:
            files, sizes, counts = zip(*done_rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["file", "bytes", "records"])

    cols = plan.select("page_id", "url", "payload", "digest", "refers_to")
    return written(cols.mapInArrow(write, "file string, bytes long, records long"), "archives")


def _members(where: fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the records whose member starts in [start, end).

    Chance occurrences of the magic bytes are told apart by decoding: a
    member counts when its first bytes inflate to a WARC version line.  After
    a record the next member is known to start where the last one ended.
    """
    with where.open_input_file(path) as f:
        size = f.size()
        f.seek(start)
        buffer, base = f.read(min(READ, size - start)), start  # buffer holds the file from base on

        def more() -> bool:
            nonlocal buffer
            got = f.read(READ)
            buffer += got
            return bool(got)

        at = start
        while at < end:
            i = buffer.find(MAGIC, at - base)
            while i < 0 and base + len(buffer) < end + len(MAGIC):
                kept = buffer[-2:]
                base, buffer = base + len(buffer) - len(kept), kept
                if not more():
                    return
                i = buffer.find(MAGIC)
            if i < 0 or base + i >= end:
                return
            at = base + i
            while len(buffer) - i < PROBE and more():
                pass
            try:
                head = zlib.decompressobj(31).decompress(buffer[i : i + PROBE], 16)
            except zlib.error:
                head = b""
            if not head.startswith(b"WARC/1."):
                at += 1
                continue
            z, parts, pos, sound = zlib.decompressobj(31), [], i, True
            try:
                while not z.eof:
                    if pos >= len(buffer) and not more():
                        raise EOFError(f"{path}: the record at {at} is cut off")
                    parts.append(z.decompress(buffer[pos : pos + READ]))
                    pos = min(pos + READ, len(buffer))
            except zlib.error:
                sound = False
            if not sound:
                at += 1
                continue
            yield at, b"".join(parts)
            at = base + pos - len(z.unused_data)
            buffer, base = buffer[at - base :], at


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and block of a decoded record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode().lower()] = value.strip().decode()
    return fields, rest[: int(fields["content-length"])]


RECORD = "file string, offset long, page_id long, record_type string, payload_bytes long, payload_digest string, stated_digest string, refers_to long, payload binary"


def read_archives(spark: SparkSession, files: DataFrame, path: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of archives; files has (file, bytes).

    Every file is cut into byte ranges, a row each, dealt over tasks.  The
    task of a range yields the records that start inside it and reads past
    its end to finish the last.  For a revisit, payload_bytes and
    payload_digest are those its head states, and payload is null.
    """
    ranges = files.select(
        "file", F.col("bytes").alias("size"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"),
    )
    n = max(1, ranges.count())
    ranges = ranges.repartition(min(n, 20_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(path)
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        rows, held = [], 0
        for batch in batches:
            for file, start, size in zip(*[batch.column(k).to_pylist() for k in ("file", "start", "size")], strict=True):
                for offset, data in _members(where, f"{base}/{file}", start, min(start + split_bytes, size)):
                    fields, block = parse(data)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = fields["warc-payload-digest"].removeprefix("sha1:")
                    length = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    revisit = fields["warc-type"] == "revisit"
                    page = fields["x-page-id"]
                    rows.append((
                        file, offset, None if page == "null" else int(page), fields["warc-type"],
                        length if revisit else len(payload), stated if revisit else hashlib.sha1(payload).hexdigest(), stated,
                        int(fields["x-refers-to-page-id"]) if revisit else None, payload if with_payload and not revisit else None,
                    ))
                    held += len(payload)
                    if len(rows) >= 1000 or held > 8 << 20:
                        yield out(rows)
                        rows, held = [], 0
        if rows:
            yield out(rows)

    return ranges.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, path: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write pages as archives, read them back, and return a row per record.

    Null html is an empty payload.  Rows repeated with the same id and payload
    of at least 1000 bytes are all responses, as none has a smaller id than
    the response; a null page_id is written as such and loses to any other.
    An empty table writes no file and reads no record.  Extra columns are
    not written.
    """
    spark = small_batches(pages).sparkSession
    path = path or new_path(spark, "warc")
    files = write_archives(planned(pages), path)
    back = read_archives(spark, files, path, split_bytes, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


__all__ = ["planned", "record", "write_archives", "read_archives", "round_trip", "parse"]
