"""Web pages as WARC records in ZIP packages, and a reader that fetches records by byte range.

A package stores (does not compress) a gzip-per-record WARC member and an index of its records, as
web archive collections do. The reader parses the end record, the ZIP64 records where present and
the central directory, finds the stored members from their local headers, and reads single records
by range; nothing is extracted.

Payloads of at least `least_bytes` that are equal are written once: the record with the largest page
id is the response, the others are revisits that name it and carry its digest and length.

A task writes packages of about PACKAGE_BYTES one after another, so a package and its index are bounded
whatever a partition holds. A task that is tried again writes files of other names; only the rows of the
attempt that succeeded name their packages.

Edge cases: null html is an empty payload; null url leaves the target out; control characters in a
url are percent-encoded; pages with equal ids and payloads that are the largest are all responses;
rows that repeat are records of their own; equal payloads whose ids are all null are all responses; a
very long page is a record like others, and a task holds one batch of them; an empty table writes
nothing; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few, new_folder, open_fs, picked, settle

LEAST_BYTES = 1000
PACKAGE_BYTES = 64 << 20
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.jsonl"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, page_id, n: int, url: str | None, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    name = lambda x: f"<urn:page:{x}>" if x is not None else f"<urn:row:{n}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    body = http + payload
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda block: {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in block.split(b"\r\n")[1:])}
    warc = fields(head)
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, fields(http), payload


class StoredZip:
    """The directory of a ZIP package behind a file with seek and read."""

    def __init__(self, file, size: int):
        self.file, self.members = file, {}
        tail_at = max(0, size - (22 + 65535 + 20))
        tail = self.range(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        locator = end - 20
        if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
            far = struct.unpack_from("<Q", tail, locator + 8)[0]
            wide = self.range(far, 56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, at = struct.unpack_from("<QQQ", wide, 32)
        directory, p = self.range(at, length), 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", directory, p + 8)
            packed, full = struct.unpack_from("<II", directory, p + 20)
            n, extra, comment = struct.unpack_from("<HHH", directory, p + 28)
            local = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            more = directory[p + 46 + n : p + 46 + n + extra]
            full, packed, local = self._wide(more, full, packed, local)
            self.members[name] = (method, packed, full, local)
            p += 46 + n + extra + comment

    @staticmethod
    def _wide(more: bytes, *values: int) -> tuple[int, ...]:
        """Values of 0xFFFFFFFF come, in this order, from the ZIP64 extra field."""
        at = 0
        while at + 4 <= len(more):
            tag, n = struct.unpack_from("<HH", more, at)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", more, at + 4))
                return tuple(wide.pop(0) if v == 0xFFFFFFFF else v for v in values)
            at += 4 + n
        return values

    def range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the package ends early")
        return data

    def place(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin, and how many there are."""
        method, packed, _, local = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed")
        head = self.range(local, 30)
        n, extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + n + extra, packed

    def read(self, name: str, at: int = 0, size: int | None = None) -> bytes:
        start, full = self.place(name)
        return self.range(start + at, full - at if size is None else size)


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload or null, payload_bytes, payload_digest, record_type, refers_to)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    repeated = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_top"), F.count("*").alias("_n")).where("_n > 1").select(F.col("payload_digest").alias("_d"), "_top")
    joined = rows.join(few(settle(repeated)), (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") >= least_bytes), "left")
    revisit = F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_top")).alias("refers_to"),
    )


class PackageWriter:
    """Writes records to one package and indexes them."""

    def __init__(self, stream):
        self.stream, self.index, self.at = stream, [], 0
        self.package = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.package.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)

    def add(self, r: dict) -> None:
        data = record(r["record_type"], r["page_id"], len(self.index), r["url"], r["payload_digest"], r["payload_bytes"], r["refers_to"], r["payload"] or b"")
        packed = gzip.compress(data, 6, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps({"page": None if r["page_id"] is None else str(r["page_id"]), "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> int:
        """The number of records."""
        self.member.close()
        with self.package.open(zipfile.ZipInfo(INDEX_MEMBER), "w", force_zip64=True) as member:
            member.write("\n".join(self.index).encode())
        self.package.close()
        self.stream.close()
        return len(self.index)


def write_packages(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes the planned records to packages; (package, path, records), one row per package, settled."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, writer = TaskContext.get(), 0, None
        part, attempt = task.partitionId(), task.taskAttemptId()

        def done():
            return pa.RecordBatch.from_pydict({"package": [(part << 32) + n], "path": [folder.rstrip("/") + f"/{name}"], "records": [writer.close()]})

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for r in batch.slice(lo, 256).to_pylist():
                    if writer is None:
                        fs, base = open_fs(folder)
                        fs.create_dir(base, recursive=True)
                        name = f"pages-{part:06d}-{n:06d}.{attempt}.zip"
                        writer = PackageWriter(fs.open_output_stream(f"{base}/{name}"))
                    writer.add(r)
                    if writer.at >= package_bytes:
                        yield done()
                        n, writer = n + 1, None
        if writer is not None:
            yield done()

    return settle(plan_records(pages, least_bytes).mapInArrow(write, "package bigint, path string, records bigint"))


def read_packages(packages: DataFrame, kind: str = "bigint") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) from the packages."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = open_fs(path)
                with fs.open_input_file(name) as file:
                    package = StoredZip(file, fs.get_file_info(name).size)
                    start, _ = package.place(WARC_MEMBER)
                    lines = package.read(INDEX_MEMBER).decode().split("\n")
                    for lo in range(0, len(lines), 256):
                        yield pa.RecordBatch.from_pylist([_row(package, start, json.loads(x)) for x in lines[lo : lo + 256]], schema=schema)

    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
    tasks = packages.repartition(max(1, packages.count()), "package")
    out = tasks.mapInArrow(read, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def _row(package: StoredZip, start: int, entry: dict) -> dict:
    warc, http, payload = parse_record(gzip.decompress(package.range(start + entry["offset"], entry["length"])))
    page = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x and x.startswith("<urn:page:") else None
    revisit = warc["warc-type"] == "revisit"
    named = warc["warc-payload-digest"].removeprefix("sha1:")
    digest = named if revisit else hashlib.sha1(payload).hexdigest()
    if digest != named:
        raise ValueError(f"the payload of {warc['warc-record-id']} is damaged")
    return {
        "page_id": page(warc["warc-record-id"]), "url": warc.get("warc-target-uri"), "payload_bytes": int(http["content-length"]) if revisit else len(payload),
        "payload_digest": digest, "record_type": warc["warc-type"], "refers_to": page(warc.get("warc-refers-to")), "payload": None if revisit else payload,
    }


def archive_pages(pages: DataFrame, *, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the packages and reads every record back."""
    pages = picked(pages, page_id="page_id", url="url", html="html")
    packages = write_packages(pages, folder or new_folder(pages.sparkSession, "page-packages"), least_bytes)
    return read_packages(packages, pages.schema["page_id"].dataType.simpleString())
