"""WARC archives as a Spark data source, in Python.

Writing: each task writes files of its own names; the commit of the job lists them in a manifest, so
files of failed or repeated attempts are never read. A record is one gzip member, and an extra field
of it has the member's length.

Reading: files are planned into partitions of about equal size. Predicates on the record type and on
the headers are pushed into the scan. A record's headers are parsed first; the payload of a record that
isn't wanted, or whose payload isn't asked for, is skipped without being decoded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .session import bounded_batches, work_path, written

#: An archive file is closed once it has so many bytes; files are read in partitions of about as many.
FILE_BYTES = 64 << 20
#: Bytes of one request of a reader, of a piece that is unpacked at once, and of unpacked data in which headers are looked for.
READ_BYTES, PIECE, HEAD = 256 << 10, 64 << 10, 4 << 10
#: Bytes of payloads in one batch that is handed to Spark.
BATCH_BYTES = 8 << 20
HEADERS = "record_type string, record_id string, refers_to string, target_uri string, date string, payload_digest string, payload_length long"
MANIFEST = "_manifest.json"
#: Header names of the format, and one of our own for the length of a payload that a revisit leaves out.
NAMES = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "refers_to": "WARC-Refers-To",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "file:///" + path[len("file:") :].lstrip("/")
    elif "://" not in path:
        path = f"file://{path}"
    return arrow_fs.FileSystem.from_uri(path)


# records


def record(kind: str, record_id: str | None, target: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record, uncompressed. Line ends in a header's value are percent-encoded; empty values are left out."""
    clean = lambda x: x.replace("\r", "%0D").replace("\n", "%0A")
    body = b"" if kind == "revisit" else HTTP + payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{clean(record_id)}>" if record_id else None),
        ("WARC-Date", date),
        ("WARC-Target-URI", clean(target) if target else None),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()),
        ("WARC-Refers-To", f"<{clean(refers_to)}>" if refers_to else None),
        ("WARC-Profile", IDENTICAL if kind == "revisit" else None),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field `sl` has its own length and that of the data."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    size = 24 + len(packed) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def headers_of(head: bytes) -> dict[str, str]:
    """Names in lower case; a line that begins with a blank continues the one before."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def row_of(headers: dict[str, str]) -> dict[str, object]:
    get = lambda k: headers.get(NAMES[k].lower())
    bare = lambda x: x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x
    digest, length = get("payload_digest"), get("payload_length")
    return {
        "record_type": get("record_type"),
        "record_id": bare(get("record_id")),
        "refers_to": bare(get("refers_to")),
        "target_uri": bare(get("target_uri")),
        "date": get("date"),
        "payload_digest": digest[5:] if digest and digest[:5].lower() == "sha1:" else digest,
        "payload_length": int(length) if length and length.isdigit() else None,
    }


def payload_of(headers: dict[str, str], body: bytes) -> bytes:
    """The body, without the head of an HTTP message if it is one."""
    if headers.get("content-type", "").startswith("application/http"):
        end = body.find(b"\r\n\r\n")
        return body[end + 4 :] if end >= 0 else body
    return body


class Tape:
    """A file read forward through one buffer: records that lie in it cost no request, and what is skipped beyond it isn't read."""

    def __init__(self, file, size: int, block: int = READ_BYTES):
        self.file, self.size, self.block, self.begin, self.data = file, size, block, 0, b""

    def take(self, at: int, n: int) -> bytes:
        """n bytes from `at` on, fewer at the end."""
        n = min(n, self.size - at)
        if at < self.begin or at + n > self.begin + len(self.data):
            kept = self.data[at - self.begin :] if self.begin <= at < self.begin + len(self.data) else b""
            self.file.seek(at + len(kept))
            self.data, self.begin = kept + self.file.read(min(max(n - len(kept), self.block), self.size - at - len(kept))), at
        return self.data[at - self.begin : at - self.begin + n]


def scan(file, size: int, wanted, payloads: bool) -> Iterator[tuple[dict[str, object], bytes | None]]:
    """The records of an open file that `wanted` takes by their headers; payloads only where asked for."""
    tape, at = Tape(file, size), 0
    while at < size:
        start = tape.take(at, PIECE)
        if start[:2] == b"\x1f\x8b":
            at, found = _packed(tape, at, wanted, payloads)
        elif start[:5] == b"WARC/":
            at, found = _plain(tape, at, wanted, payloads)
        else:
            skip = len(start) - len(start.lstrip(b"\r\n"))
            if not skip:
                raise ValueError(f"no record at byte {at}")
            at += skip
            continue
        if found:
            yield found


def _plain(tape: Tape, at: int, wanted, payloads: bool):
    n = PIECE
    while (end := (data := tape.take(at, n)).find(b"\r\n\r\n")) < 0:
        if len(data) < n:
            raise ValueError(f"a record's headers end too soon at byte {at}")
        n *= 2
    headers = headers_of(data[:end])
    length = int(headers.get("content-length", "0"))
    body = at + end + 4
    row = row_of(headers)
    if not wanted(row):
        return body + length, None
    return body + length, (row, payload_of(headers, tape.take(body, length)) if payloads else None)


def _own_size(head: bytes) -> int | None:
    """A gzip member's length, if the extra field `sl` tells it."""
    if not head[3] & 4:
        return None
    extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
    while len(extra) >= 4:
        n = struct.unpack_from("<H", extra, 2)[0]
        if extra[:2] == b"sl" and n == 8:
            return struct.unpack_from("<I", extra, 4)[0] or None
        extra = extra[4 + n :]
    return None


def _packed(tape: Tape, at: int, wanted, payloads: bool):
    size = _own_size(tape.take(at, PIECE))
    unpack = zlib.decompressobj(31)
    read, fresh, head = at, b"", b""

    def more(limit: int, wrong: str) -> bytes:
        nonlocal read, fresh
        fresh = unpack.unconsumed_tail
        if not fresh:
            fresh = tape.take(read, PIECE if size is None else min(PIECE, at + size - read))
            read += len(fresh)
            if not fresh or unpack.eof:
                raise ValueError(wrong)
        return unpack.decompress(fresh, limit)

    while (end := head.find(b"\r\n\r\n")) < 0:
        if unpack.eof:
            raise ValueError(f"a record's headers end too soon at byte {at}")
        head += more(HEAD, f"a record's headers end too soon at byte {at}")
    headers = headers_of(head[:end])
    row = row_of(headers)
    keep = wanted(row)
    if size and not (keep and payloads):
        return at + size, ((row, None) if keep else None)
    parts = [head[end + 4 :]]
    while not unpack.eof:
        out = more(1 << 20, f"the record at byte {at} ends too soon")
        if keep and payloads:
            parts.append(out)
    after = read - len(unpack.unused_data)
    if not keep:
        return after, None
    if not payloads:
        return after, (row, None)
    body = b"".join(parts)[: int(headers.get("content-length", "0"))]
    return after, (row, payload_of(headers, body))


# the data source


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]]


class WarcDataSource(DataSource):
    """Format `warc`. Options: path; payload (true: the last column is the payload); bytes of a partition or file in split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return HEADERS + (", payload binary" if self.options.get("payload", "true").lower() == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.split = int(options.get("split_bytes", FILE_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _understood(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, folder = _folder(self.path)
        listed = store.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
        if any(i.base_name == MANIFEST for i in listed):
            with store.open_input_stream(f"{folder}/{MANIFEST}") as file:
                sizes = {name: size for name, size, _ in json.loads(file.read())["files"]}
        else:
            sizes = {i.base_name: i.size for i in listed if i.base_name.endswith((".warc", ".warc.gz"))}
        out: list[Files] = []
        held = 0
        for name, size in sorted(sizes.items()):
            if not out or held + size > self.split:
                out.append(Files([]))
                held = 0
            out[-1].names.append((f"{folder}/{name}", size))
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _folder(self.path)
        payloads = "payload" in self.names
        kinds = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_length" else pa.string()) for n in self.names])
        wanted = lambda row: all(_holds(f, row) for f in self.filters)
        rows: list[dict[str, object]] = []
        held = 0
        for name, size in partition.names:
            with store.open_input_file(name) as file:
                for row, payload in scan(file, size, wanted, payloads):
                    rows.append(row | {"payload": payload} if payloads else row)
                    held += 200 + len(payload or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


def _understood(f: Filter) -> bool:
    if isinstance(f, Not):
        return _understood(f.child)
    return isinstance(f, (EqualTo, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and len(f.attribute) == 1 and f.attribute[0] in NAMES


def _holds(f: Filter, row: dict[str, object]) -> bool:
    """As SQL has it: a comparison with null is not true, nor is its negation."""
    return _truth(f, row) is True


def _truth(f: Filter, row: dict[str, object]) -> bool | None:
    if isinstance(f, Not):
        truth = _truth(f.child, row)
        return None if truth is None else not truth
    value = row[f.attribute[0]]
    if isinstance(f, (IsNull, IsNotNull)):
        return (value is None) == isinstance(f, IsNull)
    if value is None:
        return None
    if isinstance(f, EqualTo):
        return None if f.value is None else value == f.value
    if isinstance(f, In):
        return True if value in f.value else None if None in f.value else False
    tests = {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}
    return tests[type(f)](value, f.value)


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_type, record_id, refers_to, target_uri, payload become records; option date is the time of all of them."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.size = int(options.get("split_bytes", FILE_BYTES))
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = _folder(self.path)
        store.create_dir(folder, recursive=True)
        own = uuid.uuid4().hex
        done: list[tuple[str, int, int]] = []
        file, name, size, count = None, "", 0, 0
        for batch in iterator:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for k in range(batch.num_rows):
                get = lambda n: columns[n][k].as_py() if n in columns else None  # noqa: B023, E731
                if file is None:
                    name, size, count = f"part-{own}-{len(done):05d}.warc.gz", 0, 0
                    file = store.open_output_stream(f"{folder}/{name}", compression=None)
                data = member(record(get("record_type") or "response", get("record_id"), get("target_uri"), get("payload") or b"", get("refers_to"), self.date))
                file.write(data)
                size, count = size + len(data), count + 1
                if size >= self.size:
                    file.close()
                    done.append((name, size, count))
                    file = None
        if file is not None:
            file.close()
            done.append((name, size, count))
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _folder(self.path)
        store.create_dir(folder, recursive=True)
        files = [list(f) for m in messages if m for f in m.files]
        if not self.overwrite and store.get_file_info(f"{folder}/{MANIFEST}").type == arrow_fs.FileType.File:
            with store.open_input_stream(f"{folder}/{MANIFEST}") as file:
                files = json.loads(file.read())["files"] + files
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft, compression=None) as file:
            file.write(json.dumps({"files": files}).encode())
        store.move(draft, f"{folder}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _folder(self.path)
        for message in messages:
            for name, *_ in message.files if message else []:
                store.delete_file(f"{folder}/{name}")


# DataFrame functions


def base32_sha1(col: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column."""
    hexed = F.sha1(col)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, order_col: str, min_bytes: int = 0) -> DataFrame:
    """pages(record_id, target_uri, payload, order_col) as records to write: record_type, record_id, refers_to, target_uri, payload.

    Of equal payloads of at least min_bytes, the record with the largest order_col is the response
    that the others revisit; of records that share it, each is a response, and the greatest record_id
    is referred to. Null payloads are empty; null orders are smallest, and where all are null the
    greatest record_id is the response.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    rows = pages.select("record_id", "target_uri", F.col(order_col).alias("place"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = F.octet_length("payload") >= min_bytes
    last = rows.where(large).select("digest", "place", "record_id").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("place", "record_id")).alias("last"))
    shared = written(last.where("n > 1").select("digest", "last"), work_path(spark, "shared_payloads"))
    # only payloads that occur again are listed: few or none, and then the pages aren't shuffled
    told = rows.join(shared, "digest", "left")
    first = F.col("last").isNull() | F.when(F.col("last.place").isNull(), F.col("record_id").eqNullSafe(F.col("last.record_id"))).otherwise(F.col("place").eqNullSafe(F.col("last.place")))
    return told.select(F.when(first, "response").otherwise("revisit").alias("record_type"), "record_id", F.when(~first, F.col("last.record_id")).alias("refers_to"), "target_uri", "payload")


def write_archive(records: DataFrame, path: str, **options: str) -> None:
    """Appends records(record_type, record_id, refers_to, target_uri, payload) to the archive at path; nulls leave a header out."""
    bounded_batches(records.sparkSession)
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").options(path=path, **options).save()


def read_archive(spark: SparkSession, path: str, payload: bool = True, **options: str) -> DataFrame:
    """The records at path, those of one archive by its manifest, else all files named .warc or .warc.gz; none gives no rows."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(path=path, payload=str(payload).lower(), **options).load()
