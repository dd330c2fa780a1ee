"""A deterministic, sharded WARC writer for web pages, and its reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.session import run_dir

MIN_REVISIT = 1000  # bytes of a payload that is stored once
FILE_BYTES = 64 << 20  # compressed size at which a file is closed
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f0c8f8e-5c0f-4f0e-9d1a-3b7a5a1f2c11")
_READ = 1 << 20


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest) of every row of ``pages``: the html in UTF-8, nothing for a null."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    return rows.withColumn("digest", F.sha1("payload"))


def revisits(records: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to): the records whose payload another one holds.

    Of the records with equal payloads of ``min_revisit`` bytes or more, those with the largest
    id are responses and the others revisit it; repeated rows of the largest id are all
    responses. A record without an id is a revisit if one with an id has its payload.
    """
    large = records.filter(F.octet_length("payload") >= min_revisit).groupBy("page_id", "digest").agg(F.count("*").alias("n"))
    equal = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    equal = equal.filter("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")
    found = large.select("page_id", "digest").join(equal, "digest")
    return found.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")


def _record_id(page_id: int | None, digest: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest} {place}')}>"


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _block(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(body)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: int, date: str = DATE) -> bytes:
    """A response record, or a revisit record without the payload; headers and digests are made anew."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    uri = "".join(c for c in url or "" if c > " ") or f"urn:page:{page_id}"
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest, place)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _base32(digest)),
        ("WARC-Block-Digest", _base32(hashlib.sha1(body).hexdigest())),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest, 0)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _block(headers, body)


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Roller:
    """Writes gzip members to numbered files of a shard, each under a temporary name until it is whole."""

    def __init__(self, folder: str, shard: int, attempt: int, size: int, level: int, date: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.attempt, self.size, self.level, self.date = shard, attempt, size, level, date
        self.number, self.stream = 0, None

    def add(self, key: int | None, data: bytes) -> Iterator[tuple]:
        if self.stream is None:
            self._open()
        packed = _member(data, self.level)
        self._put(packed)
        self.records, self.last = self.records + 1, key
        self.first = key if self.records == 1 else self.first
        if self.written >= self.size:
            yield self.close()

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.path = f"{self.folder}/{self.name}"
        self.store.create_dir(self.folder, recursive=True)
        self.stream = self.store.open_output_stream(f"{self.path}.{self.attempt}.tmp", compression=None)
        self.written = self.records = 0
        self.first = self.last = None
        self.sum = hashlib.sha256()
        info = [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, self.name)}>"),
            ("WARC-Date", self.date),
            ("WARC-Filename", self.name),
            ("Content-Type", "application/warc-fields"),
        ]
        self._put(_member(_block(info, b"format: WARC File Format 1.1\r\n"), self.level))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.sum.update(data)
        self.written += len(data)

    def _stands(self) -> bool:
        info = self.store.get_file_info(self.path)
        if info.type == fs.FileType.NotFound or info.size != self.written:
            return False
        found = hashlib.sha256()
        with self.store.open_input_stream(self.path, compression=None) as stream:
            while data := stream.read(_READ):
                found.update(data)
        return found.digest() == self.sum.digest()

    def close(self) -> tuple:
        self.stream.close()
        self.stream = None
        temporary = f"{self.path}.{self.attempt}.tmp"
        if self._stands():  # from another attempt, whose manifest may count already
            self.store.delete_file(temporary)
        else:
            self.store.move(temporary, self.path)
        self.number += 1
        return self.name, self.first, self.last, self.records, self.written, self.sum.hexdigest()


_MANIFEST = pa.schema(
    [("file", pa.string()), ("first_page", pa.int64()), ("last_page", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
)
MANIFEST_SCHEMA = "file string, first_page long, last_page long, records long, bytes long, sha256 string"


def write_archive(
    records: DataFrame, seen: DataFrame, folder: str, file_bytes: int = FILE_BYTES, level: int = LEVEL, date: str = DATE
) -> None:
    """Write ``records`` (of ``payloads``) as gzipped WARC files with a manifest; those in ``seen`` (of ``revisits``) as revisits.

    Records are range-partitioned and sorted by page id, so every task writes a range of ids,
    and the same rows in the same ranges give the same bytes. The rows of ``seen`` travel along and sort before
    the record they decide, which spares a join of the payloads. A file is closed at
    ``file_bytes`` compressed bytes and gets its name when it is whole. The manifest, committed
    by Spark when all tasks have ended, lists the files that count; readers go by it alone, so
    files of lost tasks do no harm. A file that stands with the bytes of this attempt is left
    in place, so a repeated task never takes away what a manifest counts on. ``folder`` is a URI of a store that all executors reach.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        context = TaskContext.get()
        roller = _Roller(target, context.partitionId(), context.taskAttemptId(), file_bytes, level, date)
        before, place, refers_to, done = None, 0, None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = row["page_id"], row["digest"]
                if own != before:
                    before, place, refers_to = own, 0, row["refers_to"]
                if row["refers_to"] is not None:
                    continue
                data = record(row["page_id"], row["url"], row["payload"], row["digest"], refers_to, place, date)
                place += 1
                done += roller.add(row["page_id"], data)
        if roller.stream is not None:
            done.append(roller.close())
        columns = list(zip(*done, strict=True)) if done else [[] for _ in _MANIFEST]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MANIFEST, strict=True)], schema=_MANIFEST)

    target = f"{_uri(folder)}/records"
    both = records.unionByName(seen, allowMissingColumns=True)
    ordered = both.repartitionByRange("page_id").sortWithinPartitions("page_id", "digest", F.desc_nulls_last("refers_to"), "url")
    ordered.mapInArrow(run, MANIFEST_SCHEMA).write.json(f"{folder}/manifest")


def _uri(folder: str) -> str:
    return folder if ":" in folder.split("/")[0] else f"file://{folder}"


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, uncompressed, one at a time."""
    unpacker, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(_READ)
        if not data:
            if parts:
                raise ValueError("the file ends within a record")
            return
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("the record is cut off")
    return headers, rest[:size]


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records.

    Reads the files of the manifest, each as a stream. Payload digests of responses are
    computed anew; a record that does not have its digest fails the read. The payload of a
    revisit is null, its size and digest are those of the full payload.
    """
    manifest = spark.read.schema(MANIFEST_SCHEMA).json(f"{folder}/manifest")
    target = f"{_uri(folder)}/records"

    def run(batches: Iterator[pa.RecordBatch]):
        store, path = fs.FileSystem.from_uri(target)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, count = [], 0, 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        headers, body = parse_record(data)
                        if headers["warc-type"] == "warcinfo":
                            continue
                        count += 1
                        rows.append(_page(headers, body))
                        held += len(body)
                        if held > _READ:
                            yield _pages(rows)
                            rows, held = [], 0
                if count != records:
                    raise ValueError(f"{name} has {count} records for {records}")
                yield _pages(rows)

    files = max(1, manifest.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return manifest.select("file", "records").repartition(files).mapInArrow(run, schema)


def _page(headers: dict[str, str], body: bytes) -> tuple:
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(http.decode().lower().rpartition("content-length: ")[2].split("\r\n")[0])
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind, page, refers = headers["warc-type"], headers.get("x-page-id"), headers.get("x-refers-to-page-id")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {headers['warc-record-id']} does not have its payload digest")
    number = int(page) if page else None
    return number, headers["warc-target-uri"], size, digest, kind, int(refers) if refers else None, payload if kind == "response" else None


_PAGE = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _PAGE]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PAGE, strict=True)], _NAMES)


def archive_round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT, **settings) -> DataFrame:
    """Write all ``pages`` to a new folder of the shared store and read the archive back."""
    spark = pages.sparkSession
    folder = run_dir(spark, "warc")
    records = payloads(pages)
    write_archive(records, revisits(records, min_revisit), folder, **settings)
    return read_archive(spark, folder)
