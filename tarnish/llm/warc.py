"""WARC archives as a Spark data source, read and written by tasks.

Reading plans one partition for each group of archive files, takes filters
on the header columns (``record_type``, ``record_id``, ``target_uri``,
``payload_digest``, ``refers_to``) into the scan, parses a record's headers
first and leaves the payload compressed when a filter fails or the option
``payload`` is ``none``: the writer notes each gzip member's length in its
header (extra field ``sl``), so the reader seeks over what it doesn't want.
In plain ``.warc`` files, and from the first gzip member on that lacks the
extra field, records are read in turn, any number to a member.  A record
that is cut short is an error.  Reading turns on Spark's filter pushdown for
Python sources in the session.

Options: ``path`` (required), ``payload`` = ``bytes`` | ``digest`` | ``none``
(``digest``: length and digest are computed from the decoded payload, which
is then dropped), ``split_bytes`` (files grouped to a partition).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import prepare, scratch_path

READ_SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_bytes long, computed_digest string, payload binary"
WRITE_COLUMNS = ("record_type", "record_id", "target_uri", "warc_date", "payload_digest", "refers_to", "payload_bytes", "payload")
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ROLL_BYTES, HEAD_BYTES, LEVEL = 64 << 20, 4096, 3


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The shared store behind ``path``: local paths and file: URIs, or any
    store that pyarrow knows (hdfs, s3, gs)."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` holds the lengths of its
    compressed and plain bytes (0, 0 where they need over 32 bits)."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    sizes = (len(body), len(data)) if max(len(body), len(data)) < 2**32 else (0, 0)
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *sizes)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record.  A revisit keeps the HTTP header, with the full
    payload's length, and no payload."""
    payload = row["payload"] or b""
    size = len(payload) if row["payload_bytes"] is None else row["payload_bytes"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_line(row['record_id'])}>", f"WARC-Date: {row['warc_date']}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_line(row['refers_to'])}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write files under temporary names; commit gives those of the
    successful attempts their final names, so a lost executor leaves nothing
    that a reader sees."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(c) for c in WRITE_COLUMNS]
            for i in range(batch.num_rows):
                if out is None or size >= ROLL_BYTES:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/.{files[-1]}.tmp"), 0
                data = gzip_member(record_bytes({c: v[i].as_py() for c, v in zip(WRITE_COLUMNS, columns, strict=True)}))
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        names = [f for m in messages if m for f in m.files]
        with ThreadPoolExecutor(32) as pool:
            list(pool.map(lambda name: fs.move(f"{root}/.{name}.tmp", f"{root}/{name}"), names))

    def abort(self, messages):
        fs, root = filesystem(self.path)
        for name in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/.{name}.tmp")


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


def _headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "bytes")
        self.split_bytes = int(options.get("split_bytes", 32 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = {EqualTo: "equal", In: "in", StringStartsWith: "starts", IsNotNull: "given"}.get(type(f))
            if kind and column in HEADERS:
                self.tests.append((kind, column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, root = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        found = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")) and not f.base_name.startswith("."))
        bins: list[Files] = []
        room = 0
        for path, size in found:
            if not bins or room < size:
                bins.append(Files([]))
                room = self.split_bytes
            bins[-1].files.append((path, size))
            room -= size
        return bins or [Files([])]

    def wanted(self, row: dict) -> bool:
        def holds(kind, have, value):
            if have is None:
                return False
            return kind == "given" or (have == value if kind == "equal" else have in value if kind == "in" else have.startswith(value))

        return all(holds(kind, row[c], v) for kind, c, v in self.tests)

    def parse(self, head: bytes) -> dict:
        fields = _headers(head)
        row = {c: fields.get(h) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        row["payload_digest"] = row["payload_digest"] and row["payload_digest"].rpartition(":")[2]
        row["length"] = int(fields.get("content-length", 0))
        row["http"] = fields.get("content-type", "").startswith("application/http")
        return row

    def finish(self, row: dict, block: bytes | None, head: bytes) -> dict:
        """Adds what the block (or, where it isn't read, its first bytes) tells."""
        data = head if block is None else block
        end = data.find(b"\r\n\r\n") + 4 if row.pop("http") else 0
        inner = _headers(data[: end - 4]) if end >= 4 else {}
        size = int(inner.get("content-length", row["length"] - end))
        payload = None if block is None or row["record_type"] == "revisit" else block[end:]
        row |= {"payload_bytes": size, "computed_digest": None, "payload": None}
        row.pop("length")
        if payload is not None:
            row["payload_bytes"] = len(payload)
            row["computed_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if self.payload == "bytes":
                row["payload"] = payload
        return row

    def records(self, stream, size: int, zipped: bool):
        """Members that tell their length hold one record each and are passed
        over as a whole; from the first one that doesn't on, and in plain
        files, records are read one after the other."""
        at = 0
        while zipped and at < size:
            stream.seek(at)
            first = stream.read(min(size - at, HEAD_BYTES))
            skip, body = _member(first)
            if not body:
                break
            if at + skip + body + 8 > size:
                raise ValueError(f"the record at byte {at} is cut short")
            z = zlib.decompressobj(-15)
            plain = z.decompress(first[skip:])
            while b"\r\n\r\n" not in plain and not z.eof and (more := stream.read(HEAD_BYTES)):
                plain += z.decompress(more)
            end = plain.find(b"\r\n\r\n") + 4
            if end < 4:
                raise ValueError(f"the record at byte {at} has no end of headers")
            row = self.parse(plain[: end - 4])
            length, keep = row["length"], self.wanted(row)
            full = keep and self.payload != "none"
            if full:
                parts = [plain]
                while not z.eof and (more := stream.read(1 << 18)):
                    parts.append(z.decompress(more))
                plain = b"".join(parts)
                if len(plain) < end + length:
                    raise ValueError(f"the record at byte {at} is cut short")
            if keep:
                yield self.finish(row, plain[end : end + length] if full else None, plain[end : end + length])
            at += skip + body + 8
        if at < size:
            stream.seek(at)
            yield from self.serial(gzip.GzipFile(fileobj=stream) if zipped else stream)

    def serial(self, reader):
        """Records of a plain stream; blocks that aren't wanted are dropped
        piece by piece."""
        held = b""

        def fill(n: int) -> bool:
            nonlocal held
            parts, have = [held], len(held)
            while have < n and (more := reader.read(min(1 << 20, max(n - have, HEAD_BYTES)))):
                parts.append(more)
                have += len(more)
            held = b"".join(parts)
            return have >= n

        while True:
            while fill(1) and held[:1] in b"\r\n":  # records end with two empty lines
                held = held.lstrip(b"\r\n")
            if not held:
                return
            while (end := held.find(b"\r\n\r\n")) < 0:
                if not fill(len(held) + 1):
                    raise ValueError("the last record has no end of headers")
            row, held = self.parse(held[:end]), held[end + 4 :]
            length, keep = row["length"], self.wanted(row)
            full = keep and self.payload != "none"
            if full:
                fill(length)
            else:
                fill(min(length, HEAD_BYTES))
            head, left = held[:length], length - len(held)
            held = held[length:]
            while left > 0 and (more := reader.read(min(left, 1 << 20))):
                left -= len(more)
            if left > 0:
                raise ValueError("the last record is cut short")
            if keep:
                yield self.finish(row, head if full else None, head)

    def read(self, partition):
        fs, _ = filesystem(self.path)
        shape = pa.schema({"record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "warc_date": pa.string(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64(), "computed_digest": pa.string(), "payload": pa.binary()})
        rows, held = [], 0
        for path, size in partition.files:
            with fs.open_input_file(path) as stream:
                for row in self.records(stream, size, path.endswith(".gz")):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=shape)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=shape)


def _member(data: bytes) -> tuple[int, int]:
    """Length of a gzip member's header, and of its compressed bytes (0 if
    the header doesn't tell)."""
    if data[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip member")
    flags, at, body = data[3], 10, 0
    if flags & 4:
        extra = data[12 : 12 + struct.unpack_from("<H", data, 10)[0]]
        at, k = 12 + len(extra), 0
        while k + 4 <= len(extra):
            size = struct.unpack_from("<H", extra, k + 2)[0]
            if extra[k : k + 2] == b"sl" and size == 8:
                body = struct.unpack_from("<I", extra, k + 4)[0]
            k += 4 + size
    for bit in (8, 16):  # file name, comment
        if flags & bit:
            at = data.index(b"\x00", at) + 1
    return at + 2 * bool(flags & 2), body


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32(hex_digest: Column) -> Column:
    """Base32 of a 40-digit hex string: each ten hex digits are eight digits."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    parts = [F.lpad(F.conv(F.substring(hex_digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), digits, BASE32)


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, salts: int = 32) -> DataFrame:
    """Records to write: of equal payloads of ``min_bytes`` at least, the one
    with the largest id is the response and the others revisit it (rows that
    share that id are all responses); smaller payloads are all responses.

    Only groups of two or more are joined back, each spread over ``salts``
    keys, so a payload that a third of the pages have meets no single task.
    """
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    page = page.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    groups = page.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", F.col("payload_bytes").alias("size")).agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    page = page.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    out = page.join(groups, (page.digest == groups.digest) & (page.payload_bytes == groups["size"]) & (page.salt == groups.salt), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("response")), F.lit(False)) & F.col("response").isNotNull()
    return out.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        base32(page.digest).alias("payload_digest"),
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("response").cast("string"))).alias("refers_to"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records (the columns of ``WRITE_COLUMNS``) as archives under ``path``."""
    register(records.sparkSession)
    records.select(*WRITE_COLUMNS).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Writes a record for each page and reads the archives back.

    Null html is an empty payload; a null or repeated page_id and a null url
    are kept; an empty table gives no rows; other columns are ignored.
    Length and digest of a response are computed from the payload that was
    read; those of a revisit are in its headers.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(with_revisits(pages, **columns), path)
    back = read_warc(spark, path, "digest")
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as long)")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", F.coalesce("computed_digest", "payload_digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
