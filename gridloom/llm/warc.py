"""Web pages as WARC archives: written with one gzip member per record, read back in sequence.

Writing: equal payloads are told by SHA-256 and length. Of each such group the row with the
smallest key is a `response` with the whole payload, the others are `revisit` records that
refer to it and hold HTTP headers only. Payloads cross the cluster once, to be joined to
their rows' roles, unless the roles are few enough for Spark to send them round.

Reading: a file is read from its start in chunks; each gzip member is inflated as its bytes
come, its header gives the length of its block, and the digests of block and payload are
checked against what was read. No more than a record is held.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import join_counted, local_path, ready, settled, shared_dir, staged

#: Bytes of compressed records after which a task begins a new file, and what is read at a time.
FILE_BYTES, CHUNK = 256 << 20, 64 << 10
#: Of the registered revisit profile.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """A record as one gzip member."""
    head = {"WARC-Type": kind, **fields, "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode()) + squeeze.compress(block) + squeeze.compress(END) + squeeze.flush()


@dataclass
class Record:
    version: str
    fields: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.fields.get("warc-type", "")

    def http(self) -> tuple[dict[str, str], bytes]:
        """The HTTP headers of a response or revisit, and what follows them."""
        head, _, payload = self.block.partition(END)
        return _fields(head.decode("latin-1").split("\r\n")[1:]), payload


def _fields(lines: list[str]) -> dict[str, str]:
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}


class _Member:
    """The bytes of one gzip member as they are inflated."""

    def __init__(self, source: BinaryIO, ahead: bytes):
        self.source, self.inflate, self.ready, self.ahead = source, zlib.decompressobj(31), bytearray(), ahead

    def more(self) -> bool:
        """Inflates some more; False at the member's end."""
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.ahead or self.source.read(CHUNK)
        self.ahead = b""
        if not data:
            raise ValueError("the file ends within a record")
        self.ready += self.inflate.decompress(data, 1 << 20)
        return True

    def upto(self, sign: bytes) -> bytes:
        seen = 0
        while (at := self.ready.find(sign, max(0, seen - len(sign)))) < 0:
            seen = len(self.ready)
            if not self.more():
                raise ValueError("a record has no end of its header")
        out = bytes(self.ready[:at])
        del self.ready[: at + len(sign)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise ValueError("a record is shorter than its Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def finish(self) -> bytes:
        """What follows the member in the file; the member must end here."""
        while not self.inflate.eof:
            self.more()
        if self.ready:
            raise ValueError("a record is longer than its Content-Length")
        return self.inflate.unused_data


def read_records(source: BinaryIO) -> Iterator[Record]:
    """The records of a file in sequence; ValueError where framing or a digest is wrong."""
    ahead = b""
    while ahead := ahead or source.read(CHUNK):
        member = _Member(source, ahead)
        version, *lines = member.upto(END).decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        fields = _fields(lines)
        if not fields.get("content-length", "").isdigit():
            raise ValueError("a record without Content-Length")
        out = Record(version, fields, member.take(int(fields["content-length"])))
        if member.take(len(END)) != END:
            raise ValueError("a record is longer than its Content-Length")
        ahead = member.finish()
        _check(out.block, fields.get("warc-block-digest"))
        if out.kind == "response":
            _check(out.http()[1], fields.get("warc-payload-digest"))
        yield out


def _check(data: bytes, digest: str | None) -> None:
    name, _, value = (digest or "").partition(":")
    if name == "sha1" and base32_sha1(data) != value.upper():
        raise ValueError(f"a digest is {base32_sha1(data)} where the record has {value}")


def record_id(key: str | None, row: int) -> str:
    """The URN of a row: its key, and a number that tells rows of equal keys apart."""
    return f"urn:row:{row}" if key is None else f"urn:row:{row}:{quote(key, safe='')}"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def roles(keys: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Of a written frame of (row, key, digest, n): row, refers_row, refers_key for each row that revisits another.

    Of rows with one digest and length that with the smallest key is the response; a null
    key comes last, and the row's number decides among equal keys. Payloads of fewer than
    min_bytes bytes are never revisited.
    """
    some = keys.where(F.col("n") >= min_bytes)
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first")
    groups = staged(some.groupBy("digest").agg(first, F.count("*").alias("copies")).where("copies > 1"), "warc-groups")
    found = join_counted(some, groups, "digest", keys.count(), "copies")
    return found.where("row <> first.row").select("row", F.col("first.row").alias("refers_row"), F.col("first.key").cast("string").alias("refers_key"))


def write_warc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", path: str | None = None, min_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str | None = None) -> DataFrame:
    """Writes a record for each row; returns (file, records, bytes), a row for each file.

    A file gets about file_bytes bytes at most, and a record more. A task that runs again
    writes the same files anew. A null html is an empty payload, a null url an empty
    target, a null key none. Line ends and other control characters of a url are
    percent-encoded. Each of repeated rows has its record; other columns stay behind. An
    empty table gives no file. date: when the pages were fetched, in ISO 8601; by default
    now. Pages that are no plain scan of files are written once first.
    """
    spark = ready(pages.sparkSession)
    path = path or shared_dir(spark, "warc")
    folder = local_path(path)
    where, name = _system(folder)
    where.create_dir(name, recursive=True)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b"")).alias("payload"))
    rows = settled(rows, "warc-pages").withColumn("row", F.monotonically_increasing_id())
    digest = F.concat(F.sha2("payload", 256), F.lit("-"), F.octet_length("payload").cast("string"))
    keys = staged(rows.select("row", "key", digest.alias("digest"), F.octet_length("payload").alias("n")), "warc-keys")
    out = rows.withColumn("key", F.col("key").cast("string")).join(staged(roles(keys, min_bytes), "warc-roles"), "row", "left").sortWithinPartitions("row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, name = _system(folder)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        sink, at, count, size, made = None, 0, 0, 0, []

        def close() -> None:
            nonlocal sink
            sink.close()
            to = f"part-{part:06d}-{at:04d}.warc.gz"
            where.move(f"{name}/.{own}", f"{name}/{to}")
            made.append((f"{path}/{to}", count, size))
            sink = None

        for batch in batches:
            for r in batch.to_pylist():
                if sink is not None and size >= file_bytes:
                    close()
                    at += 1
                if sink is None:
                    # under a name of this run, and renamed when it is complete
                    sink, count, size = where.open_output_stream(f"{name}/.{own}", compression=None), 0, 0
                    info = record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    sink.write(info)
                    size += len(info)
                data = page(r, date)
                sink.write(data)
                count, size = count + 1, size + len(data)
        if sink is not None:
            close()
        files, counts, sizes = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "records", "bytes"])

    return staged(out.mapInArrow(write, "file string, records long, bytes long"), "warc-files")


def page(row: dict, date: str) -> bytes:
    """A page's record, by its role."""
    payload = row["payload"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END.decode()}".encode()
    fields = {
        "WARC-Record-ID": f"<{record_id(row['key'], row['row'])}>",
        "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: quote(m[0]), row["url"] or ""),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if row["refers_row"] is None:
        return record("response", fields, head + payload)
    return record("revisit", fields | {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": f"<{record_id(row['refers_key'], row['refers_row'])}>"}, head)


def read_warc(spark: SparkSession, files: DataFrame, payloads: bool = False) -> DataFrame:
    """record_id, record_type, target_uri, date, payload_bytes, payload_digest, refers_to of each record of a frame of paths (column file), and payload if asked for.

    A revisit has its HTTP header's length and the digest of what it refers to; a record
    without a payload digest gets that of its own payload. Records that are neither
    response nor revisit (warcinfo, request, metadata) are checked and left out. No files
    give no rows; a file that is cut off or damaged is an error.
    """
    ready(spark)
    names = ("record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to")
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("payload_bytes", T.LongType()), *([T.StructField("payload", T.BinaryType())] if payloads else [])])
    kinds = pa.schema([*((n, pa.string()) for n in names), ("payload_bytes", pa.int64()), *([("payload", pa.binary())] if payloads else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (x for b in batches for x in b.column("file").to_pylist()):
            where, name = _system(local_path(uri))
            held, size = [], 0
            with where.open_input_stream(name, compression=None) as source:
                for r in _named(read_records(source), uri):
                    if r.kind not in ("response", "revisit"):
                        continue
                    http, payload = r.http()
                    whole = r.kind == "response"
                    digest = r.fields.get("warc-payload-digest") or f"sha1:{base32_sha1(payload)}"
                    found = {"record_id": r.fields.get("warc-record-id"), "record_type": r.kind, "target_uri": r.fields.get("warc-target-uri"), "date": r.fields.get("warc-date"), "payload_digest": digest.partition(":")[2].upper(), "refers_to": r.fields.get("warc-refers-to"), "payload_bytes": len(payload) if whole else int(http.get("content-length", 0))}
                    held.append(found | ({"payload": payload if whole else None} if payloads else {}))
                    size += len(payload) if payloads else 0
                    if len(held) == 4096 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=kinds)

    some = files.select("file")
    return some.repartitionByRange(max(1, some.count()), "file").mapInArrow(read, schema)


def _named(records: Iterator[Record], uri: str) -> Iterator[Record]:
    try:
        yield from records
    except (ValueError, zlib.error) as e:
        raise ValueError(f"{uri}: {e}") from e


def page_records(records: DataFrame, kind: T.DataType, key: str = "page_id") -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to of what write_warc wrote; refers_to is the response's key."""

    def named(c: str):
        found = F.regexp_extract(c, "^<urn:row:[0-9]+:([^<>]*)>$", 1)
        return F.when(F.col(c).rlike("^<urn:row:[0-9]+:[^<>]*>$"), F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B")))).try_cast(kind)

    return records.select(named("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", named("refers_to").alias("refers_to"))
