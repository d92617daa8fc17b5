"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Archives are rows (name, content) of a table, the shape in which ``spark.read.format("binaryFile")`` gives files as well, so
they live in any store that Spark reaches and are committed by Spark. ``RecordReader`` reads any file object with
bounded memory: one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, small_batches

#: Skippable frame that holds the dictionary, and ordinary frame (fixed values of the format).
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
#: An archive is closed when it holds this many bytes of payload.
ARCHIVE_BYTES = 2 << 20
DICT_BYTES, SAMPLE_BYTES = 16 << 10, 512 << 10
#: Groups of equal payloads are broadcast up to this many, else joined with a shuffle.
BROADCAST_GROUPS = 100_000
RECORDS = "archive string, record_id string, type string, target_uri string, payload_digest string, refers_to string, payload_bytes bigint, payload binary"


class WarcError(ValueError):
    """An archive is not what its headers say."""


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record. A revisit's block has the HTTP headers of the full payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{URN}{record_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": _line(uri),
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
    }
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{URN}{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive_bytes(records: list[bytes], dictionary: bytes, level: int = 3) -> bytes:
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
    lead = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""
    return lead + b"".join(squeeze.compress(r) for r in records)


def train(records: list[bytes]) -> bytes:
    """A dictionary from the first records, up to SAMPLE_BYTES of them; empty if they are too few to train one."""
    import zstandard

    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r[: 16 << 10])
        size += len(sample[-1])
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class RecordReader:
    """Iterates over the records of an archive; raises WarcError where frames, headers, lengths or digests do not fit."""

    def __init__(self, file: BinaryIO, name: str = "archive", chunk: int = 16 << 10):
        self.file, self.name, self.chunk, self.at, self.rest = file, name, chunk, 0, b""

    def _need(self, n: int) -> bytes:
        while len(self.rest) < n and (more := self.file.read(max(self.chunk, n - len(self.rest)))):
            self.rest += more
        return self.rest[:n]

    def _fail(self, what: str):
        raise WarcError(f"{self.name}, at byte {self.at}: {what}")

    def __iter__(self) -> Iterator[Record]:
        import zstandard

        known = None
        if len(head := self._need(8)) == 8 and struct.unpack("<II", head)[0] == DICT_MAGIC:
            size = struct.unpack("<II", head)[1]
            frame = self._need(8 + size)
            if len(frame) < 8 + size:
                self._fail("the dictionary is cut off")
            content = frame[8:]
            if content[:4] == FRAME_MAGIC:
                content = zstandard.ZstdDecompressor().decompress(content)
            known = zstandard.ZstdCompressionDict(content)
            self.rest, self.at = self.rest[8 + size :], 8 + size
        opener = zstandard.ZstdDecompressor(dict_data=known)
        while magic := self._need(4):
            if magic != FRAME_MAGIC:
                self._fail("no frame begins here")
            one, parts = opener.decompressobj(), []
            while not one.eof:
                if not self._need(1):
                    self._fail("the last frame is cut off")
                data, self.rest = self.rest, b""
                try:
                    parts.append(one.decompress(data))
                except zstandard.ZstdError as e:
                    self._fail(f"the frame is damaged ({e})")
                self.at += len(data)
            self.rest = one.unused_data
            self.at -= len(self.rest)
            yield self._record(b"".join(parts))

    def _fields(self, head: bytes) -> dict[str, str]:
        out = {}
        for line in head.split(b"\r\n"):
            name, colon, value = line.partition(b":")
            if not colon:
                self._fail(f"no header: {line[:60]!r}")
            out[name.decode().lower()] = value.strip().decode()
        return out

    def _record(self, raw: bytes) -> Record:
        version, _, rest = raw.partition(b"\r\n")
        if version not in (b"WARC/1.0", b"WARC/1.1"):
            self._fail(f"not a WARC version: {version[:20]!r}")
        head, gap, block = rest.partition(b"\r\n\r\n")
        if not gap:
            self._fail("the headers do not end")
        h = self._fields(head)
        if lacks := {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys():
            self._fail(f"without {', '.join(sorted(lacks))}")
        if not h["content-length"].isdigit() or len(block) != int(h["content-length"]) + 4 or block[-4:] != b"\r\n\r\n":
            self._fail(f"a block of {len(block) - 4} bytes; Content-Length says {h['content-length']}")
        block = block[:-4]
        if h["warc-type"] not in ("response", "revisit"):
            return Record(h, {}, block)
        status, _, more = block.partition(b"\r\n")
        fields, gap, payload = more.partition(b"\r\n\r\n")
        if not status.startswith(b"HTTP/") or not gap:
            self._fail("no HTTP message")
        http = self._fields(fields)
        if h["warc-type"] == "revisit":
            if "warc-refers-to" not in h or payload:
                self._fail("a revisit with a payload or without WARC-Refers-To")
        else:
            if "content-length" in http and int(http["content-length"]) != len(payload):
                self._fail(f"a payload of {len(payload)} bytes; its Content-Length says {http['content-length']}")
            if (said := h.get("warc-payload-digest")) and said != f"sha1:{digest_of(payload)}":
                self._fail(f"the payload does not have the digest {said}")
        return Record(h, http, payload)


def plan_records(df: DataFrame, payload: str = "html", id_col: str = "page_id", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, type, refers_to): of equal payloads of at least ``min_bytes`` those with the largest id are responses.

    Equality is by length and SHA-256. A null payload is empty, a null url too. Rows that repeat the largest id are responses as well;
    where every id is null, all are.
    """
    content = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("number"), F.coalesce(F.col(url), F.lit("")).alias("url"), content.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256))).withColumn("size", F.octet_length("payload"))
    groups = rows.where(F.col("size") >= min_bytes).groupBy("key", "size").agg(F.count("*").alias("n"), F.max("number").alias("best"))
    groups = Scratch(df.sparkSession, "warc").table(groups.where("n > 1 and best is not null").select("key", "size", "best"))
    few = groups.count() <= BROADCAST_GROUPS
    rows = rows.join(F.broadcast(groups) if few else groups, ["key", "size"], "left")
    again = F.col("best").isNotNull() & ~F.col("number").eqNullSafe(F.col("best"))
    return rows.select(
        "id",
        "url",
        "payload",
        F.when(again, "revisit").otherwise("response").alias("type"),
        F.when(again, F.col("best").cast("string")).alias("refers_to"),
    )


def write_archives(records: DataFrame, archive_size: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, content): archives of the records of plan_records(), each of a bounded number of payload bytes and one record at least."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size, dictionary = TaskContext.get().partitionId(), 0, [], 0, None

        def close() -> pa.RecordBatch:
            nonlocal n, held, size, dictionary
            if dictionary is None:
                dictionary = train(held)
            out = pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:06d}.warc.zst"]), pa.array([archive_bytes(held, dictionary)], pa.binary())], names=["name", "content"])
            n, held, size = n + 1, [], 0
            return out

        for batch in batches:
            for r in (x for i in range(0, batch.num_rows, 64) for x in batch.slice(i, 64).to_pylist()):
                held.append(record_bytes(r["type"], r["id"] or "", r["url"], r["payload"], r["refers_to"]))
                size += len(held[-1])
                if size >= archive_size:
                    yield close()
        if held:
            yield close()
        give_back()

    small_batches(records.sparkSession)
    return records.mapInArrow(pack, "name string, content binary")


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """One row per record of archives (name, content); see RECORDS. payload_bytes and payload_digest are of the full payload.

    An archive that does not fit its headers fails the job, naming the archive and the byte.
    """
    kinds = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    bare = lambda x: None if x is None else x.strip("<>").removeprefix(URN)

    def rows_of(name: str, content: bytes) -> Iterator[list]:
        for r in RecordReader(io.BytesIO(content), name):
            h = r.headers
            n = int(r.http["content-length"]) if h["warc-type"] == "revisit" and "content-length" in r.http else len(r.payload)
            yield [name, bare(h["warc-record-id"]), h["warc-type"], h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, bare(h.get("warc-refers-to")), n, r.payload if payload else None]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                for row in rows_of(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()):
                    held.append(row)
                    size += row[6] if payload else 0
                    if len(held) >= 4096 or size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds, strict=True)], schema=kinds)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds, strict=True)], schema=kinds)

    return archives.select("name", "content").mapInArrow(read, RECORDS)


def round_trip(df: DataFrame, payload: str = "html", id_col: str = "page_id", url: str = "url", min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Writes a record per row of df, reads the archives back and returns what read_archives() gives."""
    stored = Scratch(df.sparkSession, "archives").table(write_archives(plan_records(df, payload, id_col, url, min_bytes)), "uncompressed")
    return read_archives(stored, with_payload)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes archives as files into a folder that every executor mounts; a task that is run again replaces its own files."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, name)
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(f"{path}.{os.getpid()}", path)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    return archives.select("name", "content").mapInArrow(save, "name string")
