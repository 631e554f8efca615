"""WARC archives in seekable Zstandard bundles.

Format. A bundle holds WARC/1.1 records in independent zstd frames of about `frame_bytes` each and ends with
the public seekable-format footer: a skippable frame with the compressed and plain size of every frame.
Any standard zstd reader reads a bundle as one stream; a record is found by (bundle, frame, offset
within the frame's plain bytes), which the index table holds for each record.

Dedup. Payload digests are SHA-1 in base32. Of equal payloads the row with the smallest id is the response, the
others are revisit records without a payload that name it.

Record ids. A response that is the only row of its id and payload is `urn:page:ID:DIGEST`, so a revisit can name it without a look at
other bundles. All other records have the place in their bundle behind that, which is unique as well.

Reading back. Each bundle is a task of its own. Digest and size of a response are computed from the block that was read and compared
with its header; a frame's checksum, a digest or a length that differs stops the job. A revisit has no block: its fields are the header's.

Scale. Ids by digest are aggregated with map-side combine; the join back to the pages is a plain equi-join, so
a payload that a third of all pages share is split by adaptive execution. Each task writes bundles of its own,
named by a fresh random id, and returns their index rows; only the index rows of finished tasks are committed,
so files of failed or repeated attempts are never looked at.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import fresh_dir, materialise, small_batches

_SEEK_FRAME, _SEEK_END = 0x184D2A5E, 0x8F92EAB1
_MAX_FRAME = 1 << 30


def open_file(path: str, mode: str):
    """Open a shared file: local or mounted paths directly, other schemes through pyarrow's file systems."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    if "w" in mode:
        where.create_dir(os.path.dirname(name), recursive=True)
        return where.open_output_stream(name)
    return where.open_input_file(name)


class BundleWriter:
    """Writes records to one bundle; add() returns the record's place."""

    def __init__(self, out, frame_bytes: int = 1 << 18, level: int = 3):
        self.out, self.frame_bytes, self.table, self.size = out, frame_bytes, [], 0
        self.buffer, self.codec = bytearray(), zstd.ZstdCompressor(level=level, write_checksum=True)

    def add(self, record: bytes) -> tuple[int, int]:
        if self.buffer and len(self.buffer) + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.table), len(self.buffer)
        self.buffer += record
        return place

    def flush(self) -> None:
        if self.buffer:
            if len(self.buffer) > _MAX_FRAME:
                raise ValueError("a record of more than 1 GiB has no place in a frame")
            frame = self.codec.compress(bytes(self.buffer))
            self.out.write(frame)
            self.table.append((len(frame), len(self.buffer)))
            self.size += len(frame)
            self.buffer = bytearray()

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        self.out.write(struct.pack("<II", _SEEK_FRAME, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0, _SEEK_END))
        self.out.close()


class BundleReader:
    """Reads frames of one bundle by its seek table."""

    def __init__(self, path: str):
        self.file = open_file(path, "rb")
        size = self.file.seek(0, 2) or self.file.tell()
        self.file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != _SEEK_END:
            raise ValueError(f"{path} has no seek table")
        self.file.seek(size - 9 - 8 * n)
        sizes = struct.iter_unpack("<II", self.file.read(8 * n))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed
        self.codec = zstd.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        self.file.seek(at)
        return self.codec.decompress(self.file.read(packed), max_output_size=plain)

    def record(self, frame: int, offset: int) -> bytes:
        """The record at an index place; opens that frame only."""
        data = self.frame(frame)
        return data[offset : offset + record_length(data, offset)]

    def close(self) -> None:
        self.file.close()


def _clean(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_name(page_id: int | None, digest: str, place: str = "") -> str:
    """Record id without brackets: page, payload digest and, where these two may occur again, the place."""
    return f"urn:page:{'' if page_id is None else page_id}:{digest}" + (f":{place}" if place else "")


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, place: str = "") -> bytes:
    """One WARC record. A revisit has no block; its payload's length is in WARC-Payload-Length."""
    body = payload if kind == "response" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_name(page_id, digest, place)}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _clean(url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload))), ("Page-Id", "" if page_id is None else str(page_id))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_name(refers_to, digest)}>")]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def referred_page(head: dict[str, str]) -> int | None:
    """The page that a revisit's WARC-Refers-To names."""
    name = head.get("WARC-Refers-To", "").strip("<>").split(":")
    return int(name[2]) if len(name) > 2 and name[2] else None


def payload_fields(head: dict[str, str], block: bytes) -> tuple[int, str]:
    """Length and digest of a record's payload: computed from a response's block, and a revisit's own words. Raises where block and header differ."""
    stated = int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] != "response":
        return stated
    found = len(block), base32(hashlib.sha1(block).digest())
    if found != stated:
        raise ValueError(f"the payload of record {head['WARC-Record-ID']} is not what its header says: {found} for {stated}")
    return found


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record that begins at `at`."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(head["Content-Length"])
    return head, data[stop + 4 : stop + 4 + n], stop + 4 + n + 4


def record_length(data: bytes, at: int) -> int:
    return parse_record(data, at)[2] - at


def plan_records(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null: empty), sha1 (hex), record_type, refers_to, alone (no other response has this id and payload).

    Of equal payloads of min_bytes or more the smallest id is the response (all rows that have it, if it repeats; all rows, if no
    row has an id); the others are revisits. Smaller payloads are all responses. Where the smallest id repeats, what revisits name is the
    common beginning of its responses' record ids.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    # only payloads that repeat are looked up, in a table of its own, so that a payload of very many pages is split in the join
    counts = p.groupBy("sha1", "page_id").agg(F.count("*").alias("n")).groupBy("sha1")
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n")))
    first = materialise(counts.agg(least.alias("least"), F.sum("n").alias("c")).where("c > 1").select(F.col("sha1").alias("sha1_"), F.col("least.page_id").alias("first_id"), F.col("least.n").alias("first_n")), "digests")
    joined = p.join(first, p.sha1 == first.sha1_, "left")
    large = F.octet_length("payload") >= min_bytes
    revisit = large & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    alone = F.col("sha1_").isNull() | F.coalesce(large & (F.col("first_n") == 1), F.lit(False))
    return joined.select("page_id", "url", "payload", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"), (~revisit & alone).alias("alone"))


def write_bundles(records: DataFrame, folder: str, *, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 27) -> DataFrame:
    """Write the planned records as bundles into folder/bundles; returns the committed index: page_id, bundle, frame, offset, length."""
    small_batches(records.sparkSession)
    spark = records.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, written = None, "", 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                rows = []
                for r in batch.slice(lo, 200).to_pylist():
                    if writer is None:
                        name = f"{folder}/bundles/{uuid.uuid4().hex}.warc.zst"
                        writer = BundleWriter(open_file(name, "wb"), frame_bytes)
                    place = "" if r["alone"] else f"{os.path.basename(name)[:32]}-{written}"
                    written += 1
                    record = make_record(r["page_id"], r["url"], r["payload"].encode("utf-8", "surrogatepass"), base32(bytes.fromhex(r["sha1"])), r["record_type"], r["refers_to"], place)
                    frame, offset = writer.add(record)
                    rows.append((r["page_id"], name, frame, offset, len(record)))
                    if writer.size > bundle_bytes:
                        writer.close()
                        writer = None
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["page_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    schema = "page_id long, bundle string, frame long, offset long, length long"
    records.mapInArrow(write, schema).write.parquet(f"{folder}/index")
    return spark.read.schema(schema).parquet(f"{folder}/index")


def read_bundles(index: DataFrame) -> DataFrame:
    """Read every bundle of the index: page_id, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) from the records themselves."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                reader = BundleReader(bundle)
                for i in range(len(reader.frames)):
                    data, at, rows = reader.frame(i), 0, []
                    while at < len(data):
                        head, block, at = parse_record(data, at)
                        answer = head["WARC-Type"] == "response"
                        rows.append((int(head["Page-Id"]) if head["Page-Id"] else None, *payload_fields(head, block), head["WARC-Type"], referred_page(head), block.decode("utf-8", "replace") if answer else None))
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], t) for j, (_, t) in enumerate(fields)], names=[k for k, _ in fields])
                reader.close()

    bundles = index.select("bundle").distinct()
    dealt = bundles.repartition(max(1, bundles.count()))  # by number, so that adaptive execution doesn't put bundles together again
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages to a fresh (or the given) shared folder and return the index; an empty table gives an empty index."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    keys = ("frame_bytes", "bundle_bytes")
    return write_bundles(plan_records(pages, **{k: v for k, v in options.items() if k not in keys}), folder, **{k: v for k, v in options.items() if k in keys})


def fetch(spark: SparkSession, index: DataFrame, ids: Column) -> DataFrame:
    """page_id and raw record of the index rows that satisfy `ids`. A bundle's seek table is read once, and only their frames are opened."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader, at, data = None, None, -1, b""
        for batch in batches:
            for r in batch.to_pylist():
                if r["bundle"] != name:
                    if reader:
                        reader.close()
                    name, reader, at = r["bundle"], BundleReader(r["bundle"]), -1
                if r["frame"] != at:
                    at, data = r["frame"], reader.frame(r["frame"])
                yield pa.RecordBatch.from_arrays([pa.array([r["page_id"]], pa.int64()), pa.array([data[r["offset"] : r["offset"] + r["length"]]], pa.binary())], names=["page_id", "record"])
        if reader:
            reader.close()

    return index.where(ids).repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(read, "page_id long, record binary")
