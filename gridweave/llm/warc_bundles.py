"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some whole records, and a seek table in a
skippable frame at the end, which plain decoders pass over. The index names for each record its bundle, its
frame and its offset in the decompressed frame, so that one record costs one seek and one frame. Records of
equal payload are written once: the one with the largest key is the response, others are revisits of it.

Tasks write bundles under names of their own and tell of them only when they are closed. A task that is run
again leaves a file that no index row names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import settle, shared_folder

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
BUNDLES_A_TASK = 8
WRITE_BYTES = 1 << 20
LEVEL = 3
# Fixed values of the seekable format: number of the skippable frame, mark of the footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = pa.schema(
    [("key", pa.int64()), ("ordinal", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_at", pa.int64()), ("frame_bytes", pa.int64()), ("record_at", pa.int64()), ("record_bytes", pa.int64())]
)
_INDEX_SQL = "key bigint, ordinal bigint, bundle string, frame int, frame_at bigint, frame_bytes bigint, record_at bigint, record_bytes bigint"
RECORD = pa.schema(
    [("key", pa.int64()), ("ordinal", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)
_RECORD_SQL = "key bigint, ordinal bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file named by a URI or a path."""
    if re.match(r"file:/[^/]", folder):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _named(key: int | None, ordinal: int) -> str:
    return f"<urn:record:{'' if key is None else key}:{ordinal}>"


def _unnamed(name: str) -> tuple[int | None, int]:
    key, ordinal = name.strip("<>").split(":")[2:]
    return int(key) if key else None, int(ordinal)


def record_head(row: dict, date: str) -> bytes:
    """Everything of a record before the payload; a revisit has no payload after it."""
    size = row["n_bytes"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = row["refers_ordinal"] is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _named(row["key"], row["ordinal"])), ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(row["digest"]).decode()), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + (0 if revisit else size)),
    ]
    if row["url"] is not None:  # a field is one line
        fields.insert(2, ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", row["url"])))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _named(row["refers_to"], row["refers_ordinal"]))]
    return "WARC/1.1\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + http


class BundleWriter:
    """Frames of records in one file, and the seek table behind them."""

    def __init__(self, out, frame_bytes: int, level: int) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.context = zstandard.ZstdCompressor(level=level)
        self.frame = None
        self.at = self.plain = 0
        self.table: list[tuple[int, int]] = []

    def add(self, parts: Iterable[bytes]) -> tuple[int, int, int]:
        """Write a record in parts; its frame, offset and length there."""
        if self.frame is None:
            self.frame, self.begun, self.plain = self.context.compressobj(), self.at, 0
        start = self.plain
        for part in parts:
            for lo in range(0, len(part), WRITE_BYTES):
                self._put(self.frame.compress(part[lo : lo + WRITE_BYTES]))
            self.plain += len(part)
        place = len(self.table), start, self.plain - start
        if self.plain >= self.frame_bytes:
            self.end_frame()
        return place

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.at += len(data)

    def end_frame(self) -> None:
        if self.frame is not None:
            self._put(self.frame.flush())
            self.table.append((self.at - self.begun, self.plain))
            self.frame = None

    def close(self) -> None:
        self.end_frame()
        entries = b"".join(struct.pack("<II", *sizes) for sizes in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, FOOTER)
        self._put(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, frame_bytes: int, bundle_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    store, base = opened(folder)
    writer, rows, path = None, [], ""

    def closed() -> pa.RecordBatch:
        writer.close()
        starts = [0]
        for size, _ in writer.table:
            starts.append(starts[-1] + size)
        told = [{"key": k, "ordinal": o, "bundle": path, "frame": f, "frame_at": starts[f], "frame_bytes": writer.table[f][0], "record_at": at, "record_bytes": n} for k, o, f, at, n in rows]
        return pa.RecordBatch.from_pylist(told, INDEX)

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if writer is None:
                name, rows = f"{uuid.uuid4().hex}.warc.zst", []
                path = f"{folder}/{name}"
                writer = BundleWriter(store.open_output_stream(f"{base}/{name}", compression=None), frame_bytes, level)
                writer.add([f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n".encode()])
            payload = row["payload"] if row["refers_ordinal"] is None else b""
            rows.append((row["key"], row["ordinal"], *writer.add([record_head(row, date), payload, b"\r\n\r\n"])))
            if writer.at >= bundle_bytes:
                yield closed()
                writer = None
    if writer is not None:
        yield closed()


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of each frame of an open bundle."""
    source.seek(size - 9)
    frames, descriptor, mark = struct.unpack("<IBI", source.read(9))
    if mark != FOOTER:
        raise ValueError("the file has no seek table")
    width = 12 if descriptor & 0x80 else 8
    source.seek(size - 9 - width * frames)
    entries, at, table = source.read(width * frames), 0, []
    for i in range(frames):
        packed, plain = struct.unpack_from("<II", entries, width * i)
        table.append((at, packed, plain))
        at += packed
    return table


def records_of(frame: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Fields and block of each record of a decompressed frame."""
    at, view = 0, memoryview(frame)
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        version, *lines = frame[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError("no record begins here")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        yield fields, view[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _record(fields: dict[str, str], block: memoryview, with_payload: bool) -> dict:
    """One row; the digest and length of a response are those of the payload as read, a revisit's are in its fields."""
    head = bytes(block[:4096]).index(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", bytes(block[: head + 2])).group(1))
    key, ordinal = _unnamed(fields["WARC-Record-ID"])
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if fields["WARC-Type"] == "response":
        payload = bytes(block[head + 4 :])
        if len(payload) != size or bare_digest(payload) != told:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not the one its record tells of")
    refers_to = _unnamed(fields["WARC-Refers-To"])[0] if "WARC-Refers-To" in fields else None
    return {"key": key, "ordinal": ordinal, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": refers_to, "payload_bytes": size, "payload_digest": told, "payload": payload if with_payload else None}


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    decoder = zstandard.ZstdDecompressor()
    for batch in batches:
        for path in batch.column("bundle").to_pylist():
            store, name = opened(path)
            with store.open_input_file(name) as source:
                for at, packed, plain in seek_table(source, source.size()):
                    source.seek(at)
                    frame = decoder.decompress(source.read(packed), max_output_size=plain)
                    found = [_record(fields, block, with_payload) for fields, block in records_of(frame) if fields["WARC-Type"] in ("response", "revisit")]
                    yield pa.RecordBatch.from_pylist(found, RECORD)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decoder, last, frame = zstandard.ZstdDecompressor(), None, b""
    for batch in batches:
        for r in batch.to_pylist():
            if (r["bundle"], r["frame"]) != last:
                store, name = opened(r["bundle"])
                with store.open_input_file(name) as source:
                    source.seek(r["frame_at"])
                    with decoder.stream_reader(source.read(r["frame_bytes"])) as plain:
                        frame = plain.readall()
                last = r["bundle"], r["frame"]
            [(fields, block)] = records_of(frame[r["record_at"] : r["record_at"] + r["record_bytes"]])
            yield pa.RecordBatch.from_pylist([_record(fields, block, True)], RECORD)


def write_bundles(
    pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z",
    frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL,
) -> DataFrame:
    """Write a record for each row into bundles below `folder`, and return the settled index of the records.

    Payloads are UTF-8, null is empty. Of rows with equal payloads of at least `least` bytes the one with the
    largest key is the response (of equal keys the last row; null keys come first); the others revisit it.
    Shorter payloads are all responses. Rows are told apart by their place in `pages`, which has to be the same
    when a task is run again: a table read from files, or a settled one. An empty table writes nothing.
    `folder` is a URI that all executors can write to; by default it lies in the folder for checkpoints.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/bundles-{uuid.uuid4().hex}"
    store, base = opened(folder)
    store.create_dir(base)
    data = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"), F.unhex(F.sha1(data)).alias("digest"), F.octet_length(data).cast("bigint").alias("n_bytes"), F.monotonically_increasing_id().alias("ordinal"), data.alias("payload"))
    place = F.struct(F.col("key").isNotNull(), F.col("key"), F.col("ordinal"))
    facts = rows.where(F.col("n_bytes") >= least).groupBy("digest", "n_bytes").agg(F.max(place).alias("response"))
    # Facts are one row for each payload: a payload that many rows have is skewed on the other side only.
    placed = rows.join(facts.hint("shuffle_hash"), ["digest", "n_bytes"], "left")
    revisits = F.col("response.ordinal") != F.col("ordinal")
    told = placed.select(
        "key", "ordinal", "url", "digest", "n_bytes", F.when(revisits, F.col("response.key")).alias("refers_to"), F.when(revisits, F.col("response.ordinal")).alias("refers_ordinal"),
        F.when(revisits, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )
    return settle(told.mapInArrow(partial(_write, folder=folder, date=date, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes, level=level), _INDEX_SQL))


def read_bundles(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the bundles that an index names, frame by frame along their seek tables.

    Payloads are checked against length and digest; a record that does not hold fails.
    """
    paths = index.select("bundle").distinct()
    # A path is a short row for much work: without a number of its own the exchange would end up in one task.
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), paths.count() // BUNDLES_A_TASK)
    return paths.repartition(tasks).mapInArrow(partial(_read, with_payload=with_payload), _RECORD_SQL)


def fetch_records(wanted: DataFrame) -> DataFrame:
    """The records of some index rows; each frame is read once, at its offset."""
    return wanted.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "record_at").mapInArrow(_fetch, _RECORD_SQL)


def archive_digest(pages: DataFrame) -> DataFrame:
    """Per row of `pages`, as read back from its bundles: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    read = read_bundles(write_bundles(pages), with_payload=False)
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
