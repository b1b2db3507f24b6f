"""WARC archives in Zstandard, written and read.

An archive starts with a skippable frame that holds a dictionary, then has one frame per record, compressed with
it. The writer rolls an archive at ``ARCHIVE_BYTES`` of payload; files are named by task attempt, so a repeated attempt
never touches what another wrote, and the returned list of paths names the attempt that counts. The reader decodes
frame by frame, checks version, required headers, lengths and payload digests, and raises on the first that is wrong.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, that with the smallest page id is the response and the others
revisit it; rows that share this id are all responses, and null ids are larger than any. Null payloads count as empty. Line
breaks in a URL are escaped; a null URL has no header. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut, shared_folder

ARCHIVE_BYTES, MIN_REVISIT, DICT_BYTES, SAMPLES = 8 << 20, 100, 16 << 10, 128
# FIXED VALUES of the formats.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "2024-01-01T00:00:00Z"


def decide(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, payload_bytes, refers_to``; refers_to is null for responses."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    again = cut(rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("digest")
                .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    both = rows.join(again, "digest", "left")
    return both.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    headers = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": size, "Content-Type": "text/html; charset=utf-8",
    }
    if url is not None:
        headers["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
        payload = b""
    headers["Content-Length"] = len(payload)
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """One archive. Too few records for a dictionary give an empty one, and frames without it."""
    content = b""
    if len(records) >= 8:
        try:
            content = zstandard.train_dictionary(DICT_BYTES, records[:: max(1, len(records) // SAMPLES)]).as_bytes()
        except zstandard.ZstdError:  # the samples have nothing in common
            content = b""
    shared = zstandard.ZstdCompressionDict(content) if content else None
    writer = zstandard.ZstdCompressor(level=3, dict_data=shared)
    return struct.pack("<II", DICT_MAGIC, len(content)) + content + b"".join(writer.compress(r) for r in records)


def frames(read) -> Iterator[bytes]:
    """Decoded records of an archive; ``read(n)`` returns up to n more bytes."""
    def exactly(n: int) -> bytes:
        parts, missing = [], n
        while missing:
            part = read(missing)
            if not part:
                raise ValueError("archive ends inside its first frame")
            parts.append(part)
            missing -= len(part)
        return b"".join(parts)

    magic, size = struct.unpack("<II", exactly(8))
    if magic != DICT_MAGIC:
        raise ValueError("archive does not start with a dictionary frame")
    content = exactly(size)
    if content[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 28)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)
    data = b""
    while True:
        data = data or read(1 << 20)
        if not data:
            return
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if not data:
                data = read(1 << 20)
                if not data:
                    raise ValueError("archive ends inside a record")
            parts.append(frame.decompress(data))
            data = b""
        data = frame.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, after checks."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (VERSION, b"WARC/1.0"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"header without a colon: {name[:60]}")
        headers[name] = value.strip(" \t")
    for name in REQUIRED:
        if name not in headers:
            raise ValueError(f"record without {name}")
    length = headers["Content-Length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, the block has {len(rest) - 4}")
    return headers, rest[:-4]


def _location(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Write archives to ``folder``, which executors share, and return their paths as ``(path, records)``."""

    def written(batches):
        system, base = _location(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        records: list[bytes] = []
        size = number = 0

        def close():
            nonlocal records, size, number
            path = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            with system.open_output_stream(path) as out:
                out.write(pack(records))
            made = pa.RecordBatch.from_pydict({"path": [path], "records": [len(records)]})
            records, size, number = [], 0, number + 1
            return made

        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "digest", "payload_bytes", "refers_to")]):
                records.append(record(*[v.as_py() for v in row]))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if records:
            yield close()

    return cut(decided.select("page_id", "url", "payload", "digest", "payload_bytes", "refers_to").mapInArrow(written, "path string, records long"))


def read_archives(paths: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives that ``paths(path)`` lists, with the payload if asked for."""
    import hashlib

    def _id(value: str | None) -> int | None:
        text = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def rows(batches):
        system, _ = _location(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out: dict[str, list] = {c: [] for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
                held = 0
                with system.open_input_stream(path) as stream:
                    for data in frames(stream.read):
                        headers, block = parse(data)
                        kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                        if kind == "response" and digest != hashlib.sha256(block).hexdigest():
                            raise ValueError(f"payload digest of {headers['WARC-Record-ID']} is wrong")
                        values = (_id(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), int(headers.get("X-Payload-Length", len(block))), digest,
                                  kind, _id(headers.get("WARC-Refers-To")), block if payload else None)
                        for name, value in zip(out, values):
                            out[name].append(value)
                        held += len(block)
                        if held >= ARCHIVE_BYTES:
                            yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)
                            out, held = {c: [] for c in out}, 0
                if out["page_id"]:
                    yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

    return paths.select("path").mapInArrow(
        rows, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per page to fresh archives in the shared folder and read them back, without payloads."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    paths = write_archives(decide(pages), folder)
    return read_archives(paths, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
