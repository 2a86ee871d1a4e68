"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each task writes archives of its rows: the dictionary is trained on the first records, stored in
a leading skippable frame, and every record is one frame, so a record can be read by itself.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import saved, shared_path
from riskgraph.operators.small import broadcast_when_small

# Magic of the dictionary frame, revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100
DICTIONARY_BYTES = 112_640
# The dictionary is trained on the first records up to these bounds.
SAMPLE_RECORDS, SAMPLE_BYTES = 2_000, 8 << 20
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 16

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def with_record_type(pages: DataFrame) -> DataFrame:
    """Payload digest, and whether the page is stored in full or refers to an equal one.

    ``html`` null counts as empty. Of payloads of at least 100 bytes that are equal, every row
    with the smallest page id is a response (rows repeating that id too) and the others revisit
    it; if no such row has an id all are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    repeated = (
        rows.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    joined = rows.join(broadcast_when_small(repeated, 100_000), "payload_digest", "left")
    again = F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    return joined.select(
        *rows.columns,
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("kept_id")).alias("refers_to"),
    )


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit leaves the payload out."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest} {kind}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    body = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = _UNSAFE.sub(lambda m: "%%%02X" % ord(m.group()), url)
        head.append(f"WARC-Target-URI: {safe}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append("Content-Type: application/http; msgtype=response")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a record; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if len(body) != int(fields["Content-Length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    http, _, payload = body.partition(b"\r\n\r\n")
    stated = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload does not match its digest")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return {
        "page_id": None if page is None else int(page),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": stated,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": None if refers is None else int(refers),
    }


def train(samples: list[bytes]) -> zstd.ZstdCompressionDict | None:
    """Dictionary of the sampled records; their plain content where there is too little to train."""
    total = sum(map(len, samples))
    if total == 0:
        return None
    try:
        return zstd.train_dictionary(max(256, min(DICTIONARY_BYTES, total // 8)), samples)
    except zstd.ZstdError:
        plain = b"".join(samples)[-DICTIONARY_BYTES:]
        return zstd.ZstdCompressionDict(plain, dict_type=zstd.DICT_TYPE_RAWCONTENT)


class _Archive:
    """An archive under a temporary name that gets its own name once it is complete."""

    def __init__(self, folder: str, name: str, dictionary: zstd.ZstdCompressionDict | None):
        self._fs, root = pa.fs.FileSystem.from_uri(folder)
        self.name, self.records, self.bytes = name, 0, 0
        self._final = f"{root}/{name}"
        self._temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
        self._fs.create_dir(root, recursive=True)
        self._out = self._fs.open_output_stream(self._temporary, compression=None)
        self._writer = zstd.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        if dictionary is not None:
            content = dictionary.as_bytes()
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self.bytes += len(data)

    def add(self, raw: bytes) -> None:
        self._put(self._writer.compress(raw))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self._out.close()
        self._fs.move(self._temporary, self._final)
        return self.name, self.records, self.bytes


def _uri(folder: str) -> str:
    return folder if re.match(r"\w+:", folder) else f"file://{folder}"


ARCHIVES = "folder string, name string, records long, bytes long"


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """Write records to ``folder`` (a path all executors share); one row per archive.

    A task that is run again writes the same archive under the same name; a file becomes visible
    only when complete.
    """
    import pyarrow.fs  # noqa: F401

    folder = _uri(folder)
    columns = ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs  # noqa: F401

        part = TaskContext.get().partitionId()
        waiting, size, archive, dictionary, done = [], 0, None, None, []

        def opened() -> _Archive:
            return _Archive(folder, f"part-{part:06d}-{len(done):04d}.warc.zst", dictionary)

        def put(raw: bytes) -> None:
            nonlocal archive
            if archive.bytes >= ARCHIVE_BYTES:
                done.append(archive.close())
                archive = opened()
            archive.add(raw)

        def start() -> None:
            nonlocal archive, dictionary
            dictionary = train(waiting)
            archive = opened()
            for raw in waiting:
                put(raw)
            waiting.clear()

        for batch in batches:
            for row in zip(*(batch[c] for c in columns)):
                raw = record(*(x.as_py() for x in row))
                if archive is not None:
                    put(raw)
                    continue
                waiting.append(raw)
                size += len(raw)
                if len(waiting) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
                    start()
        if waiting:
            start()
        if archive is not None:
            done.append(archive.close())
        names, records, sizes = (list(x) for x in zip(*done)) if done else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([folder] * len(done), pa.string()), pa.array(names, pa.string()),
                pa.array(records, pa.int64()), pa.array(sizes, pa.int64()),
            ],
            names=["folder", "name", "records", "bytes"],
        )

    return typed.select(*columns).mapInArrow(run, ARCHIVES)


def _frames(stream, rest: bytes, reader: zstd.ZstdDecompressor) -> Iterator[bytes]:
    """Records of an archive, one at a time."""
    current, parts = reader.decompressobj(), []
    while True:
        data = rest or stream.read(READ_BYTES)
        rest = b""
        if not data:
            break
        parts.append(current.decompress(data))
        if current.eof:
            yield b"".join(parts)
            rest, current, parts = current.unused_data, reader.decompressobj(), []
    if any(parts):
        raise ValueError("an archive is cut off")


def read_archive(folder: str, name: str) -> Iterator[bytes]:
    import pyarrow.fs  # noqa: F401

    fs, root = pa.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
        head = stream.read(8)
        magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
        if magic == DICTIONARY_MAGIC:
            reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(stream.read(size)))
            yield from _frames(stream, b"", reader)
        else:
            yield from _frames(stream, head, zstd.ZstdDecompressor())


RECORDS = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives, read from their files; a revisit has no payload of its own."""
    names = [part.split()[0] for part in RECORDS.split(", ")]
    kinds = [
        pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names
            )

        for batch in batches:
            for folder, name in zip(batch["folder"].to_pylist(), batch["name"].to_pylist()):
                rows, size = [], 0
                for raw in read_archive(folder, name):
                    rows.append(parse_record(raw))
                    size += len(raw)
                    if size >= 4 << 20:
                        yield packed(rows)
                        rows, size = [], 0
                yield packed(rows)

    return archives.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    folder = shared_path(pages.sparkSession, "warc")
    archives = saved(write_archives(with_record_type(pages), folder))
    files = max(1, archives.count())
    return read_archives(archives.repartition(min(files, 10_000)))
