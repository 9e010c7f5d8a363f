"""WARC archives with dictionary-compressed records.

Every page becomes a record. Of equal payloads of at least `least_bytes` bytes the one with the smallest page_id is a
response, the others are revisits that refer to it and carry no payload. A task trains a Zstandard dictionary on the first
records of its archive, writes it in a skippable frame at the file's start, and compresses each record as a frame of its
own against it; so a reader can start at any record. Archives become visible when complete, under names that a second
attempt of the task repeats. Training looks at the first 16,384 bytes of each record of the archive's first MB; the records
themselves are written whole.

Cases: a null html is an empty payload; empty and short payloads are always responses. Rows that repeat a page_id with
equal payloads are records of their own: each row that has the smallest page_id is a response. A null page_id is larger
than any other; if no equal payload has a page_id, all are responses. Columns other than page_id, url and html aren't read.
A payload of any length is one record, which is held whole while it is written or read. An empty table gives no archive
and an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylens.llm.common import materialise, shared_folder, text_blocks
from quaylens.llm.files import AtomicFile, open_input

#: The magic number of the frame that holds a dictionary, and the start of any Zstandard frame.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
LEAST_BYTES, DICTIONARY_BYTES, TRAINING_BYTES, LEVEL = 100, 32_768, 1 << 20, 3
#: bytes of a record that the training of a dictionary looks at (the record itself is written whole), and bytes read at a time
SAMPLE_BYTES, READ_BYTES = 16_384, 1 << 20
END = b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its payload's length and digest stand in its header."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{digest}|{kind}")
    block = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}|{digest}|response')}>", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + END + block + END


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != END:
        raise ValueError("a WARC record doesn't end where its length says")
    return fields, rest[:size]


class Archive:
    """Collects records, trains the dictionary on the first of them, then writes each as it comes."""

    def __init__(self, folder: str, name: str) -> None:
        self.folder, self.name = folder, name
        self.waiting: list[bytes] = []
        self.held = self.records = 0
        self.file: AtomicFile | None = None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.file is not None:
            self.file.write(self.press.compress(data))
            return
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= TRAINING_BYTES:
            self._start()

    def _start(self) -> None:
        samples = [x[:SAMPLE_BYTES] for x in self.waiting]
        try:
            book = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, d=8, k=512, steps=1).as_bytes()
        except zstandard.ZstdError:  # too few or too small records to train on: they serve as they are
            book = b"".join(samples)[-DICTIONARY_BYTES:]
        self.file = AtomicFile(self.folder, self.name)
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(book)
        self.file.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(book), write_checksum=True)
        for data in self.waiting:
            self.file.write(self.press.compress(data))
        self.waiting = []

    def close(self) -> None:
        if self.file is None:
            self._start()
        self.file.close()


def records_of(source: BinaryIO) -> Iterator[bytes]:
    """The records of an archive: the dictionary frame first, then a frame for each. Holds a part of the file and one record at a time."""
    head = source.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive has no dictionary frame")
    book = source.read(size)
    if book[:4] == ZSTD_FRAME:
        book = zstandard.ZstdDecompressor().decompress(book)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(book))
    rest = source.read(READ_BYTES)
    while rest:
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                break
            rest = source.read(READ_BYTES)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)
        rest = frame.unused_data or source.read(READ_BYTES)


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives; returns their manifest: folder, file, records, bytes."""
    spark = pages.sparkSession
    out = folder or shared_folder(spark, "warc")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    rows = rows.withColumn("digest", digest)
    long_enough = F.octet_length("html") >= least_bytes
    first = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("digest").alias("_same"), "first")
    # the join is on the pages' side large and skewed where many pages are equal; that side can be split
    known = rows.join(first, (F.col("digest") == F.col("_same")) & long_enough, "left").select("page_id", "url", "html", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}.warc.zst"
        archive = None
        for block in text_blocks(batches, "html"):
            archive = archive or Archive(out, name)
            for page_id, url, html, sha, first_id in zip(*(c.to_pylist() for c in block.columns), strict=True):
                again = first_id is not None and page_id != first_id
                archive.add(record(page_id, url, html.encode("utf-8"), sha, "revisit" if again else "response", first_id if again else None))
        if archive is not None:
            archive.close()
            yield pa.RecordBatch.from_arrays([pa.array([out]), pa.array([name]), pa.array([archive.records], pa.int64()), pa.array([archive.file.size], pa.int64())], names=["folder", "file", "records", "bytes"])

    return materialise(known.mapInArrow(run, "folder string, file string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null in revisits) of every record of the archives.

    Payloads are held against their digests; a record that doesn't match raises an error. There are as many tasks as archives.
    """

    def opened(folder: str, file: str) -> Iterator[bytes]:
        with open_input(folder, file) as source:
            yield from records_of(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, file in zip(batch.column("folder").to_pylist(), batch.column("file").to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                for piece in opened(folder, file):
                    fields, block = parse(piece)
                    sha = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    again = fields["WARC-Type"] == "revisit"
                    if not again and (hashlib.sha256(block).hexdigest() != sha or len(block) != int(fields["X-Payload-Length"])):
                        raise ValueError(f"{file}: a payload doesn't match its digest")
                    number = lambda x: int(x) if x not in ("", "None") else None
                    rows.append((number(fields["X-Page-Id"]), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), sha, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-Id", "")), None if again else block))
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    archives = max(1, manifest.count())
    return manifest.repartitionByRange(archives, "file").mapInArrow(run, f"page_id {id_type}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
