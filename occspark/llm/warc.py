"""WARC archives with a Zstandard dictionary in front, after the public warc.zst layout.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary built
from its own first records; every record follows as a frame of its own, so a reader can
start at any record. Records of equal payloads are revisits of one response.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path, stored

#: An archive is closed when its frames pass this size.
ARCHIVE_BYTES = 64 << 20
#: Records that the dictionary is built from: the first ones, up to so many bytes.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: Compressed bytes decoded at a time.
_STEP = 16 << 10
_SKIPPABLE = 0x184D2A5D
_FULL_DICTIONARY = b"\x37\xa4\x30\xec"
_PREFIX = "urn:page:"
_NO_ID = "none"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit without, which names its response."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_PREFIX}{_NO_ID if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.encode("unicode_escape").decode())
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_PREFIX}{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record, as :func:`record` wrote them; payload_bytes is the full payload's."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda x: None if x == _NO_ID else int(x)
    name = lambda x: number(x.strip("<>").removeprefix(_PREFIX))
    payload = body[: int(fields["Content-Length"])]
    return {"page_id": name(fields["WARC-Record-ID"]), "payload": payload, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "record_type": fields["WARC-Type"], "refers_to": name(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None}


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from records. Too few or too small ones to train on are one themselves."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


def _loaded(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw, zstandard.DICT_TYPE_FULLDICT if raw.startswith(_FULL_DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes archives below a folder that tasks share; a file appears under its name only when it is whole."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.sink = None
        self.waiting: list[bytes] = []
        self.waiting_bytes = 0

    def add(self, data: bytes) -> str | None:
        """Takes a record; gives the name of an archive that this one filled."""
        if self.sink is None:
            self.waiting.append(data)
            self.waiting_bytes += len(data)
            if self.waiting_bytes >= SAMPLE_BYTES:
                self._open()
            return None
        self._frame(data)
        return self.close() if self.size >= ARCHIVE_BYTES else None

    def _open(self) -> None:
        raw = dictionary(self.waiting)
        self.name = f"part-{uuid.uuid4().hex}.warc.zst"
        self.sink = self.fs.open_output_stream(f"{self.path}/_{self.name}", compression=None)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(raw)) + raw)
        self.size = 8 + len(raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_loaded(raw))
        for data in self.waiting:
            self._frame(data)
        self.waiting, self.waiting_bytes = [], 0

    def _frame(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.sink.write(frame)
        self.size += len(frame)

    def close(self) -> str | None:
        """Ends the archive at hand, if there is any, and gives its name."""
        if self.sink is None:
            if not self.waiting:
                return None
            self._open()
        self.sink.close()
        self.sink = None
        self.fs.move(f"{self.path}/_{self.name}", f"{self.path}/{self.name}")
        return self.name


def records_of(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    view = memoryview(archive)
    magic, size = struct.unpack_from("<II", view)
    if magic != _SKIPPABLE:
        raise ValueError("no dictionary frame")
    context = zstandard.ZstdDecompressor(dict_data=_loaded(bytes(view[8 : 8 + size])))
    rest = view[8 + size :]
    while len(rest):
        one = context.decompressobj()
        parts = []
        while not one.eof:  # a step at a time: unused_data copies no more than one step's rest
            step, rest = rest[:_STEP], rest[_STEP:]
            if not len(step):
                raise ValueError("archive is cut off")
            parts.append(one.decompress(step))
            if one.eof and one.unused_data:
                back = len(one.unused_data)
                rest = view[len(view) - len(rest) - back :]
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(archive, records) of the archives of ``pages`` (page_id, url, html), written below ``folder``.

    Payload: the html in UTF-8, empty if null. Of equal payloads the one of largest page_id
    (null least) is the response and the others revisit it; a repeated row of that page_id is
    a response too. A payload's other columns play no part. No pages give no archives.
    """
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    thin = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("print", F.sha1("payload"))
    # repeated payloads alone: a small table as a rule, and one row for each however often it occurs
    groups = thin.groupBy("print").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("response"))
    repeated = stored(groups.where("copies > 1").select(F.col("print").alias("seen"), "response"), "repeated")
    tops = thin.join(repeated, (F.col("print") == F.col("seen")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, count, done = ArchiveWriter(folder), 0, []
        for batch in batches:
            for page_id, url, body, response, copies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = copies is None or page_id == response
                refers = None if own else (_NO_ID if response is None else str(response))
                name = writer.add(record(page_id, url, body, payload_digest(body), refers))
                count += 1
                if name:
                    done.append((name, count))
                    count = 0
        if name := writer.close():
            done.append((name, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names=["archive", "records"])

    return stored(tops.select("page_id", "url", "payload", "response", "seen").mapInArrow(run, "archive string, records long"), "archives")


def read_archives(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, stored_bytes) of every record of the listed archives.

    Only archives that the writer's table names are read: files of lost or repeated tasks
    aren't in it. The digest of a stored payload is computed anew and must be the recorded one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder)
    named = files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(archives.select("archive"), "archive", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_bytes"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for data in records_of(content.as_py()):
                    x = parse(data)
                    if x["record_type"] == "response" and (payload_digest(x["payload"]) != x["payload_digest"] or len(x["payload"]) != x["payload_bytes"]):
                        raise ValueError(f"record of page {x['page_id']} is damaged")
                    rows.append((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"], len(x["payload"])))
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return named.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, stored_bytes long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    folder = new_path(spark, "warc")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
