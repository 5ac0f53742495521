"""Media columns: texts as lossless 8-bit grayscale images in archives, read by a Spark data source over byte ranges.

An archive is a plain ZIP file with stored members, each a PNG of 576-sample rows. The writer notes where a range of about
RANGE_BYTES ends, so the manifest holds the plan: the data source makes its partitions from the manifest's rows and opens no archive
for it. A folder without a manifest is planned from the archives' directories. Members are streamed as Arrow batches of bounded
size; each is read by its own offset and, on an error, again by itself; members before it are not read twice.
"""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import arrow_limits, opened, scratch, written

SIDE = 24
UNIT = SIDE * SIDE
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
PARTITIONS = 8192  # wanted of a scan; beyond, a partition takes runs of ranges
BATCH_BYTES = 4 << 20
_PNG = b"\x89PNG\r\n\x1a\n"
SCHEMA = "archive string, offset long, name string, media binary"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A grayscale image, rows of 576 samples."""
    rows = len(payload) // UNIT
    lines = np.zeros((rows, UNIT + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """Samples of an image that to_png made; checks every chunk's CRC."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, width, rows = 8, b"", 0, 0
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("chunk is damaged")
        if kind == b"IHDR":
            width, rows, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grayscale")
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written by this library")
    return lines[:, 1:].tobytes()


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


class ArchiveWriter:
    """A ZIP archive of stored members; memory holds its directory only. cuts: where ranges of about RANGE_BYTES start, and the end."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out, self.size, self.directory, self.n, self.cuts = uri, fs.open_output_stream(path), 0, [], 0, [0]

    def add(self, name: bytes, data: bytes) -> None:
        crc = zlib.crc32(data)
        if self.size - self.cuts[-1] >= RANGE_BYTES:
            self.cuts.append(self.size)
        self.out.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, 0x800, 0, 0, 33, crc, len(data), len(data), len(name), 0) + name + data)
        self.directory.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 20, 20, 0x800, 0, 0, 33, crc, len(data), len(data), len(name), 0, 0, 0, 0, 0, self.size) + name)
        self.size += 30 + len(name) + len(data)
        self.n += 1

    def close(self) -> None:
        self.cuts.append(self.size)
        body = b"".join(self.directory)
        self.out.write(body + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, self.n & 0xFFFF, self.n & 0xFFFF, len(body), self.size, 0))
        self.out.close()


def directory(uri: str) -> list[tuple[int, int, str]]:
    """(offset, bytes with header, name) of each member, from the end of the archive."""
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        sign, _, _, _, _, length, start, _ = struct.unpack("<IHHHHIIH", f.read_at(22, size - 22))
        if sign != 0x06054B50:
            raise ValueError(f"{uri}: no archive directory")
        body = f.read_at(length, start)
    out, at = [], 0
    while at < len(body):
        n, name, extra, comment = struct.unpack_from("<IHHH", body, at + 24)
        out.append((struct.unpack_from("<I", body, at + 42)[0], 30 + name + n, body[at + 46 : at + 46 + name].decode()))
        at += 46 + name + extra + comment
    return out


class ByteRanges(InputPartition):
    """Members of archives whose headers start in one of the ranges (uri, start, end)."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges

    @property
    def start(self) -> int:
        """Where the first range starts."""
        return self.ranges[0][1]

    @property
    def end(self) -> int:
        """Where the last range ends."""
        return self.ranges[-1][2]


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.range_bytes, self.tries = options["path"], int(options.get("range_bytes", RANGE_BYTES)), int(options.get("tries", 3))
        self.manifest, self.partitions_wanted = options.get("manifest"), int(options.get("partitions", PARTITIONS))

    def _dealt(self, archives: list[tuple[str, np.ndarray]]) -> list[ByteRanges]:
        """Partitions of the ranges between each archive's cuts: one each up to the number wanted, else runs of ranges, at most twice that many."""
        step = max(1, -(-sum(len(cuts) - 1 for _, cuts in archives) // self.partitions_wanted))
        out, held = [], step
        for uri, cuts in archives:
            for i in range(0, len(cuts) - 1, step):
                last = min(i + step, len(cuts) - 1)
                if held + last - i > step:
                    out.append(ByteRanges([]))
                    held = 0
                out[-1].ranges.append((uri, int(cuts[i]), int(cuts[last])))
                held += last - i
        return out or [ByteRanges([])]

    def partitions(self) -> list[ByteRanges]:
        """The manifest's ranges; without one, runs of members of about range_bytes from each archive's directory. The number of
        partitions is bounded, however many ranges there are."""
        from pyarrow import dataset
        from pyarrow import fs as pafs

        if self.manifest is not None:
            fs, path = opened(self.manifest)
            rows = dataset.dataset(path, filesystem=fs, format="parquet").to_table(columns=["uri", "cuts"])
            return self._dealt([(uri, c.values.to_numpy()) for uri, c in zip(rows["uri"].to_pylist(), rows["cuts"], strict=True)])
        fs, path = opened(self.folder)
        uris = sorted(f"{self.folder.rstrip('/')}/{i.base_name}" for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if i.base_name.endswith(".zip"))
        archives = []
        for uri in uris:
            cuts = [0]
            for at, n, _ in (members := directory(uri)):
                if at + n - cuts[-1] >= self.range_bytes:
                    cuts.append(at + n)
            if members and cuts[-1] < members[-1][0] + members[-1][1]:
                cuts.append(members[-1][0] + members[-1][1])
            archives.append((uri, np.array(cuts)))
        return self._dealt(archives)

    def _member(self, f, reopen, at: int):
        """(name, data, next offset); read again by itself after an error or a wrong checksum."""
        for left in range(self.tries - 1, -1, -1):
            try:
                sign, _, _, _, _, _, crc, n, _, name, extra = struct.unpack("<IHHHHHIIIHH", f.read_at(30, at))
                if sign != 0x04034B50:
                    raise OSError(f"no member at {at}")
                body = f.read_at(name + extra + n, at + 30)
                data = body[name + extra :]
                if len(data) != n or zlib.crc32(data) != crc:
                    raise OSError(f"member at {at} is damaged")
                return f, body[:name].decode(), data, at + 30 + name + extra + n
            except OSError:
                if not left:
                    raise
                time.sleep(0.1)
                f = reopen()
        raise AssertionError

    def read(self, part: ByteRanges) -> Iterator[pa.RecordBatch]:
        for uri, start, end in part.ranges:
            fs, path = opened(uri)
            reopen = lambda fs=fs, path=path: fs.open_input_file(path)
            f, at, rows, held = reopen(), start, [], 0
            while at < end:
                here = at
                f, name, data, at = self._member(f, reopen, at)
                rows.append((uri, here, name, data))
                held += len(data)
                if held >= BATCH_BYTES or at >= end:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["archive", "offset", "name", "media"])
                    rows, held = [], 0


class MediaSource(DataSource):
    """format("media_archive"): option path is a folder of archives, or manifest a table of them (see store)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


def _store(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None

        def done() -> pa.RecordBatch:
            writer.close()
            return pa.record_batch([pa.array([writer.uri]), pa.array([writer.n], pa.int64()), pa.array([writer.cuts], pa.list_(pa.int64()))], names=["uri", "members", "cuts"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].fill_null("").cast(pa.binary()).to_pylist(), strict=True):
                writer = writer or ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.zip")
                writer.add(f"{'null' if doc is None else doc}/{len(text)}/{writer.n}.png".encode(), to_png(payload_of(text)))
                if writer.size >= ARCHIVE_BYTES or writer.n >= 60_000:
                    yield done()
                    writer = None
        if writer:
            yield done()

    return run


def store(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes every text as one member; returns the manifest: uri, members, and cuts, the offsets that bound its ranges. Names are doc_id/bytes/place. A repeated attempt of a
    task leaves an unlisted archive."""
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(_store(folder or scratch(spark, "media")), "uri string, members long, cuts array<long>"), "media-manifest")


def load(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(archive, offset, name, media) of the archives of a manifest that store wrote; only the manifest's place goes into the plan."""
    arrow_limits(spark)
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").option("path", "").option("manifest", manifest._termweave_path).load()


def feature(payload: bytes) -> str:
    """Rows, mean, deviation and a 16-bin histogram of the samples, and the mean difference of neighbours."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    step = int(np.abs(np.diff(x.astype(np.int16))).sum())
    return f"{len(x) // UNIT}:{int(x.sum(dtype=np.int64)) * 1000 // len(x)}:{step * 1000 // len(x)}:" + ",".join(map(str, bins))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        rows = []
        for name, media in zip(batch["name"].to_pylist(), batch["media"].to_pylist(), strict=True):
            doc, n, _ = name.split("/")
            payload = from_png(media)
            rows.append((None if doc == "null" else int(doc), int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        if rows:
            types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every text, reads the archives back and digests what was read.

    Text bytes are padded with 255 to a positive multiple of 576, so null and empty texts are one row of 255s; a text of any length is
    one member. Repeated rows are stored each, equal texts alike; a null doc_id stays null; an empty table gives no archive and no
    row; other columns, of any name, are ignored.
    """
    return load(docs.sparkSession, store(docs)).mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
