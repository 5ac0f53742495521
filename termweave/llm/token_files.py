"""Binary token files of patched frame-of-reference blocks, written by tasks and read back.

A file is: magic, then blocks of at most 4096 ids, then the document index, then the block index and a tail. A block is its width
(1 byte), minimum (4), number of ids (4), number of exceptions (4), the ids less the minimum packed at that width, and the exceptions
as places (4 each) and values (4 each). The document index has doc_ids (8 each), a bit for each that is null, and the documents'
lengths in the same kind of blocks; the block index has the start of each id block (8 each) and of each length block. The tail holds
the numbers of id blocks, length blocks, ids and documents (8 each), the start of the document index (8), and the magic again.
A file ends at FILE_IDS ids or FILE_DOCS documents, so files, and what reading one holds, do not grow with the input.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, opened, scratch, written
from .encode import WordEncoder, default_tokenizer

MAGIC = b"TWPF0002"
BLOCK = 4096
FILE_IDS, FILE_DOCS = 16 << 20, 1 << 20
TAIL = struct.Struct("<QQQQQ8s")
RANGE_DOCS = 8192  # documents of one record batch that is read
PERCENTILE = 99  # an exception costs eight bytes
HEAD = struct.Struct("<BIII")


def pack_block(ids: np.ndarray) -> bytes:
    """One block: the width holds PERCENTILE of the ids or more, the rest are exceptions."""
    low = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(low)
    width = int(np.partition(rest, (len(rest) - 1) * PERCENTILE // 100)[(len(rest) - 1) * PERCENTILE // 100]).bit_length()
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    values = rest[out]
    rest[out] = 0
    if width == 16:
        body = rest.astype("<u2").tobytes()
        return HEAD.pack(width, low, len(ids), len(out)) + body + out.astype("<u4").tobytes() + values.astype("<u4").tobytes()
    bits = ((rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8) if width else np.zeros(0, np.uint8)
    return HEAD.pack(width, low, len(ids), len(out)) + np.packbits(bits.ravel(), bitorder="little").tobytes() + out.astype("<u4").tobytes() + values.astype("<u4").tobytes()


def unpack_block(data: bytes) -> np.ndarray:
    width, low, n, z = HEAD.unpack_from(data)
    body = (n * width + 7) // 8
    at = HEAD.size + body
    if width == 16:
        ids = np.frombuffer(data, "<u2", n, HEAD.size).astype(np.uint32)
    elif width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, body, HEAD.size), bitorder="little", count=n * width).reshape(n, width)
        pad = np.zeros((n, 32), np.uint8)
        pad[:, :width] = bits
        ids = np.packbits(pad, axis=1, bitorder="little").view("<u4").ravel().copy()
    else:
        ids = np.zeros(n, np.uint32)
    ids[np.frombuffer(data, "<u4", z, at)] = np.frombuffer(data, "<u4", z, at + 4 * z)
    return ids + np.uint32(low)


class Writer:
    """Streams ids into one file; memory holds a block and the document index."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.starts, self.at, self.n, self.rest = fs.open_output_stream(path), array("Q"), len(MAGIC), 0, np.zeros(0, np.uint32)
        self.docs, self.nulls, self.lens = array("q"), bytearray(), array("I")
        self.out.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        data = pack_block(ids)
        self.starts.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def add(self, docs: list[int | None], lens: list[int], ids: np.ndarray) -> None:
        """Documents, their lengths and all their ids, one after the other."""
        self.docs.extend(d or 0 for d in docs)
        self.nulls.extend(d is None for d in docs)
        self.lens.extend(lens)
        self.n += len(ids)
        ids = np.concatenate((self.rest, ids))
        whole = len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._block(ids[i : i + BLOCK])
        self.rest = ids[whole:]

    @property
    def full(self) -> bool:
        return self.n >= FILE_IDS or len(self.docs) >= FILE_DOCS

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        n_blocks, index = len(self.starts), self.at
        body = np.array(self.docs, "<i8").tobytes() + np.packbits(np.frombuffer(bytes(self.nulls), np.uint8)).tobytes()
        self.out.write(body)
        self.at += len(body)
        lens = np.array(self.lens, np.uint32)
        for i in range(0, len(lens), BLOCK):
            self._block(lens[i : i + BLOCK])
        self.out.write(np.array(self.starts, "<u8").tobytes() + TAIL.pack(n_blocks, len(self.starts) - n_blocks, self.n, len(lens), index, MAGIC))
        self.out.close()


class TokenFile:
    """A token file, open: its document index (doc_ids, null marks, lengths), and ids from any block on."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        n_blocks, n_lens, self.ids, n, index, magic = TAIL.unpack(self.f.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a token file")
        end = size - TAIL.size - 8 * (n_blocks + n_lens)
        starts = np.frombuffer(self.f.read_at(8 * (n_blocks + n_lens), end), "<u8").astype(np.int64)
        self.starts = np.append(starts[:n_blocks], index)
        body = self.f.read_at(end - index, index)
        self.docs = np.frombuffer(body, "<i8", n)
        self.nulls = np.unpackbits(np.frombuffer(body, np.uint8, (n + 7) // 8, 8 * n), count=n).astype(bool)
        self.lens = np.concatenate([np.zeros(0, np.int64), *[unpack_block(body[a - index :]).astype(np.int64) for a in starts[n_blocks:].tolist()]])
        self.firsts = np.cumsum(self.lens) - self.lens

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.f.close()

    def blocks(self, first: int = 0) -> Iterator[np.ndarray]:
        for i in range(first, len(self.starts) - 1):
            yield unpack_block(self.f.read_at(int(self.starts[i + 1] - self.starts[i]), int(self.starts[i])))

    def parts(self, first: int = 0) -> Iterator[Iterator[np.ndarray]]:
        """For each document from place `first` on its ids, in pieces of at most a block; only blocks that hold them are read."""
        if first >= len(self.lens):
            return
        skip = int(self.firsts[first])
        source, have = self.blocks(skip // BLOCK), np.zeros(0, np.uint32)
        if skip % BLOCK:
            have = next(source)[skip % BLOCK :]

        def one(need: int) -> Iterator[np.ndarray]:
            nonlocal have
            while need:
                if not len(have):
                    have = next(source)
                part, have = have[:need], have[need:]
                need -= len(part)
                yield part

        for n in self.lens[first:].tolist():
            yield one(n)

    def document(self, place: int) -> np.ndarray:
        """All ids of one document."""
        return np.concatenate([np.zeros(0, np.uint32), *next(self.parts(place))])


def _write(folder: str, path: str, end: int):
    names = ["uri", "nulls", "first", "task", "seq", "ids", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.get(path)
        last = np.array([end], encoder.dtype).tobytes()
        task, uri, writer, seq, lead = uuid.uuid4().hex, "", None, 0, None

        def done() -> pa.RecordBatch:
            writer.close()
            return pa.record_batch([pa.array([uri]), pa.array([lead is None]), pa.array([lead], pa.int64()), pa.array([task]), pa.array([seq], pa.int64()), pa.array([writer.n], pa.int64()), pa.array([len(writer.docs)], pa.int64())], names=names)

        for batch in batches:
            texts, docs = batch["text"].fill_null("").cast(pa.binary()), batch["doc_id"]
            for i in range(0, len(texts), 256):
                some = docs[i : i + 256].to_pylist()
                if not writer:
                    lead = some[0] if not seq else lead
                    uri = f"{folder}/{task}-{seq}.tok"
                    writer = Writer(uri)
                ids = [x + last for x in encoder.encode(texts[i : i + 256].to_pylist())]
                writer.add(some, [len(x) // encoder.dtype.itemsize for x in ids], np.frombuffer(b"".join(ids), encoder.dtype).astype(np.uint32))
                if writer.full:
                    yield done()
                    writer, seq = None, seq + 1
        if writer:
            yield done()

    return run


def write_token_files(docs: DataFrame, path: str | None = None, end: int = 1, folder: str | None = None) -> DataFrame:
    """Encodes every text, appends `end`, and writes files in ascending doc_id order (null ids first); returns the manifest.

    Manifest: uri, start (ids of all files before it), ids, docs (their number). doc_ids and lengths are in the files. A task writes
    under a fresh name and reports it, so a repeated attempt leaves unlisted files and never a wrong one. Null and empty texts give
    the end id alone; a long text is streamed into blocks; rows that share a doc_id are ordered by text, so reruns agree; repeated
    rows are written as often as they come; an empty table gives no file; other columns, of any name, are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    path = path or default_tokenizer()
    folder = folder or scratch(spark, "tokens")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # ranges are chosen from doc_id alone, so texts are encoded once, where they are written
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = rows.mapInArrow(_write(folder, path, end), "uri string, nulls boolean, first long, task string, seq long, ids long, docs long")
    files = written(files, "token-manifest")
    # one row a file, whatever the documents: files of a task follow each other, tasks go by their first doc_id
    before = Window.orderBy(F.col("nulls").desc(), "first", "task", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("uri", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    return files.join(starts, "uri").select("uri", "start", "ids", "docs")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "last_id"]
    for batch in batches:
        for uri, start in zip(batch["uri"].to_pylist(), batch["start"].to_pylist(), strict=True):
            with TokenFile(uri) as file:
                found = file.parts()
                for a in range(0, len(file.lens), RANGE_DOCS):
                    b = min(a + RANGE_DOCS, len(file.lens))
                    crcs, lasts = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                    for i in range(b - a):
                        crc, last = 0, -1
                        for part in next(found):
                            crc, last = zlib.crc32(part.astype("<u4").tobytes(), crc), int(part[-1])
                        crcs[i], lasts[i] = crc, last
                    yield pa.record_batch([pa.array(file.docs[a:b], mask=file.nulls[a:b]), pa.array(start + file.firsts[a:b]), pa.array(file.lens[a:b]), pa.array(crcs), pa.array(lasts)], names=names)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, last_id) of each document, all from the files; start counts from the first file on."""
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("uri", "start").repartition(parts, "uri").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, last_id long")
