"""Token counts by separator scan: flat, unindexed token files are read in blocks, each searched for the end-of-document id."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, opened, scratch, spread, written
from .encode import WordEncoder, default_tokenizer

BLOCK_BYTES = 4 << 20
FILE_BYTES = 64 << 20


def _flat(path: str, end: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.get(path, True)
        last = np.array([end], encoder.dtype).tobytes()
        uri, out, n, size = "", None, 0, 0
        for batch in batches:
            texts, docs = batch["text"].fill_null("").cast(pa.binary()), batch["doc_id"]
            for i in range(0, len(texts), 256):
                if out is None:
                    uri, n, size = f"{folder}/{uuid.uuid4().hex}.bin", 0, 0
                    fs, at = opened(uri)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at)
                data = b"".join(x + last for x in encoder.encode(texts[i : i + 256].to_pylist()))
                out.write(data)
                some = docs[i : i + 256].to_pylist()
                size += len(data)
                yield pa.record_batch([pa.array([uri]), pa.array([size], pa.int64()), pa.array([n], pa.int64()), pa.array([some], pa.list_(pa.int64()))], names=["uri", "bytes", "first", "docs"])
                n += len(some)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()

    return run


def write_flat(docs: DataFrame, path: str | None = None, end: int | None = None, folder: str | None = None) -> DataFrame:
    """Flat files of ids of about FILE_BYTES, each text followed by the end id, no index.

    Returns rows of at most 256 documents: uri, bytes (of the file so far), first (place of the first one in the file), docs.
    Special tokens' strings in a text are encoded as ordinary text, so the end id never comes from a text.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    path = path or default_tokenizer()
    end = end_id(path) if end is None else end
    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(_flat(path, end, folder or scratch(spark, "flat")), "uri string, bytes long, first long, docs array<long>"), "flat-manifest")


def end_id(path: str) -> int:
    return WordEncoder.get(path, True).tokenizer.token_to_id("<|endoftext|>")


def _scan(end: int, width: int):
    """Places of the end id in each block, counted from the start of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = opened(row["uri"])
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(row["size"], row["at"]), f"<u{width}")
                ends = np.flatnonzero(ids == end) + row["at"] // width
                yield pa.record_batch([pa.array([row["uri"]]), pa.array([row["at"]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))], names=["uri", "at", "ids", "n", "last", "ends"])

    return run


def count_tokens(files: DataFrame, end: int, width: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uri, ordinal, start, n_tokens) of each document in flat files (uri, bytes); n_tokens includes the end id.

    Blocks are searched apart from each other; a prefix scan over block summaries (documents before the block, last separator
    before it) stitches documents across boundaries, however many blocks they span. Ids after the last separator of a file are a
    document without an end (ordinal follows on). Empty files give no row.
    """
    spark = files.sparkSession
    block_bytes -= block_bytes % width
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    todo = files.where("bytes > 0").select("uri", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(block_bytes))).alias("at"))
    todo = todo.select("uri", "at", F.least(F.lit(block_bytes), F.col("bytes") - F.col("at")).alias("size"))
    found = written(todo.repartition(parts, "uri", "at").mapInArrow(_scan(end, width), "uri string, at long, ids long, n long, last long, ends array<long>"), "separators")
    before = Window.partitionBy("uri").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("uri")
    summary = found.select("uri", "at", "n", "last", "ids")
    summary = summary.select("uri", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last_before"), F.max("last").over(here).alias("file_last"), F.sum("ids").over(here).alias("file_ids"), F.sum("n").over(here).alias("file_docs"))
    rows = found.select("uri", "at", "ends").join(summary, ["uri", "at"])
    prior = F.concat(F.array("last_before"), F.slice("ends", 1, F.size("ends") - 1))
    docs = rows.where(F.size("ends") > 0).select("uri", "docs_before", F.posexplode(F.arrays_zip(F.col("ends").alias("e"), prior.alias("p"))).alias("k", "x"))
    docs = docs.select("uri", (F.col("docs_before") + F.col("k")).alias("ordinal"), (F.col("x.p") + 1).alias("start"), (F.col("x.e") - F.col("x.p")).alias("n_tokens"))
    open_ = summary.where("at = 0 and coalesce(file_last, -1) < file_ids - 1").select("uri", F.col("file_docs").alias("ordinal"), (F.coalesce("file_last", F.lit(-1)) + 1).alias("start"), (F.col("file_ids") - F.coalesce("file_last", F.lit(-1)) - 1).alias("n_tokens"))
    return docs.unionByName(open_)


def document_token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every text, counted in the flat files that it is written to; see write_flat and count_tokens.

    Null and empty texts have 1, the end id; a text longer than a block is stitched. Repeated rows are counted each; a null doc_id
    stays null; an empty table gives none; other columns, of any name, are ignored.
    """
    path = path or default_tokenizer()
    files = write_flat(docs, path)
    sizes = files.groupBy("uri").agg(F.max("bytes").alias("bytes"))
    counts = count_tokens(sizes, end_id(path), WordEncoder.get(path, True).dtype.itemsize)
    names = files.select("uri", "first", F.posexplode("docs").alias("k", "doc_id")).select("uri", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return names.join(counts, ["uri", "ordinal"]).select("doc_id", "n_tokens")
