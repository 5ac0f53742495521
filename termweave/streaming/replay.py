"""Tables replayed as streams, and micro-batch forms of the blending operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replay(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """A Parquet folder as a stream, some files a micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Event counts and sums by window and key; state is dropped behind the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def shuffled_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], seed: int, *keys: str, checkpoint: str | None = None):
    """Each micro-batch reaches the sink in a seeded order, the streaming form of a buffered shuffle."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(batch.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(k).cast("string") for k in keys]))).sortWithinPartitions("order_key"), epoch)

    writer = stream.writeStream.foreachBatch(each)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()


def buffered_shuffle(df: DataFrame, buffer: int, seed: int) -> DataFrame:
    """Each partition's rows through a buffer of `buffer` rows: a new row takes a drawn slot, whose row goes out; the rest go out drawn.

    Adds place, the 0-based order within the partition. A row moves back any distance and forward by at most `buffer`; memory holds
    the buffer and a batch. Works on tables and on streams (each micro-batch by itself); a repeated task draws the same.
    """
    if buffer < 1:
        raise ValueError("buffer must be at least 1")
    schema = T.StructType([*df.schema.fields, T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held, at = None, 0

        def out(rows: pa.Table, take: np.ndarray) -> pa.RecordBatch:
            got = rows.take(pa.array(take)).append_column("place", pa.array(np.arange(at, at + len(take))))
            return got.combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            slots, going = list(range(min(buffer, len(rows)))), []
            for new, slot in zip(range(buffer, len(rows)), rng.integers(0, buffer, max(0, len(rows) - buffer)).tolist()):
                going.append(slots[slot])
                slots[slot] = new
            if going:
                yield out(rows, np.array(going))
                at += len(going)
            held = rows.take(pa.array(slots)).combine_chunks()
        if held is not None and len(held):
            yield out(held, rng.permutation(len(held)))

    return df.mapInArrow(run, schema)
