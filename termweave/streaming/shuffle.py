"""A shuffle buffer that lives in the stream's state: a row may leave in a later micro-batch than it came in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_STATE = "base long, arrived long, rows binary"


def _draw(*what) -> int:
    return int(hashlib.md5(":".join(map(str, what)).encode()).hexdigest()[:8], 16)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _rest(rows: pa.Table, seed: int, shard: int, first: int) -> pa.Table:
    """The rows of a buffer in drawn order, with their places from `first` on; row i lies in slot i."""
    order = sorted(range(len(rows)), key=lambda i: (hashlib.md5(f"{seed}:{shard}:rest:{i}".encode()).hexdigest(), i))
    return rows.take(pa.array(order, pa.int64())).append_column("place", pa.array(range(first, first + len(rows)), pa.int64()))


def shuffled_stream(stream: DataFrame, buffer: int, seed: int, order: list[str], shard: Column | None = None, idle: int | None = None) -> DataFrame:
    """stream with shard and place: each shard's rows through a buffer of `buffer` rows that is kept from micro-batch to micro-batch.

    Row n of a shard, counted over all micro-batches (within one, in the order of the columns `order`), takes slot n while the buffer
    fills, then a slot drawn from (seed, shard, n), whose row goes out at place n - buffer. So the order depends on neither partitions
    nor restarts, and with a sink that writes each batch once no row is lost or doubled. Rows still in the buffer at the end of a finite
    stream are what remaining() reads from the checkpoint; with `idle`, a shard without rows for that many milliseconds is emptied by
    timer instead. A shard's rows of one micro-batch and its buffer are in one task: shard keeps both small (a column of small integers;
    by default all rows are one shard). Rows pass through pandas, which keeps integers beyond 2^53 only in columns without nulls.
    """
    if buffer < 1:
        raise ValueError("buffer must be at least 1")
    own = stream.schema
    kept = to_arrow_schema(own)
    out = T.StructType([*own.fields, T.StructField("shard", T.LongType()), T.StructField("place", T.LongType())])

    def each(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        shard = int(key[0])
        base, arrived, held = state.get if state.exists else (0, 0, None)
        rows = pa.ipc.open_stream(held).read_all() if held else kept.empty_table()
        if state.hasTimedOut:
            state.update((arrived, arrived, None))
            going = _rest(rows, seed, shard, arrived - len(rows))
        else:
            came = pd.concat(list(frames))[own.fieldNames()].sort_values(order, kind="stable")
            first = len(rows)
            rows = pa.concat_tables([rows, pa.Table.from_pandas(came, schema=kept, preserve_index=False)])
            slots, take, place = list(range(min(buffer, len(rows)))), [], []
            for new in range(max(first, buffer), len(rows)):
                n = arrived - base + new - first
                slot = _draw(seed, shard, base + n) % buffer
                take.append(slots[slot])
                place.append(base + n - buffer)
                slots[slot] = new
            arrived += len(came)
            state.update((base, arrived, _packed(rows.take(pa.array(slots, pa.int64())))))
            if idle:
                state.setTimeoutDuration(idle)
            going = rows.take(pa.array(take, pa.int64())).append_column("place", pa.array(place, pa.int64()))
        frame = going.to_pandas()
        frame.insert(len(own), "shard", np.int64(shard))
        yield frame

    keyed = stream.withColumn("_shard", (F.lit(0) if shard is None else shard).cast("long"))
    return keyed.groupBy("_shard").applyInPandasWithState(each, out, _STATE, "append", "ProcessingTimeTimeout" if idle else "NoTimeout")


def remaining(spark: SparkSession, checkpoint: str, schema: T.StructType, seed: int) -> DataFrame:
    """The rows that shuffled_stream's buffers hold in a checkpoint, with shard and place, as they go out at the end; schema: the stream's."""
    out = T.StructType([*schema.fields, T.StructField("shard", T.LongType()), T.StructField("place", T.LongType())])
    state = spark.read.format("statestore").load(checkpoint)
    state = state.select(F.col("key._shard").alias("shard"), F.col("value.groupState.arrived").alias("arrived"), F.col("value.groupState.rows").alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["rows"]:
                    rows = pa.ipc.open_stream(r["rows"]).read_all()
                    rest = _rest(rows, seed, r["shard"], r["arrived"] - len(rows))
                    rest = rest.add_column(len(schema), "shard", pa.array([r["shard"]] * len(rows), pa.int64()))
                    yield from rest.combine_chunks().to_batches()

    return state.mapInArrow(run, out)
