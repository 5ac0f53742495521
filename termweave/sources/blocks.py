"""Rows in blocks with an index: reads by position open only the blocks that the positions lie in, in tables and in streams."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ranges import numbered
from ..operators.sampling import STRIDES, _drawn
from ..runtime import shipped
from .arrow import opened as open_at

#: Blocks that a reading task keeps open at most.
HELD = 8


def write_blocks(df: DataFrame, path: str, order: list[Column | str], block: int = 4096) -> None:
    """df in blocks of `block` rows in a total order; position 0 is its first row. An existing path is an error.

    Rows are numbered by range and dealt by block, so a task writes whole blocks, one Arrow record batch each, into a file of its own.
    The index (block, file, i, rows) is a table that is committed last and names only files of tasks that succeeded; an empty df has an
    empty one.
    """
    spark = df.sparkSession
    shipped(spark)
    rows = numbered(df, order, "_position").withColumn("_block", F.expr(f"(_position - 1) div {block}"))
    schema = to_arrow_schema(df.schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = open_at(f"{path.rstrip('/')}/data")
        name, sink, writer, held, done = f"{uuid.uuid4().hex}.arrow", None, None, None, []

        def put(rows: pa.Table, at: int) -> None:
            nonlocal sink, writer
            if writer is None:
                fs.create_dir(place, recursive=True)
                sink = fs.open_output_stream(f"{place}/{name}")
                writer = pa.ipc.new_file(sink, schema)
            writer.write_table(rows.drop_columns(["_position", "_block"]).cast(schema).combine_chunks(), max_chunksize=max(len(rows), 1))
            done.append((at, len(done), len(rows)))

        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            at = held["_block"].to_numpy()
            while len(at) and at[0] != at[-1]:
                n = int((at == at[0]).sum())
                put(held.slice(0, n), int(at[0]))
                held, at = held.slice(n), at[n:]
        if held is not None and len(held):
            put(held, held["_block"][0].as_py())
        if writer is not None:
            writer.close()
            sink.close()
        if done:
            at, i, n = zip(*done, strict=True)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array([name] * len(at)), pa.array(i, pa.int32()), pa.array(n, pa.int64())], names=["block", "file", "i", "rows"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, "_block").sortWithinPartitions("_position")
    dealt.mapInArrow(write, "block long, file string, i int, rows long").write.parquet(f"{path.rstrip('/')}/index")
    spark.createDataFrame([(df.schema.json(), block)], "schema string, block long").coalesce(1).write.parquet(f"{path.rstrip('/')}/about")


class Blocks:
    """What write_blocks wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.schema, self.block = T.StructType.fromJson(json.loads(about["schema"])), about["block"]
        self.index = spark.read.parquet(f"{self.path}/index")
        self.rows = self.index.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def _fetched(self, wanted: DataFrame, keep: list[T.StructField], opened: Accumulator | None) -> DataFrame:
        """Rows for wanted (keep, _block, _at): joined with the index, dealt by block, read block by block."""
        shipped(self.spark)
        path, names = self.path, [f.name for f in keep]
        schema = to_arrow_schema(self.schema)
        index = self.index.select(F.col("block").alias("_block"), "file", "i")
        rows = wanted.join(index, "_block").select(*names, "_block", "file", "i", "_at")
        rows = rows.repartition("_block") if rows.isStreaming else rows.repartition("_block").sortWithinPartitions("_block")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, pa.RecordBatch] = {}
            for b in batches:
                for block in pc.unique(b["_block"]).to_pylist():
                    asked = b.filter(pc.equal(b["_block"], block))
                    if block not in held:
                        while len(held) >= HELD:
                            held.pop(next(iter(held)))
                        fs, place = open_at(f"{path}/data/{asked['file'][0].as_py()}")
                        with fs.open_input_file(place) as f:
                            held[block] = pa.ipc.open_file(f).get_batch(asked["i"][0].as_py())
                        if opened is not None:
                            opened.add(1)
                    got = held[block].take(asked["_at"])
                    yield pa.RecordBatch.from_arrays([*[asked[c] for c in names], *got.columns], names=[*names, *schema.names])

        return rows.mapInArrow(read, T.StructType([*keep, *self.schema.fields]))

    def at(self, positions: DataFrame, opened: Accumulator | None = None) -> DataFrame:
        """positions (position) with the rows that lie there, as often as they are asked for; a position outside is an IndexError.

        k positions open k blocks at most; `opened` counts them. A position that is asked for many times is read once.
        """
        p = positions.select(F.col("position").cast("long").alias("position"))
        low, high = p.agg(F.min("position"), F.max("position")).first()
        if low is not None and (low < 0 or high >= self.rows):
            raise IndexError(f"positions {low} to {high} of {self.rows} rows")
        once = p.where("position is not null").distinct()
        wanted = once.select("position", F.expr(f"position div {self.block}").alias("_block"), (F.col("position") % self.block).alias("_at"))
        return p.join(self._fetched(wanted, [T.StructField("position", T.LongType())], opened), "position")

    def cycle(self, rows_per_batch: int, seed: int) -> DataFrame:
        """An endless stream of (epoch, place, columns): every row once an epoch, in a new seeded order each.

        Numbers come from Spark's own counting source, a fixed count of them a micro-batch, so its checkpoint holds the exact place in
        the epoch. In epoch e, blocks are met from a drawn start by a drawn stride, modulo their number, then rows of a block likewise;
        a last, shorter block comes last. So a micro-batch reads few blocks, and each of them whole. An empty table has no cycle.
        """
        if not self.rows:
            raise ValueError("no rows to cycle over")
        full = self.rows // self.block
        numbers = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", self.spark.sparkContext.defaultParallelism).load()
        rows = numbers.select(F.expr(f"value div {self.rows}").alias("epoch"), (F.col("value") % self.rows).alias("place"))
        return self._fetched(cycle_places(rows, self.rows, self.block, full, seed), [T.StructField("epoch", T.LongType()), T.StructField("place", T.LongType())], None)


def cycle_places(rows: DataFrame, n: int, block: int, full: int, seed: int) -> DataFrame:
    """rows (epoch, place) with the _block and the _at that a cycle reads there."""

    def order(what: str, key: str, at: Column, size: Column) -> Column:
        stride = F.element_at(F.array(*map(F.lit, STRIDES)), (_drawn(seed, key, f"{what} step", F.lit(len(STRIDES))) + 1).cast("int"))
        return F.pmod(_drawn(seed, key, f"{what} start", size) + at * stride, size)

    ordinal = F.expr(f"place div {block}")
    rows = rows.withColumn("_block", F.when(ordinal < full, order("block", "epoch", ordinal, F.lit(max(full, 1)))).otherwise(F.lit(full)).cast("long"))
    size = F.when(F.col("_block") < full, F.lit(block)).otherwise(F.lit(max(n - full * block, 1)))
    rows = rows.withColumn("_key", F.concat_ws(":", F.col("epoch").cast("string"), F.col("_block").cast("string")))
    return rows.withColumn("_at", order("row", "_key", F.col("place") % block, size)).drop("_key")
