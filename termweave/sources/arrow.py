"""Arrow IPC (Feather) files as a Spark data source: columns and simple filters are applied where record batches are read."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..runtime import shipped

NAME = "termweave_arrow"
#: Bytes of files that a partition reads, and partitions at most: with more data they grow.
SLICE_BYTES, SLICES = 128 << 20, 10_000
_COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def opened(uri: str):
    """(pyarrow file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def files(path: str) -> list[tuple[str, int]]:
    """(path within its file system, bytes) of one file, or of a folder's files but those that begin with . or _."""
    from pyarrow import fs as pafs

    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at))
    return sorted((i.path, i.size) for i in found if i.is_file and i.base_name[0] not in "._")


@dataclass
class Slice(InputPartition):
    """Whole files, or the k-th of n parts of one file's record batches."""

    paths: list[str]
    k: int = 0
    n: int = 1


class ArrowReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.filters = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in (*_COMPARE, In, IsNull, IsNotNull) and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Slice]:
        """Small files packed together, large ones in slices; footers are read by the tasks."""
        held = files(self.path)
        most = max(SLICE_BYTES, sum(size for _, size in held) // SLICES)
        out, pack, packed = [], [], 0
        for path, size in held:
            if size > most:
                n = -(-size // most)
                out += [Slice([path], k, n) for k in range(n)]
                continue
            if pack and packed + size > most:
                out.append(Slice(pack))
                pack, packed = [], 0
            pack.append(path)
            packed += size
        return out + [Slice(pack)] * bool(pack)

    def _kept(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        for f in self.filters:
            column = batch[f.attribute[0]]
            if isinstance(f, IsNull | IsNotNull):
                mask = pc.is_null(column) if isinstance(f, IsNull) else pc.is_valid(column)
            elif isinstance(f, In):
                mask = pc.and_(pc.is_in(column, value_set=pa.array([v for v in f.value if v is not None], column.type)), pc.is_valid(column))
            else:
                mask = _COMPARE[type(f)](column, pa.scalar(f.value, column.type))
            batch = batch.filter(mask)
        return batch

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema)
        fs, _ = opened(self.path)
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                names = pa.ipc.open_file(f).schema.names
                missing = set(wanted.names) - set(names)
                if missing:
                    raise ValueError(f"{path} lacks {sorted(missing)}")
                # buffers of other columns are not read
                source = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in wanted.names]))
                n = source.num_record_batches
                for i in range(partition.k * n // partition.n, (partition.k + 1) * n // partition.n):
                    batch = pa.Table.from_batches([source.get_batch(i)]).select(wanted.names).cast(wanted)
                    yield from (self._kept(b) for b in batch.to_batches(max_chunksize=10_000))


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class ArrowWriter(DataSourceArrowWriter):
    """A file a task, under a hidden name until all tasks are done; a failed or repeated task leaves no visible file."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = opened(self.path)
        schema, name, sink = to_arrow_schema(self.schema), f"part-{uuid.uuid4().hex}.arrow", None
        for batch in iterator:
            if sink is None:
                fs.create_dir(at, recursive=True)
                sink = fs.open_output_stream(f"{at}/.{name}")
                writer = pa.ipc.new_file(sink, schema)
            writer.write_table(pa.Table.from_batches([batch]).cast(schema))
        if sink is None:
            return Written(None)
        writer.close()
        sink.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        for path, _ in files(self.path) if self.overwrite else []:
            fs.delete_file(path)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{at}/.{m.name}", f"{at}/{m.name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{at}/.{m.name}")


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        """The first file's; dictionaries are decoded."""
        held = files(self.options["path"])
        if not held:
            raise FileNotFoundError(self.options["path"])
        with opened(self.options["path"])[0].open_input_file(held[0][0]) as f:
            found = pa.ipc.open_file(f).schema
        return from_arrow_schema(pa.schema([pa.field(x.name, x.type.value_type if pa.types.is_dictionary(x.type) else x.type) for x in found]))

    def reader(self, schema: T.StructType) -> ArrowReader:
        return ArrowReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options["path"], schema, overwrite)


def _registered(spark: SparkSession) -> None:
    shipped(spark)
    spark.dataSource.register(ArrowFiles)


def read_arrow(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Arrow IPC files, one or a folder of them with one schema. With `columns` only these are read, in that order; comparisons with
    constants, `isin` and null tests of a column are applied to the record batches before rows reach Spark."""
    _registered(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(NAME)
    if columns is not None:
        found = ArrowFiles({"path": path}).schema()
        reader = reader.schema(T.StructType([found[c] for c in columns]))
    return reader.load(path)


def write_arrow(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """df as Arrow IPC files, one a task, visible when all are written. mode: overwrite or append."""
    _registered(df.sparkSession)
    df.write.format(NAME).mode(mode).save(path)
