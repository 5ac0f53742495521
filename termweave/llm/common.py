"""Helpers shared by the training-data operators: scratch tables, measured broadcasts, file access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch, shared_dir, shipped, small_side, written

__all__ = ["SEPARATORS", "arrow_limits", "opened", "scratch", "shared_dir", "shipped", "small_side", "spread", "tables", "word_array", "word_count", "written"]

#: The six separators of the word definition, as a Java/DuckDB character class body.
SEPARATORS = r"\x20\x09-\x0D"


def spread(df: DataFrame) -> DataFrame:
    """df in more partitions than the cluster has cores, if its files are too few or small for that; large inputs stay as they lie.

    To be asked of the table itself: a size after a projection is a guess of the optimizer's."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(2 * cores) if int(str(size)) < cores * most else df


def arrow_limits(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers hold, in rows and bytes; the same for all operators, in whatever order they run."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


def word_array(text: Column) -> Column:
    """Words of a text as a native array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SEPARATORS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without building strings for the empty ends."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SEPARATORS}]+")
    ends = (F.get(parts, F.lit(0)) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - ends).cast("long")


def opened(uri: str):
    """(pyarrow file system, path) of a URI in the shared folder; works on the driver and on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def tables(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
