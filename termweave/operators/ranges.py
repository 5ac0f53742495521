"""Numbers and running sums over a total order, without gathering the rows in one task.

Rows are sorted by range and written once, each with its range and its place in it. Counts, offsets and results all come from that
one table: a plan that is evaluated twice may draw its range bounds anew, a written table may not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import written

_PLACE = (1 << 33) - 1
#: Rows of a range, on average at most.
RANGE_ROWS = 1 << 18


def parts(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows that one has RANGE_ROWS on average at most; spark.sql.shuffle.partitions at least."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))


def ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """df with _part, the range in order, and _at, the 0-based place in it; written.

    df is written first: range bounds are drawn from its rows, which are then computed once, and their number tells how many ranges
    keep a range, what one task sorts, at RANGE_ROWS rows however large the table is."""
    df = written(df, "rows")
    rows = df.repartitionByRange(parts(df.sparkSession, df.count()), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return written(rows.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND(F.lit(_PLACE))}).drop("_id"), "ranges")


def _starts(rows: DataFrame, **sums: Column) -> DataFrame:
    """(_p, then each sum over all ranges before): a row a range, of which there are as many as shuffle partitions."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(*[x.alias(c) for c, x in sums.items()])
    return F.broadcast(totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums]))


def numbered(df: DataFrame, order: Sequence[Column | str], into: str = "name_id") -> DataFrame:
    """1..n in a total order; rows that the order does not tell apart get some order among themselves."""
    rows = ranged(df, order)
    out = rows.join(_starts(rows, _start=F.count("*")), F.col("_part") == F.col("_p"))
    return out.withColumn(into, F.col("_start") + F.col("_at") + 1).drop("_part", "_p", "_at", "_start")


def numbered_within(df: DataFrame, group: str, order: Sequence[Column | str], into: str) -> DataFrame:
    """0-based places within each group, in the group's order; a group of any size is spread over the ranges. Null is a group."""
    rows = numbered(df, [F.col(group), *order], "_n")
    first = rows.groupBy(F.col(group).alias("_g")).agg(F.min("_n").alias("_first"))
    return rows.join(first, rows[group].eqNullSafe(F.col("_g"))).withColumn(into, F.col("_n") - F.col("_first")).drop("_g", "_n", "_first")


def running(df: DataFrame, order: Sequence[Column | str], **sums: str) -> DataFrame:
    """df with running sums, each row's own value included: new column = name of the summed column."""
    rows = ranged(df, order)
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(_starts(rows, **{f"_s_{k}": F.sum(c) for k, c in sums.items()}), F.col("_part") == F.col("_p"))
    return out.withColumns({k: F.col(f"_s_{k}") + F.sum(c).over(within) for k, c in sums.items()}).drop("_part", "_p", "_at", *[f"_s_{k}" for k in sums])
