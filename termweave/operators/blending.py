"""Concatenated, merged and ratio-mixed row streams as plain tables with positions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded_order
from .ranges import numbered, numbered_within, ranged


def quotas(ratios: Mapping[str, float], batch: int) -> dict[str, int]:
    """Rows of each source in a batch: shares cut to integers, the remainder one by one to the first sources."""
    total = sum(ratios.values())
    out = {k: int(v / total * batch) for k, v in ratios.items()}
    for k in list(out)[: batch - sum(out.values())]:
        out[k] += 1
    return out


def iteration_sizes(lengths: Mapping[str, int], quota: Mapping[str, int]) -> dict[str, int]:
    """Batches that a source lasts; a source without a quota, or unknown names, are errors."""
    if set(lengths) != set(quota):
        raise ValueError("sources and ratios name different sets")
    if any(q <= 0 for q in quota.values()):
        raise ValueError("a source has no row in a batch")
    return {k: -(-lengths[k] // quota[k]) for k in quota}


def concatenated(sources: Mapping[str, DataFrame], order: Mapping[str, str], seed: int | None = None) -> DataFrame:
    """All sources one after the other: dataset, local_pos, global_pos (0-based); a seed gives a permutation of the positions.

    Positions are ranges with offsets, so no source is one task. Order columns of one type, or of types that cast to strings alike.
    """
    out = None
    for i, (name, df) in enumerate(sources.items()):
        rows = df.withColumns({"dataset": F.lit(name), "_place": F.lit(i), "_by": F.col(order[name])})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    out = numbered_within(out, "_place", ["_by"], "local_pos")
    sizes = out.groupBy("_place").agg(F.count("*").alias("_n"))  # a row a source
    starts = sizes.select(F.col("_place").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    out = out.join(F.broadcast(starts), F.col("_place") == F.col("_q")).withColumn("global_pos", F.col("_start") + F.col("local_pos")).drop("_start", "_place", "_q", "_by")
    if seed is None:
        return out
    return numbered(out, [seeded_order(seed, "global_pos"), F.col("global_pos")], "shuffled_pos").withColumn("shuffled_pos", F.col("shuffled_pos") - 1)


def merged(rows: DataFrame, rank: str, stream: str, order: str, most: int | None = None) -> DataFrame:
    """Streams merged in rank order, at most `most` rows a stream and rank; pos is the place within a rank, from 1.

    Rows are sorted once by range over (rank, stream, order), so a rank or stream of any size lies in as many ranges as it needs. Each
    range counts its runs of one rank and stream; what earlier ranges have of them, and what the cap leaves of earlier streams of the
    rank, are carried over by sums over those counts, of which a range has a row a run.
    """
    run = [rank, stream]
    sorted_rows = ranged(rows, [*run, order])
    counts = sorted_rows.groupBy("_part", *run).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*run).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("_kept", F.col("_n") if most is None else F.greatest(F.lit(0), F.least("_n", most - F.col("_before"))))
    carried = F.coalesce(F.sum("_kept").over(Window.partitionBy(rank).orderBy(stream, "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_carried", carried).where("_kept > 0")
    counts = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_r{i}") for i, c in enumerate(run)], "_first", "_kept", "_carried")
    same = (F.col("_part") == F.col("_p")) & F.col(rank).eqNullSafe(F.col("_r0")) & F.col(stream).eqNullSafe(F.col("_r1"))
    out = sorted_rows.join(counts, same).withColumn("_i", F.col("_at") - F.col("_first")).where("_i < _kept")
    return out.withColumn("pos", F.col("_carried") + F.col("_i") + 1).select(*rows.columns, "pos")


def batched(rows: DataFrame, source: str, order: Column | str, quota: Mapping[str, int]) -> DataFrame:
    """batch_id of each row when every batch takes a source's quota in order; sources without a quota are skipped."""
    q = F.create_map(*[F.lit(x) for kv in quota.items() if kv[1] > 0 for x in kv])[F.col(source)]
    out = numbered_within(rows.withColumn("_q", q).where("_q is not null"), source, [F.col(order) if isinstance(order, str) else order], "_at")
    return out.withColumn("batch_id", F.floor(F.col("_at") / F.col("_q")).cast("long")).drop("_q", "_at")


def addressed(rows: DataFrame, position: str, batch: int, buffer: int) -> DataFrame:
    """batch, block and offset of a 0-based position; buffer must be a multiple of batch."""
    if buffer % batch:
        raise ValueError("buffer must be a multiple of batch")
    p = F.col(position)
    return rows.withColumns({"batch": F.floor(p / batch).cast("long"), "block": F.floor(p / buffer).cast("long"), "offset": (p % buffer).cast("long")})


def cycled(rows: DataFrame, epochs: int, seed: int, *keys: str) -> DataFrame:
    """Every row once an epoch, in a new seeded order each; epoch and order_key sort the stream."""
    out = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return out.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), *[F.col(k).cast("string") for k in keys])))
