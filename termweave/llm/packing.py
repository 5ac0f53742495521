"""Best-fit packing of documents into bins of a fixed number of words, under conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, word_count, written
from .ngram_join import near_duplicates

CAPACITY = 4096
PER_SOURCE = 4
#: Documents that are packed together; a shard's bins are complete in themselves.
SHARD = 20_000
#: Members of a cluster in a shard up to which its bins are told apart one by one.
SMALL = 64


class Bins:
    """Open bins in order of residual, each with bit planes of its sources and a bitmap of its duplicate clusters.

    Bins of one residual are kept apart by what they refuse outright: their full sources and their clusters of `large`, the bitmap of
    clusters with many members. So a search passes a source or a large cluster by a few groups, not bin by bin.
    """

    def __init__(self, capacity: int, per_source: int, large: int = 0):
        self.capacity, self.per_source, self.large = capacity, per_source, large
        self.at: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.filled = 0  # bit r: some bin has residual r
        self.residual: list[int] = []
        self.planes: list[list[int]] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin with the least residual of those that fit and do not conflict; a new one if none."""
        mask = self.filled >> size
        r = size
        while mask:
            step = (mask & -mask).bit_length() - 1
            r += step
            groups = self.at[r]
            for refuses, here in groups.items():
                if refuses[0] & source or refuses[1] & cluster:
                    continue
                for k in range(len(here) - 1, -1, -1):  # past at most SMALL bins, those of a small cluster
                    b = here[k]
                    if not self.clusters[b] & cluster:
                        here[k] = here[-1]
                        here.pop()
                        if not here:
                            del groups[refuses]
                            if not groups:
                                self.filled &= ~(1 << r)
                        self._put(b, r - size, source, cluster)
                        return b
            mask >>= step + 1
            r += 1
        b = len(self.residual)
        self.residual.append(0)
        self.planes.append([0] * self.per_source)
        self.clusters.append(0)
        self._put(b, self.capacity - size, source, cluster)
        return b

    def _put(self, b: int, residual: int, source: int, cluster: int) -> None:
        planes = self.planes[b]
        for i in range(self.per_source):
            if not planes[i] & source:
                planes[i] |= source
                break
        self.clusters[b] |= cluster
        self.residual[b] = residual
        self.at.setdefault(residual, {}).setdefault((planes[-1], self.clusters[b] & self.large), []).append(b)
        self.filled |= 1 << residual


def pack_shard(rows: list[tuple], capacity: int, per_source: int) -> list[tuple]:
    """rows (doc_id, source, size, cluster) -> (place in rows, piece, start, length, bin) of every piece, in the order they are placed:
    whole bins first, then the rest from the longest to the shortest, each to the tightest bin that takes it."""
    out = []
    seen: dict = {}
    for *_, c in rows:
        seen[c] = seen.get(c, 0) + 1
    clusters = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1)}
    large = sum(1 << i for c, i in clusters.items() if seen[c] > SMALL)
    bins = Bins(capacity, per_source, large)
    sources: dict = {}
    rest = []
    for i, (_, source, size, cluster) in enumerate(rows):
        full = size // capacity if size > capacity else 0
        bit = 1 << clusters[cluster] if cluster in clusters else 0
        source = 1 << sources.setdefault(source, len(sources))
        for p in range(full):
            out.append((i, p, p * capacity, capacity, bins.place(capacity, source, bit)))
        if size - full * capacity or not full:
            rest.append((size - full * capacity, i, full, source, bit))
    rest.sort(key=lambda x: (-x[0], x[1]))
    for size, i, p, source, bit in rest:
        out.append((i, p, p * capacity, size, bins.place(size, source, bit)))
    return out


def _packed(capacity: int, per_source: int):
    names = ["doc_id", "piece", "start", "length", "bin_id", "residual"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def shard(no: int, rows: list[tuple]) -> pa.RecordBatch:
        placed = pack_shard(rows, capacity, per_source)
        used: dict[int, int] = {}
        for *_, n, b in placed:
            used[b] = used.get(b, 0) + n
        out = [(rows[i][0], p, s, n, no << 24 | b, capacity - used[b]) for i, p, s, n, b in placed]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for no, *row in zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "source", "size", "cluster")), strict=True):
                if no != now and rows:
                    yield shard(now, rows)
                    rows = []
                now = no
                rows.append(tuple(row))
        if rows:
            yield shard(now, rows)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int | None = SHARD, cluster: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, residual): every word of every document in one bin.

    Sizes are words; a document longer than a bin is cut into full pieces and a rest. A bin holds at most one piece of a duplicate
    cluster (column `cluster`, by default equal texts apart from case) and at most per_source pieces of a source; the piece goes to
    the fullest bin that takes it. Bins do not cross shards of about `shard` documents, which are dealt by a hash of the whole row, so
    a source, cluster or doc_id with a third of all rows is spread evenly, copies of a row included, and memory holds one shard: the
    bin is the tightest of its shard. shard None packs the whole table as one, in one task. Null and empty texts have size 0 and are
    one piece of length 0 each; a null source is a source; ties go by doc_id; repeated rows are packed each (as copies, in different
    bins); an empty table gives no bin; other columns, of any name, are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    group = F.xxhash64(F.lower(F.coalesce("text", F.lit("")))) if cluster is None else F.xxhash64(cluster)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), group.alias("cluster"), F.xxhash64("text").alias("content"))
    return _dealt(rows, capacity, per_source, shard)


def _dealt(rows: DataFrame, capacity: int, per_source: int, shard: int | None) -> DataFrame:
    """pack's result for rows (doc_id, source, size, cluster, content)."""
    spark = rows.sparkSession
    rows = rows.withColumn("cluster", F.when(F.col("size") > 0, F.col("cluster")).otherwise(F.xxhash64(F.lit("empty"), "doc_id")))
    # equal rows are counted before they are dealt, then numbered, so that a row that is repeated without end is dealt like others
    rows = written(rows.groupBy("doc_id", "source", "size", "cluster", "content").agg(F.count("*").alias("n")), "sizes")
    n = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = 1 if shard is None else max(1, -(-n // shard))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "content", "copy"), F.lit(shards)))
    rows = rows.select("shard", "doc_id", "source", "size", "cluster").repartition(min(parts, shards) if shards > 1 else 1, "shard")
    rows = rows.sortWithinPartitions("shard", F.desc("size"), "doc_id", "source", "cluster")
    return rows.mapInArrow(_packed(capacity, per_source), "doc_id long, piece int, start long, length long, bin_id long, residual long")


def pack_apart(docs: DataFrame) -> DataFrame:
    """pack with components of near duplicates as clusters, so near copies share no bin. Texts that link with nothing, and rows with
    a null doc_id, fall back on equal texts apart from case; copies that differ in the case of letters beyond A-Z may then count as unrelated.

    Two texts under one doc_id are of one component, the smallest of theirs. Repeated rows are packed each, in different bins; null and
    empty texts are one piece of length 0; texts of any length are cut into full pieces and a rest; a null source is a source; ties go
    by doc_id; an empty table gives no bin; other columns, of any name, are ignored.
    """
    same = F.xxhash64(F.lower(F.coalesce("text", F.lit(""))))
    told = docs.select("doc_id", "text", F.col("source").alias("_source"), F.xxhash64("text").alias("_content"), same.alias("_same"))
    told = written(near_duplicates(told, beside=["_source", "_content", "_same"]), "told")
    near = told.where("component_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("component_id").alias("_component"))
    many = near.groupBy("_component").agg(F.count("*").alias("_n")).where("_n > 1").select("_component")
    near = written(near.join(many, "_component", "left_semi"), "components")
    named = told.join(near, F.col("doc_id") == F.col("_id"), "left")
    cluster = F.xxhash64(F.when(F.col("_component").isNotNull(), F.xxhash64(F.lit("component"), "_component")).otherwise(F.col("_same")))
    rows = named.select("doc_id", F.col("_source").alias("source"), F.col("n_words").alias("size"), cluster.alias("cluster"), F.col("_content").alias("content"))
    return _dealt(rows, CAPACITY, PER_SOURCE, SHARD)
