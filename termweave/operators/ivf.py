"""Approximate vector search by inverted lists: rows lie in the list of their nearest centroid, queries probe lists in order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded_order
from ..runtime import shipped, written
from .vector import DIGITS, dot, topk

#: What the lists are fitted on: so many rows of the corpus at most, drawn by hash, and so many bytes of vectors.
FIT_ROWS, FIT_BYTES = 20_000, 16 << 20
#: Rows of the sample for each list, rounds of k-means, and rows of the sample that the depth of search is measured with.
ROWS_A_LIST, ROUNDS, TRIALS = 8, 10, 256
#: Share of the sample's nearest rows that must lie in the probed lists, and candidates scored exactly for each row asked for.
REACHED, RESCORED = 0.98, 4
#: Rows of a list, and queries that probe it, that meet in one group.
PART_ROWS, ASK_ROWS = 16_384, 4_096


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _nearest(sample: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Each row's centroid; some rows at a time, as there may be thousands of centroids."""
    step = max(1, (1 << 20) // len(centroids))
    return np.concatenate([(sample[i : i + step] @ centroids.T).argmax(1) for i in range(0, len(sample), step)])


def _centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """n unit vectors by spherical k-means over the sample, whose order is random; an empty list keeps its centroid."""
    c = _unit(sample[:n].copy())
    for _ in range(ROUNDS):
        near = _nearest(sample, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        full = np.bincount(near, minlength=n) > 0
        c[full] = _unit(sums[full])
    return c


def _depth(sample: np.ndarray, centroids: np.ndarray, k: int) -> float:
    """The share of the rows that lists must hold, in the order in which a query probes them, to reach REACHED of the k nearest."""
    near = _nearest(sample, centroids)
    size = np.bincount(near, minlength=len(centroids))
    trial = sample[:TRIALS]
    order = (-(trial @ centroids.T)).argsort(1, kind="stable")
    upto = np.take_along_axis(np.cumsum(size[order], 1), order.argsort(1), 1) / len(sample)
    best = np.concatenate([(-(trial[i : i + 32] @ sample.T)).argsort(1, kind="stable")[:, :k] for i in range(0, len(trial), 32)])
    return float(np.quantile(np.take_along_axis(upto, near[best], 1), REACHED))


@dataclass
class ListIndex:
    """Lists of all rows of a corpus; rows: list, part, corpus_id, code, scale; vectors: corpus_id, vector; both written."""

    centroids: np.ndarray
    depth: float
    n: int
    rows: DataFrame
    sizes: DataFrame
    vectors: DataFrame

    @classmethod
    def build(cls, corpus: DataFrame, k: int = 10, seed: int = 7) -> ListIndex:
        """An index of corpus (corpus_id, vector); null vectors are in no list, an empty corpus has none.

        Centroids, about as many as the root of the number of rows and no more than one in ROWS_A_LIST of the sample's, and the depth of
        search are fitted on a drawn sample of bounded size; every row is indexed. A row is kept with one byte a dimension. A list of
        any size is dealt in parts.
        """
        shipped(corpus.sparkSession)
        vectors = written(corpus.where("vector is not null").select(F.col("corpus_id").cast("long").alias("corpus_id"), "vector"), "vectors")
        n, size = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
        most = max(1, min(FIT_ROWS, FIT_BYTES // (8 * max(size, 1))))
        order = seeded_order(seed, "corpus_id")
        share = (most + 8 * most**0.5) / max(n, 1)
        # the first `most` rows of the order are among these; without this each partition would send as many to the driver
        drawn = vectors.where(order < f"{int(share * (1 << 32)):08x}") if share < 1 else vectors
        sample = drawn.orderBy(order, "corpus_id").limit(most).select("vector").toArrow()
        sample = np.asarray(sample["vector"].combine_chunks().flatten(), float).reshape(len(sample), -1) if n else np.zeros((1, max(size, 1)))
        lists = max(1, min(round(2 * n**0.5), len(sample) // ROWS_A_LIST))
        centroids = _centroids(sample, lists)
        held = corpus.sparkSession.sparkContext.broadcast(centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = np.asarray(b["vector"].flatten(), float).reshape(b.num_rows, -1)
                    scale = np.maximum(np.abs(v).max(1), 1e-30) / 127
                    codes = np.rint(v / scale[:, None]).astype(np.int8)
                    yield pa.record_batch([pa.array((v @ held.value.T).argmax(1).astype(np.int32)), b["corpus_id"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale.astype(np.float32))], names=["list", "corpus_id", "code", "scale"])

        rows = written(vectors.mapInArrow(assign, "list int, corpus_id long, code binary, scale float"), "codes")
        sizes = written(rows.groupBy("list").agg(F.count("*").alias("size")), "sizes")  # a row a list
        return cls(centroids, _depth(sample, centroids, k) if n else 1.0, n, rows, sizes, vectors)

    def probes(self, queries: DataFrame) -> DataFrame:
        """(query_id, vector, list): each query's lists in order, as far as the share `depth` of the rows, and one at least."""
        size = np.zeros(len(self.centroids), np.int64)
        for r in self.sizes.collect():  # at most FIT_ROWS / ROWS_A_LIST rows
            size[r["list"]] = r["size"]
        held = queries.sparkSession.sparkContext.broadcast((self.centroids, size, self.depth * self.n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, size, wanted = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                v = np.asarray(b["vector"].flatten(), float).reshape(b.num_rows, -1)
                order = (-(v @ centroids.T)).argsort(1, kind="stable")
                before = np.cumsum(size[order], 1) - size[order]
                q, at = np.nonzero((before < max(wanted, 1)) & (size[order] > 0))
                for i in range(0, len(q), 4096):
                    take = pa.array(q[i : i + 4096])
                    yield pa.record_batch([b["query_id"].take(take), b["vector"].take(take), pa.array(order[q[i : i + 4096], at[i : i + 4096]].astype(np.int32))], names=["query_id", "vector", "list"])

        rows = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("vector"))
        return rows.mapInArrow(run, "query_id long, vector array<float>, list int")

    def scored(self, k: int) -> int:
        """Candidates of a query: RESCORED * k, but no more than a tenth of the corpus, and k at least."""
        return max(k, min(RESCORED * k, self.n // 10))

    def candidates(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, corpus_id): for each query the rows of its probed lists that are nearest by their codes, as many as scored(k).

        Each part of a list meets each block of the queries that probe it in one group, so neither a large list nor one that many
        queries probe is one task. Lists' sizes and numbers of queries are tables of a row a list.
        """
        most = self.scored(k)
        asked = written(self.probes(queries), "probes")
        parts = self.sizes.select("list", F.ceil(F.col("size") / PART_ROWS).alias("_parts"))
        blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / ASK_ROWS).alias("_blocks"))
        shape = F.broadcast(parts.join(blocks, "list"))  # a row a list
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = asked.join(shape, "list").withColumns({"_block": F.pmod(F.xxhash64("query_id"), F.col("_blocks")), "_part": every("_parts")}).select("list", "_block", "_part", "query_id", "vector")
        right = self.rows.join(shape, "list").withColumns({"_part": F.pmod(F.xxhash64("corpus_id"), F.col("_parts")), "_block": every("_blocks")}).select("list", "_block", "_part", "corpus_id", "code", "scale")

        def met(a: pa.Table, b: pa.Table) -> pa.Table:
            out = [[], [], []]
            if a.num_rows and b.num_rows:
                q = np.asarray(a["vector"].combine_chunks().flatten(), np.float32).reshape(a.num_rows, -1)
                codes = np.frombuffer(b"".join(b["code"].to_pylist()), np.int8).reshape(b.num_rows, -1).T.astype(np.float32) * b["scale"].to_numpy()
                ids, order = a["query_id"].to_numpy(), np.argsort(b["corpus_id"].to_numpy(), kind="stable")
                who, codes = b["corpus_id"].to_numpy()[order], codes[:, order]  # so that ties go by corpus_id, in any part
                for i in range(0, len(q), 256):
                    score = np.round(q[i : i + 256] @ codes, 5)
                    at = np.argsort(-score, axis=1, kind="stable")[:, :most]
                    out[0].append(np.repeat(ids[i : i + 256], at.shape[1]))
                    out[1].append(who[at].ravel())
                    out[2].append(np.take_along_axis(score, at, 1).ravel())
            cols = [np.concatenate(x) if x else np.zeros(0) for x in out]
            return pa.table([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(float))], names=["query_id", "corpus_id", "near"])

        found = left.groupBy("list", "_block", "_part").cogroup(right.groupBy("list", "_block", "_part")).applyInArrow(met, "query_id long, corpus_id long, near double")
        best = Window.partitionBy("query_id").orderBy(F.desc("near"), "corpus_id")
        return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).select("query_id", "corpus_id")

    def pairs(self, queries: DataFrame, k: int) -> DataFrame:
        """The candidates with both vectors (query_id, corpus_id, _q, _c).

        Files of vectors that repeat are a small part of what the vectors take in memory, so Spark's guess by file size would broadcast
        them through the driver; both joins are shuffled whatever it is."""
        asked = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("_q"))
        return self.candidates(queries, k).join(asked.hint("merge"), "query_id").join(self.vectors.withColumnRenamed("vector", "_c").hint("merge"), "corpus_id")

    def topk(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, corpus_id, score, rank): candidates ranked by the exact product, ties by corpus_id. A query whose lists hold fewer
        than k rows is searched exactly, so min(k, corpus) rows come back for every query; null vectors never match."""
        if not self.n:
            return topk(queries, self.vectors, k)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
        hits = self.pairs(queries, k).select("query_id", "corpus_id", F.round(dot(F.col("_q"), F.col("_c")), DIGITS).alias("score")).withColumn("rank", F.row_number().over(order))
        hits = written(hits.where(F.col("rank") <= k), "hits")
        full = hits.where(F.col("rank") == k).select("query_id")
        rest = topk(queries.join(full, "query_id", "left_anti"), self.vectors, k)
        return hits.join(full, "query_id", "left_semi").unionByName(rest.select(hits.columns))

    def figures(self, queries: DataFrame, k: int) -> DataFrame:
        """One row: queries, rows of the corpus, recall of the k nearest against the exact search, and what share of all pairs was read
        by codes and scored exactly."""
        best = topk(queries, self.vectors, k).select("query_id", "corpus_id", F.lit(1).alias("best"))
        found = self.topk(queries, k).join(best, ["query_id", "corpus_id"], "left").agg(F.count_distinct("query_id").alias("queries"), (F.count("best") / F.count("*")).alias("recall"))
        read = self.probes(queries).join(F.broadcast(self.sizes), "list").agg(F.sum("size").alias("_read"))
        scored = self.candidates(queries, k).agg(F.count("*").alias("_scored"))
        out = found.crossJoin(read).crossJoin(scored)  # one row each
        pairs = F.col("queries") * F.lit(self.n)
        return out.select("queries", F.lit(self.n).cast("long").alias("corpus"), "recall", (F.col("_read") / pairs).alias("read"), (F.col("_scored") / pairs).alias("scored"))
