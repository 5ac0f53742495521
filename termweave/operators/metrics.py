"""Ranking and classification metrics as aggregates and windows; ties are handled exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running

CUTS = (1, 3, 5, 10, 20, 50, 100)


def _by_score(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """One row a distinct score with its positives and negatives and the running sums from the top. weight: for how many pairs a row
    stands, one if not named."""
    n = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    g = df.groupBy(F.col(score).alias("s")).agg(F.sum(n * F.col(label)).alias("tp"), F.sum(n * (1.0 - F.col(label))).alias("fp"))
    return running(g, [F.desc("s")], ctp="tp", cfp="fp")


def roc_auc(df: DataFrame, score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """roc_auc; null with one class only. Sums run over ranges of distinct scores."""
    t = _by_score(df, score, label, weight).agg(F.sum(F.col("fp") * (F.col("ctp") - F.col("tp") / 2)).alias("a"), F.sum("tp").alias("p"), F.sum("fp").alias("n"))
    return t.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("a") / (F.col("p") * F.col("n"))).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    t = _by_score(df, score, label, weight).agg(F.sum(F.col("tp") * F.col("ctp") / (F.col("ctp") + F.col("cfp"))).alias("a"), F.sum("tp").alias("p"))
    return t.select(F.when(F.col("p") > 0, F.col("a") / F.col("p")).alias("average_precision"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def threshold_metrics(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.8, weight: str | None = None) -> DataFrame:
    """precision, recall, f1 (0 where undefined) and accuracy at score >= threshold."""
    hit = F.col(score) >= threshold
    n = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    right = hit.cast("int") == F.col(label)
    t = df.agg(F.sum(n * (hit & (F.col(label) == 1)).cast("double")).alias("tp"), F.sum(n * (hit & (F.col(label) == 0)).cast("double")).alias("fp"), F.sum(n * (~hit & (F.col(label) == 1)).cast("double")).alias("fn"), (F.sum(n * right.cast("double")) / F.sum(F.when(right.isNotNull(), n))).alias("accuracy"))
    t = t.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return t.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("precision", "recall", "f1", "accuracy")


def query_ranks(df: DataFrame, query: str = "query_id", score: str = "score", label: str = "label", tie: str = "corpus_id") -> DataFrame:
    """For each query the 0-based places of its best and worst positive; null without one."""
    w = Window.partitionBy(query).orderBy(F.desc(score), tie)
    rows = df.where(F.col(query).isNotNull()).withColumn("_i", F.row_number().over(w) - 1)
    at = F.when(F.col(label) == 1, F.col("_i"))
    return rows.groupBy(query).agg(F.min(at).alias("best"), F.max(at).alias("worst"))


def ranking_metrics(df: DataFrame, cuts: Sequence[int] = CUTS, **names: str) -> DataFrame:
    """best_/worst_ hit@k and reciprocal rank, averaged over queries; a query without a positive counts 0."""
    return metrics_of_ranks(query_ranks(df, **names), cuts)


def metrics_of_ranks(ranks: DataFrame, cuts: Sequence[int] = CUTS) -> DataFrame:
    """The same from each query's places (best, worst)."""
    out = []
    for which in ("best", "worst"):
        out += [F.avg(F.coalesce((F.col(which) < k).cast("double"), F.lit(0.0))).alias(f"{which}_hit_{k}") for k in cuts]
        out.append(F.avg(F.coalesce(1.0 / (F.col(which) + 1), F.lit(0.0))).alias(f"{which}_reciprocal_rank"))
    return ranks.agg(*out)


def positions(ranked: Column, truth: Column) -> Column:
    """0-based place of each true id in a ranked list; null where it is missing."""
    return F.transform(truth, lambda x: F.nullif(F.array_position(ranked, x), F.lit(0)) - 1)


def multi_target_score(places: Column, missing: int = 99999) -> Column:
    """The least k that covers all targets, less the targets beside it: max(place) - n + 2; 99999 if one is missing."""
    return F.when(F.exists(places, lambda x: x.isNull()), F.lit(missing).cast("long")).otherwise(F.array_max(places) - F.size(places) + 2)


def topk_accuracy(df: DataFrame, score: str, cuts: Sequence[int] = (1, 10, 50)) -> DataFrame:
    rows = df.select(score, F.explode(F.array(*[F.lit(k) for k in cuts])).alias("k"))
    return rows.groupBy("k").agg(F.avg((F.col(score) <= F.col("k")).cast("double")).alias("accuracy"))


def at_k(df: DataFrame, ranked: str, truth: str, cuts: Sequence[int] = (1, 10, 50)) -> DataFrame:
    """accuracy, precision, recall and f1 at k where every query is a positive."""
    rows = df.select(ranked, truth, F.explode(F.array(*[F.lit(k) for k in cuts])).alias("k"))
    hit = F.array_contains(F.slice(F.col(ranked), F.lit(1), F.col("k")), F.col(truth))
    t = rows.groupBy("k").agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("accuracy"))
    t = t.withColumns({"precision": F.when(F.col("accuracy") > 0, 1.0).otherwise(0.0), "recall": F.col("accuracy")})
    return t.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def list_mrr(df: DataFrame, ranked: str, truth: str) -> DataFrame:
    place = F.nullif(F.array_position(F.col(ranked), F.col(truth)), F.lit(0))
    return df.agg(F.avg(F.coalesce(1.0 / place, F.lit(0.0))).alias("mrr"))


def long_metrics(row: DataFrame, model: str, prefix: str = "") -> DataFrame:
    """A one-row metric frame as (metric, model, value)."""
    return row.unpivot([], row.columns, "metric", "value").select(F.concat(F.lit(prefix), "metric").alias("metric"), F.lit(model).alias("model"), "value")


def compared(*frames: DataFrame, models: Sequence[str]) -> DataFrame:
    """Metrics by model, one row a metric."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))


def first_hit_wrong(df: DataFrame, query: str = "query_id", score: str = "score", label: str = "label", tie: str = "corpus_id") -> DataFrame:
    """All rows of the queries whose best hit is no positive."""
    w = Window.partitionBy(query).orderBy(F.desc(score), tie)
    return df.withColumn("_f", F.first(label).over(w)).where("_f <> 1").drop("_f")


def evaluated(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """All metrics of a scored, labelled frame in one row."""
    return roc_auc(df).crossJoin(average_precision(df)).crossJoin(threshold_metrics(df, threshold=threshold)).crossJoin(ranking_metrics(df))
