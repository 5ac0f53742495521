"""Mixing sources to target weights by Pareto order sampling. Native expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BUCKETS = 16384


def _targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size): shares by weight, each at most `most` times its size."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    sizes = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.withColumns({"cap": most * F.col("source_size"), "total": share * F.sum("source_size").over(every)})
    before = F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("total") - before) / F.sum("w").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sizes = sizes.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    sizes = sizes.withColumn("water", F.max(F.when(~F.col("full"), F.struct(-F.col("cap") / F.col("w"), "level"))).over(every)["level"])
    return sizes.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("water") * F.col("w")).alias("target"))


def _inclusion(classes: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """(source, source_size, target, left, rules): by bits, whole copies and inclusion probability p of the documents of a size class.

    Expected copies are proportional to bits and stop at `most`; the factor is that of the first class, from the largest down, that
    it leaves at `most` or below when all larger ones are given `most`. left: words of the target beyond the whole copies.
    """
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    rows = classes.join(t, classes["source"].eqNullSafe(F.col("_s"))).drop("_s")
    down = Window.partitionBy("source").orderBy(F.desc("bits"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("bits") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumns({"above": above, "below": below})
    rows = rows.withColumn("level", F.when(F.col("below") > 0, (F.col("target") - most * F.col("above")) / F.col("below")))
    every = Window.partitionBy("source")
    rows = rows.withColumn("factor", F.max(F.when(F.col("level") * F.col("bits") <= most, F.struct("bits", "level"))).over(every)["level"])
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.coalesce(F.col("factor") * F.col("bits"), F.lit(most)))).otherwise(0.0)
    rows = rows.withColumn("copies", copies).withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    rows = rows.withColumn("left", F.greatest(F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every), F.lit(0.0)))
    rule = F.map_from_entries(F.collect_list(F.struct("bits", F.struct("whole", "p"))))
    return rows.groupBy(F.col("source").alias("_s"), "source_size", "target", "left").agg(rule.alias("rules"))


def _ranked(rows: DataFrame, rules: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id, source, size, bits) with their rule, rank (odds of a random number over inclusion odds) and bucket of the rank.

    The join is by source alone, null-safe, so nothing is derived of size that would count its words again.
    """
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    rows = rows.join(rules, rows["source"].eqNullSafe(F.col("_s"))).drop("_s").withColumn("rule", F.col("rules")[F.col("bits")])
    rows = rows.withColumns({"whole": F.col("rule.whole"), "p": F.col("rule.p"), "u": draw}).drop("rules", "rule")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    return rows.withColumn("rank", F.when(F.col("p") > 0, odds)).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS))


def _sized(docs: DataFrame, *keep: str) -> DataFrame:
    size = word_count(F.col("text"))
    return docs.select("doc_id", "source", size.alias("size"), *keep).withColumn("bits", F.length(F.bin("size")))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of docs (doc_id, text, source), and the columns named in keep.

    Sources in code point order, null last, weigh `weights` in turn and share `share` times all words; a target stops at `most`
    times its source's size and the excess is shared again by weight (closed form over sources sorted by size over weight).
    In a source a document's expected copies are proportional to the binary digits of its size and stop at `most`; the factor makes
    the expected words the target. Whole expected copies are certain; what is left of them is the document's inclusion probability p,
    and a Pareto order sample of the words that are left is taken: documents ranked by the odds of a random number, a hash of
    doc_id, over the odds of p, up to the document whose middle passes those words. Reruns agree.

    Only numbers are gathered: words by source and digits, then by 16384 ranges of rank, and the documents of the one range that holds
    the end of a source's sample are sorted, so a source with a third of all rows is no single task. Each document is then decided by
    itself against its source's end. Null or empty texts have size 0 and change nothing; a null source is a source; a null doc_id has
    one random number; ties go by doc_id and size; repeated rows are taken alike; a text longer than a target is taken if its middle
    fits; an empty table gives an empty result; other columns, of any name, are ignored unless kept.
    """
    base = written(_sized(docs), "sizes")
    classes = small_side(base.groupBy("source", "bits").agg(F.sum("size").alias("words")), "classes")
    targets = _targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    rules = small_side(_inclusion(classes, targets, most), "rules")
    rows = _ranked(base, rules, seed).where("p > 0")
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0))).withColumn("end", F.col("before") + F.col("words"))
    edge = parts.where("before <= left and end > left").groupBy(F.col("source").alias("_e")).agg(F.min("bucket").alias("edge"), F.min_by("before", "bucket").alias("before"))
    edge = small_side(edge, "edges")
    near = rows.join(edge, rows["source"].eqNullSafe(F.col("_e")) & (rows["bucket"] == F.col("edge")))
    near = near.groupBy("_e", "edge", "before", "left", "rank", "doc_id", "size").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("_e").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("middle", F.col("before") + F.sum("words").over(upto) - F.col("words") / 2)
    last = near.groupBy("_e", "edge").agg(F.max(F.when(F.col("middle") <= F.col("left"), _place())).alias("last"))
    rules = small_side(rules.join(last, F.col("_s").eqNullSafe(F.col("_e")), "left").drop("_e"), "decisions")
    out = _ranked(_sized(docs, *keep), rules, seed)
    inside = F.col("edge").isNull() | (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & F.coalesce(_place() <= F.col("last"), F.lit(False)))
    copies = (F.col("whole") + ((F.col("p") > 0) & inside).cast("int")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *keep)


def _place() -> Column:
    return F.struct("rank", "doc_id", "size")


ORACLE = r"""
WITH b AS (SELECT *, length(bin(size)) k FROM (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT size FROM documents)),
s AS (SELECT source, sum(size)::BIGINT z, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE w FROM b GROUP BY source),
r AS (SELECT *, (2.0 * z)::DOUBLE cap, (1.5 * sum(z) OVER ())::DOUBLE total FROM s),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) level FROM r),
f AS (SELECT *, level * w >= cap f FROM v),
t AS (SELECT source, z, CASE WHEN f THEN cap ELSE (SELECT level FROM f WHERE NOT f ORDER BY cap / w LIMIT 1) * w END target FROM f),
c AS (SELECT source, k, sum(size)::BIGINT words FROM b GROUP BY source, k),
l AS (SELECT c.*, z, target, coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE above,
    (sum(k * words) OVER (PARTITION BY c.source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE below FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, CASE WHEN below > 0 THEN (target - 2.0::DOUBLE * above) / below END level FROM l),
n AS (SELECT *, max_by(level, k) FILTER (level * k <= 2.0) OVER (PARTITION BY source) factor FROM m),
e AS (SELECT *, CASE WHEN z > 0 THEN least(2.0::DOUBLE, coalesce(factor * k, 2.0::DOUBLE)) ELSE 0.0::DOUBLE END copies FROM n),
i AS (SELECT source, k, z, target, floor(copies) whole, copies - floor(copies) p, greatest(target - sum(floor(copies) * words) OVER (PARTITION BY source), 0.0) lft FROM e),
d AS (SELECT b.*, z, target, whole, p, lft, (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u FROM b JOIN i ON b.source IS NOT DISTINCT FROM i.source AND b.k = i.k),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END odds FROM d),
g AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds NULLS FIRST, doc_id NULLS FIRST, size) upto, sum(size) OVER (PARTITION BY source, odds, doc_id, size) own FROM o)
SELECT doc_id, size, z AS source_size, target, (size * (whole + CASE WHEN p > 0 AND upto - own / 2.0 <= lft THEN 1 ELSE 0 END))::BIGINT taken FROM g
"""
