"""Concept hierarchy: edges (ancestor, descendant, level) and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PARENT_TOKEN, sentence_name


def edges_between(edges: DataFrame, ids: DataFrame, low: int = 1, high: int = 2) -> DataFrame:
    """Distinct edges of levels low..high whose two ends are in ids (concept_id)."""
    i = ids.select("concept_id").distinct()
    out = edges.where(F.col("level").between(low, high))
    out = out.join(i.withColumnRenamed("concept_id", "ancestor"), "ancestor", "left_semi").join(i.withColumnRenamed("concept_id", "descendant"), "descendant", "left_semi")
    return out.groupBy("ancestor", "descendant").agg(F.min("level").alias("level"))


def edges_touching(edges: DataFrame, targets: DataFrame, standard: DataFrame) -> DataFrame:
    """Level-1 edges between standard ids with at least one end in targets."""
    s = standard.select("concept_id").distinct()
    t = targets.select("concept_id").distinct().withColumn("_t", F.lit(True))
    out = edges.where("level = 1").join(s.withColumnRenamed("concept_id", "ancestor"), "ancestor", "left_semi").join(s.withColumnRenamed("concept_id", "descendant"), "descendant", "left_semi")
    out = out.join(t.select(F.col("concept_id").alias("ancestor"), F.col("_t").alias("_a")), "ancestor", "left").join(t.select(F.col("concept_id").alias("descendant"), F.col("_t").alias("_d")), "descendant", "left")
    return out.where("_a or _d").select("ancestor", "descendant", "level")


def both_ways(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("ancestor").alias("from_id"), F.col("descendant").alias("to_id"), "level", F.lit("ancestor_to_descendant").alias("type"))
    up = edges.select(F.col("descendant").alias("from_id"), F.col("ancestor").alias("to_id"), "level", F.lit("descendant_to_ancestor").alias("type"))
    return down.unionByName(up)


def relation_maps(edges: DataFrame) -> DataFrame:
    """For each id parallel arrays of neighbours, levels and types, in order of (to_id, type)."""
    rows = F.array_sort(F.collect_list(F.struct("to_id", "type", "level")))
    return both_ways(edges).groupBy("from_id").agg(rows.alias("r")).select("from_id", F.col("r.to_id").alias("to_id"), F.col("r.level").alias("level"), F.col("r.type").alias("type"))


def neighbours(edges: DataFrame) -> DataFrame:
    """parents and children of each id at level 1, as sorted arrays."""
    e = edges.where("level = 1")
    up = e.groupBy(F.col("descendant").alias("concept_id")).agg(F.sort_array(F.collect_set("ancestor")).alias("parents"))
    down = e.groupBy(F.col("ancestor").alias("concept_id")).agg(F.sort_array(F.collect_set("descendant")).alias("children"))
    empty = F.array().cast("array<bigint>")
    return up.join(down, "concept_id", "full").select("concept_id", F.coalesce("parents", empty).alias("parents"), F.coalesce("children", empty).alias("children"))


def distance(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (a, b) with distance: the edge's level in either direction, else the least sum over a common ancestor, else null."""
    e = edges.groupBy("ancestor", "descendant").agg(F.min("level").alias("level"))
    p = pairs.select("a", "b").distinct()
    direct = p.join(e, ((F.col("a") == F.col("ancestor")) & (F.col("b") == F.col("descendant"))), "left").select("a", "b", F.col("level").alias("d1"))
    direct = direct.join(e, ((F.col("b") == F.col("ancestor")) & (F.col("a") == F.col("descendant"))), "left").select("a", "b", "d1", F.col("level").alias("d2"))
    ea = e.select(F.col("descendant").alias("a"), F.col("ancestor").alias("_p"), F.col("level").alias("la"))
    eb = e.select(F.col("descendant").alias("b"), F.col("ancestor").alias("_p"), F.col("level").alias("lb"))
    common = p.join(ea, "a").join(eb, ["b", "_p"]).groupBy("a", "b").agg(F.min(F.col("la") + F.col("lb")).alias("d3"))
    dist = direct.join(common, ["a", "b"], "left").select("a", "b", F.coalesce(F.least("d1", "d2"), "d1", "d2", "d3").alias("distance"))
    return pairs.join(dist, ["a", "b"], "left")


def expanded(ids: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, concept_id, hop): what is reached from each seed within `hops` steps along level-1 edges either way."""
    step = both_ways(edges.where("level = 1")).select("from_id", "to_id").distinct()
    reach = ids.select(F.col("concept_id").alias("seed"), "concept_id").distinct().withColumn("hop", F.lit(0))
    last = reach
    for h in range(1, hops + 1):
        last = last.join(step, last["concept_id"] == step["from_id"]).select("seed", F.col("to_id").alias("concept_id")).distinct()
        last = last.join(reach.select("seed", "concept_id"), ["seed", "concept_id"], "left_anti").withColumn("hop", F.lit(h))
        reach = reach.unionByName(last)
    return reach


def combined_score(df: DataFrame, semantic: str = "score", dist: str = "distance") -> DataFrame:
    """0.7 semantic + 0.3 exp(-distance / 2), plus 0.1 for a direct edge and 0.1 for the same non-empty domain."""
    near = F.when(F.col(dist).isNotNull(), 0.3 * F.exp(-F.col(dist) / 2.0)).otherwise(0.0)
    edge = F.when(F.col(dist) == 1, 0.1).otherwise(0.0)
    same = F.when((F.col("domain_a") == F.col("domain_b")) & (F.col("domain_a") != ""), 0.1).otherwise(0.0)
    return df.withColumn("combined", 0.7 * F.col(semantic) + near + edge + same)


def overlap(targets: DataFrame, boosts: DataFrame) -> DataFrame:
    """Sizes of two id sets and of what they share."""
    t, b = targets.select("concept_id").distinct(), boosts.select("concept_id").distinct()
    flags = t.withColumn("t", F.lit(1)).join(b.withColumn("b", F.lit(1)), "concept_id", "full")
    one = F.coalesce(F.sum("t"), F.lit(0)).cast("long"), F.coalesce(F.sum("b"), F.lit(0)).cast("long"), F.coalesce(F.sum(F.col("t") * F.col("b")), F.lit(0)).cast("long")
    return flags.agg(one[0].alias("n_target"), one[1].alias("n_boost"), one[2].alias("n_both"))


def named_parents(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(concept_id, parent_id, parent_name) at level 1; a parent without a name is Unknown."""
    e = edges.where("level = 1").select(F.col("descendant").alias("concept_id"), F.col("ancestor").alias("parent_id")).distinct()
    return e.join(names.select(F.col("concept_id").alias("parent_id"), F.col("concept_name").alias("parent_name")), "parent_id", "left").select("concept_id", "parent_id", F.coalesce("parent_name", F.lit("Unknown")).alias("parent_name"))


def relation_names(edges: DataFrame, names: DataFrame, token: str = PARENT_TOKEN) -> DataFrame:
    """(concept_id = ancestor, name_id = descendant, name = token + descendant's name, source, type)."""
    n = names.select(F.col("concept_id").alias("descendant"), "concept_name")
    return edges.join(n, "descendant").select(F.col("ancestor").alias("concept_id"), F.col("descendant").alias("name_id"), F.concat(F.lit(token), "concept_name").alias("name"), F.lit("relation").alias("source"), F.lit("descendant").alias("type"))


def relation_sentences(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """sentence1, sentence2: "Domain: name" of both ends, with their ids and label 1."""
    c = concepts.select("concept_id", sentence_name("domain_id", "concept_name").alias("s"))
    a = c.select(F.col("concept_id").alias("ancestor"), F.col("s").alias("sentence1"))
    d = c.select(F.col("concept_id").alias("descendant"), F.col("s").alias("sentence2"))
    return edges.join(a, "ancestor", "left").join(d, "descendant", "left").select("sentence1", "sentence2", F.col("ancestor").alias("concept_id1"), F.col("descendant").alias("concept_id2"), F.lit(1).alias("label"))


def parent_summary(pairs: DataFrame) -> DataFrame:
    """pairs (parent, child, similarity1, similarity2, in_relation) by parent: counts and mean similarities."""
    return pairs.groupBy("parent").agg(F.count("child").alias("num_child"), F.sum("in_relation").alias("num_child_relation"), F.avg("similarity1").alias("similarity1"), F.avg("similarity2").alias("similarity2"))
