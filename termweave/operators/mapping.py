"""Vocabulary maps: standardising, joining sources, de-duplicating names, splitting pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_ascii, seeded_order, strip_key
from ..runtime import written
from .ranges import numbered, parts


def std_bridge(relationship: DataFrame, kind: str = "Maps to") -> DataFrame:
    return relationship.where(F.col("relationship_id") == kind).select(F.col("concept_id_1").alias("concept_id"), F.col("concept_id_2").alias("std_concept_id"))


def split_standard(concept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(standard, others); an empty or null flag is not standard."""
    standard = F.col("standard_concept").eqNullSafe("S")
    return concept.where(standard), concept.where(~standard)


def literal_map(column: Column, table: Mapping[str, str]) -> Column:
    """Looks a value up in a small literal table; null where it is not listed."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[column]


def standardised(map_table: DataFrame, bridge: DataFrame) -> DataFrame:
    """Rows under their standard ids, with name_stripped; null and empty names go."""
    rows = map_table.where("name is not null and name <> ''").join(bridge, "concept_id")
    return rows.withColumn("concept_id", F.col("std_concept_id")).drop("std_concept_id").withColumn("name_stripped", strip_key("name"))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row a key: the first in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def union_sources(*sources: DataFrame) -> DataFrame:
    """Union by name with source_order, the place of the source, for first_wins."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_id", F.col("source_id").cast("string")).withColumn("source_order", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def without_identities(map_table: DataFrame, names: DataFrame) -> DataFrame:
    """Drops names that equal their concept's own name but for case and signs. names: concept_id, concept_name."""
    own = names.select("concept_id", strip_key("concept_name").alias("_own"))
    return map_table.join(own, "concept_id").where("name_stripped <> _own").drop("_own")


def combine(sources: Sequence[DataFrame], bridge: DataFrame, names: DataFrame) -> DataFrame:
    """The whole synonym map: union, standard ids, ASCII names, one row a (concept, stripped name), identities dropped, name_id."""
    rows = standardised(union_sources(*sources), bridge).where(is_ascii("name"))
    rows = first_wins(rows, ["concept_id", "name_stripped"], ["source_id", "source", "type", "name"])
    rows = without_identities(rows, names)
    return numbered(rows, ["concept_id", "name_stripped"]).select("concept_id", "source", "source_id", "type", "name_id", "name")


def targets(concept: DataFrame, domain: str, mapped: DataFrame) -> DataFrame:
    """Concepts of a domain that the map reaches."""
    return concept.where(F.col("domain_id") == domain).join(mapped.select("concept_id").distinct(), "concept_id", "left_semi")


def bridge_and_names(map_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    bridge = map_table.select("concept_id", "name_id").distinct()
    return bridge, first_wins(map_table.select("name_id", "source", "source_id", "type", "name"), ["name_id"], ["source", "source_id", "type", "name"])


def named_pairs(bridge: DataFrame, concepts: DataFrame, names: DataFrame) -> DataFrame:
    """The bridge's pairs with all columns of their concept (by concept_id) and name (by name_id); pairs without either go.

    Pairs are written once and dealt by their number before each join, so a task sorts no more of a larger table; the result lies by
    concept_id, and what groups by it needs no other exchange."""
    pairs = written(bridge.select("concept_id", "name_id"), "pairs")
    n = parts(bridge.sparkSession, pairs.count())
    return pairs.repartition(n, "name_id").join(names, "name_id").repartition(n, "concept_id").join(concepts, "concept_id")


def pair_frame(bridge: DataFrame, names: DataFrame, concepts: DataFrame) -> DataFrame:
    """(sentence1 = concept name, sentence2 = name, concept_id, name_id)."""
    rows = named_pairs(bridge, concepts.select("concept_id", F.col("concept_name").alias("sentence1")), names.select("name_id", F.col("name").alias("sentence2")))
    return rows.select("sentence1", "sentence2", "concept_id", "name_id")


def anchor_positive(pairs: DataFrame, anchor: str = "sentence2", positive: str = "sentence1") -> DataFrame:
    return pairs.select(F.col(anchor).alias("anchor"), F.col(positive).alias("positive")).distinct()


def split_pairs(pairs: DataFrame, n_test: int, n_valid: int, seed: int = 42, disjoint: bool = False) -> DataFrame:
    """pairs with split: n_test and n_valid concepts, drawn by seed, give one pair each; every other pair is train.

    disjoint: other pairs of held-out concepts are dropped instead of trained on. Top-n is a TakeOrdered, not a global sort.
    """
    ids = pairs.select("concept_id").distinct().withColumn("_o", seeded_order(seed, "concept_id"))
    held = ids.orderBy("_o", "concept_id").limit(n_test + n_valid)
    held = held.withColumn("_k", F.row_number().over(Window.orderBy("_o", "concept_id"))).select("concept_id", F.when(F.col("_k") <= n_test, "test").otherwise("valid").alias("_split"))
    w = Window.partitionBy("concept_id").orderBy(seeded_order(seed, "concept_id", "name_id"), "name_id")
    rows = pairs.join(held, "concept_id", "left").withColumn("_n", F.row_number().over(w))
    out = rows.withColumn("split", F.when(F.col("_split").isNotNull() & (F.col("_n") == 1), F.col("_split")).otherwise("train"))
    if disjoint:
        out = out.where("_split is null or _n = 1")
    return out.drop("_split", "_n")


def replaced(df: DataFrame, bridge: DataFrame, column: str) -> DataFrame:
    """column replaced by the bridge's target (from_id -> to_id) where it has one."""
    b = bridge.select(F.col("from_id").alias("_from"), F.col("to_id").alias("_to"))
    return df.join(b, df[column] == F.col("_from"), "left").withColumn(column, F.coalesce("_to", F.col(column))).drop("_from", "_to")


def factorized(df: DataFrame, column: str, order: str, into: str = "code") -> DataFrame:
    """Dense codes from 0 by first appearance in an order; nulls get -1. One row a distinct value is numbered, not the table."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.min(order).alias("_first"))
    codes = numbered(first, ["_first", "_v"], "_code").select("_v", (F.col("_code") - 1).alias("_code"))
    return df.join(codes, df[column] == F.col("_v"), "left").withColumn(into, F.coalesce("_code", F.lit(-1))).drop("_v", "_code")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))
