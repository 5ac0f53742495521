"""The generated star-schema tables in the roles of vocabulary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mining
from ..operators.ranges import parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def concept(spark: SparkSession, d: str) -> DataFrame:
    """part as concepts; every second size is standard."""
    flag = F.when(F.col("p_size") % 2 == 0, "S").when(F.col("p_size") % 3 == 0, "")
    return table(spark, d, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_name"), F.col("p_type").alias("domain_id"), F.col("p_brand").alias("vocabulary_id"), flag.alias("standard_concept"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("concept_code"))


CONCEPT = "concept AS (SELECT p_partkey concept_id, p_name concept_name, p_type domain_id, p_brand vocabulary_id, CASE WHEN p_size % 2 = 0 THEN 'S' WHEN p_size % 3 = 0 THEN '' END standard_concept, 'C' || p_partkey concept_code FROM part)"


def bridge(spark: SparkSession, d: str) -> DataFrame:
    """Parts to suppliers, as concept to name; dealt by the number of line items, so a task tells no more of a larger table apart."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("concept_id"), F.col("l_suppkey").alias("name_id"))
    return rows.repartition(parts(spark, rows.count()), "concept_id").distinct()


BRIDGE = "bridge AS (SELECT DISTINCT l_partkey concept_id, l_suppkey name_id FROM lineitem)"


def std_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Parts to a standard part, many to one."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("concept_id"), (F.col("p_partkey") - F.col("p_partkey") % 4).alias("std_concept_id"))


STD = "std_bridge AS (SELECT p_partkey concept_id, p_partkey - p_partkey % 4 std_concept_id FROM part)"


def synonyms(spark: SparkSession, d: str) -> list[DataFrame]:
    """Two synonym sources over parts: their names, and names made of brand and type."""
    p = table(spark, d, "part")
    one = p.select(F.col("p_partkey").alias("concept_id"), F.lit("A").alias("source"), F.col("p_partkey").cast("string").alias("source_id"), F.lit("STR").alias("type"), F.col("p_name").alias("name"))
    two = p.select(F.col("p_partkey").alias("concept_id"), F.lit("B").alias("source"), F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("source_id"), F.lit("synonym").alias("type"), F.when(F.col("p_size") % 7 == 0, F.concat("p_brand", F.lit(" é"))).when(F.col("p_size") % 5 > 0, F.concat_ws(" ", F.upper("p_name"), F.col("p_brand"))).otherwise(F.lit("")).alias("name"))
    return [one, two]


SYN = """syn AS (SELECT p_partkey concept_id, 'A' source, p_partkey::VARCHAR source_id, 'STR' AS type, p_name AS name FROM part
 UNION ALL SELECT p_partkey, 'B', 'b' || p_partkey, 'synonym', CASE WHEN p_size % 7 = 0 THEN p_brand || ' é' WHEN p_size % 5 > 0 THEN upper(p_name) || ' ' || p_brand ELSE '' END FROM part)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """region > nation > customer as a closure (ancestor, descendant, level); ids are offset by a million a step."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long"))
    rn = n.select(F.col("n_regionkey").alias("ancestor"), (F.col("n_nationkey") + 1000000).alias("descendant"), F.lit(1).alias("level"))
    nc = c.select((F.col("c_nationkey") + 1000000).alias("ancestor"), (F.col("c_custkey") + 2000000).alias("descendant"), F.lit(1).alias("level"))
    rc = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("ancestor"), (F.col("c_custkey") + 2000000).alias("descendant"), F.lit(2).alias("level"))
    return rn.unionByName(nc).unionByName(rc)


EDGES = """edges AS (SELECT n_regionkey::BIGINT ancestor, n_nationkey::BIGINT + 1000000 descendant, 1 AS level FROM nation
 UNION ALL SELECT c_nationkey::BIGINT + 1000000, c_custkey + 2000000, 1 FROM customer
 UNION ALL SELECT n_regionkey::BIGINT, c_custkey + 2000000, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("concept_id"), F.col("r_name").alias("concept_name"), F.lit("region").alias("domain_id"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long") + 1000000, "n_name", F.lit("nation"))
    c = table(spark, d, "customer").select(F.col("c_custkey") + 2000000, "c_name", F.lower("c_mktsegment"))
    return r.union(n).union(c)


NODES = """nodes AS (SELECT r_regionkey::BIGINT concept_id, r_name concept_name, 'region' domain_id FROM region
 UNION ALL SELECT n_nationkey::BIGINT + 1000000, n_name, 'nation' FROM nation UNION ALL SELECT c_custkey + 2000000, c_name, lower(c_mktsegment) FROM customer)"""


#: The columns of queries and corpus whose equal values make positives.
LABELS = ("query_label", "label")


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, corpus, positives): every vector queries all; an equal label elsewhere is a positive."""
    e = table(spark, d, "embeddings")
    name = F.concat(F.lit("Term "), (F.col("vec_id") % 40).cast("string"))
    corpus = e.select(F.col("vec_id").alias("corpus_id"), name.alias("corpus_name"), F.col("embedding").alias("vector"), "label")
    queries = e.select(F.col("vec_id").alias("query_id"), F.lower(name).alias("query_name"), F.col("embedding").alias("vector"), F.col("label").alias("query_label"))
    pos = mining.group_pairs(queries.select("query_id", "query_label"), corpus.select("corpus_id", "label"), LABELS).select("query_id", "corpus_id")
    return queries, corpus, pos


SIM = """q AS (SELECT vec_id query_id, 'term ' || (vec_id % 40) query_name, embedding::DOUBLE[] qv, label ql FROM embeddings),
c AS (SELECT vec_id corpus_id, 'Term ' || (vec_id % 40) corpus_name, embedding::DOUBLE[] cv, label cl FROM embeddings),
s AS MATERIALIZED (SELECT query_id, query_name, ql, corpus_id, corpus_name, cl, round(list_inner_product(qv, cv), 9) score FROM q, c),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) rnk FROM s),
pos AS MATERIALIZED (SELECT a.vec_id query_id, b.vec_id corpus_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)"""


def parents(spark: SparkSession, d: str) -> DataFrame:
    """A label tree over the vectors: each vector's parents are two vectors of smaller id."""
    e = table(spark, d, "embeddings").where("vec_id > 0").select(F.col("vec_id").alias("concept_id"), F.explode(F.array(F.floor(F.col("vec_id") / 2).cast("long"), F.floor(F.col("vec_id") / 3).cast("long"))).alias("parent_id"))
    return e.distinct()


PARENTS = "parents AS (SELECT DISTINCT vec_id concept_id, unnest([vec_id // 2, vec_id // 3]) parent_id FROM embeddings WHERE vec_id > 0)"
