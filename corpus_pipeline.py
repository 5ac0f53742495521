"""Corpus preparation: quality rules, line dedup, near duplicates, source mixing, packing.

Each stage reads all that its predecessor wrote; all but the last return the columns of documents. What holds for every stage: an
empty table gives an empty result; other columns than those of documents are ignored; texts of any length are read whole; a lost
executor repeats part of one stage. Null and empty texts, null doc_ids and sources, ties and repeated rows: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import tables, written
from termweave.llm.line_dedup import line_dedup, windows
from termweave.llm.mixing import mix
from termweave.llm.ngram_join import near_duplicates
from termweave.llm.packing import pack
from termweave.llm.quality import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("text", F.col(text)).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail. Null and empty texts fail and go; a null doc_id or source stays as
    it is; each row is judged by itself, so repeated rows alike."""
    return _with_text(quality(docs).where("kept"), "cleaned")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of two lines or more that an earlier place has. Null and empty texts, and rows with a null
    doc_id, stay as they are; the place with the smallest (doc_id, line) keeps a passage; repeated rows are one document."""
    return _with_text(line_dedup(docs, windows), "cleaned")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id. Empty texts link with nothing and stay,
    as do rows with a null doc_id; repeated rows of a document that stays are kept."""
    found = near_duplicates(docs)
    leave = found.where("component_id <> doc_id").select("doc_id")
    return docs.join(leave, "doc_id", "left_anti").select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; repeated rows are taken alike. Empty texts weigh nothing; a null source is one."""
    taken = mix(docs, keep=["text", "lang", "n_chars"]).where("copies > 0")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word in one bin. One document of each near-duplicate group is left by now, so a cluster is the copies of a text, and they
    lie in different bins; empty texts are pieces of length 0; a null doc_id or source is packed like others."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_dup_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
#: Near duplicates and packing are beyond SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir).select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
