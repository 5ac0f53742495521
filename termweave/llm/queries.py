"""The opN queries: each operator over its whole table with production parameters, reduced to digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, filter_audit
from . import line_dedup as lines
from . import media, mixing, packing, quality, repeats, secrets, token_counts, token_files
from .common import tables
from .ngram_join import near_duplicates
from .repeat_groups import repeat_groups
from .toxicity import toxicity


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_apart(tables(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(tables(spark, sf_dir))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(tables(spark, sf_dir))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(tables(spark, sf_dir))


def op4_suffix_array_dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_groups(tables(spark, sf_dir))


def _line_digests(out: DataFrame) -> DataFrame:
    text = F.coalesce("cleaned", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.char_length(text).cast("long").alias("kept_chars"), F.md5(text).alias("kept_md5"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_digests(lines.line_dedup(tables(spark, sf_dir).select("doc_id", "text")))


def op5_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_digests(lines.line_dedup(tables(spark, sf_dir).select("doc_id", "text"), lines.windows))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(tables(spark, sf_dir), tables(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(tables(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.read_token_files(token_files.write_token_files(tables(spark, sf_dir)))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(tables(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(tables(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(tables(spark, sf_dir), tables(spark, sf_dir, "labels"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(tables(spark, sf_dir))


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(tables(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_ngram_jaccard_join, op3_media_columns, op4_suffix_array_dedup, op4_suffix_array_dedup_groups, op5_line_dedup, op5_line_dedup_whole, op6_toxicity, op7_quality_rules, op8_token_binary, op9_token_counts, op10_source_mixing, op11_filter_interaction_audit, op12_cross_tokenizer_alignment, op13_secret_scans)
}
ORACLES: dict[str, str] = {"op5_line_dedup": lines.ORACLE, "op5_line_dedup_whole": lines.ORACLE_WINDOWS, "op7_quality_rules": quality.ORACLE, "op10_source_mixing": mixing.ORACLE, "op11_filter_interaction_audit": filter_audit.ORACLE, "op13_secret_scans": secrets.ORACLE}
