"""Scans: delimited dumps, Arrow files, multi-file unions, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import TABLES

#: Cell texts that count as missing in the pipe-delimited dumps (fixed values).
SENTINELS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """Tab-delimited with a header; empty cells stay empty strings, quotes are doubled.

    A file is split over tasks at line ends; multi_line is for files whose quoted cells span lines, and reads each file in one task.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("escape", '"').option("multiLine", multi_line).option("emptyValue", "")
    reader = reader.schema(schema) if schema is not None else reader
    df = reader.csv(path)
    return df.na.fill("", [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])


def sentinels_to_null(df: DataFrame) -> DataFrame:
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*SENTINELS), F.col(c)) for c in text})


def _pipes(spark: SparkSession, path: str, table: str) -> DataFrame:
    rows = spark.read.schema(TABLES[table]).option("sep", "|").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return sentinels_to_null(rows).drop("CVF")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Headerless pipe-delimited names (18 columns, a trailing pipe)."""
    return _pipes(spark, path, "mrconso")


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    return _pipes(spark, path, "mrdef")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Comma-delimited with a header; multi_line as in read_tsv."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_tables(spark: SparkSession, *paths: str) -> DataFrame:
    """Union by name of Parquet tables; columns that one lacks are null."""
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))
