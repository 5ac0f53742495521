"""Data-quality audits as plans: each returns rows to read, none loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import integer_suffix, same_text, strip_prefix


def label_profile(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows by label, nulls and unknown values apart (status ok, null, invalid)."""
    status = F.when(F.col(label).isNull(), "null").when(F.col(label).isin(0, 1), "ok").otherwise("invalid")
    return df.groupBy(F.col(label).cast("long").alias("label"), status.alias("status")).agg(F.count("*").alias("n"))


def pair_flag(df: DataFrame, pairs: DataFrame, on: Sequence[str], into: str) -> DataFrame:
    """Whether a row's key is among the pairs."""
    return df.join(pairs.select(*on).distinct().withColumn(into, F.lit(True)), list(on), "left").withColumn(into, F.coalesce(into, F.lit(False)))


def label_accuracy(df: DataFrame, pairs: DataFrame, on: Sequence[str], primary: Column | None = None) -> DataFrame:
    """expected_label and outcome: correct, wrong, or manual_review for rows that are not of the primary source."""
    rows = pair_flag(df, pairs, on, "_in").withColumn("expected_label", F.col("_in").cast("int")).drop("_in")
    outcome = F.when(F.col("label").eqNullSafe(F.col("expected_label")), "correct").otherwise("wrong")
    return rows.withColumn("outcome", outcome if primary is None else F.when(~F.coalesce(primary, F.lit(False)), "manual_review").otherwise(outcome))


def false_positive_audit(df: DataFrame, pairs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Mined negatives that have another label than 0 or are true pairs (issue), with counts."""
    rows = pair_flag(df, pairs, on, "_in")
    issue = F.when(~F.col("label").eqNullSafe(F.lit(0)), "label_not_zero").when(F.col("_in"), "true_pair").otherwise("none")
    return rows.groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


def name_alignment(df: DataFrame, names: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """Rows whose name is not the id's name: status missing or different, with the expected name. names: id, name."""
    rows = df.join(names.select(F.col("id").alias("_id"), F.col("name").alias("expected")), F.col(id_column) == F.col("_id"), "left").drop("_id")
    status = F.when(F.col("expected").isNull(), "missing").when(~same_text(name_column, "expected"), "different").otherwise("ok")
    return rows.withColumn("status", status)


def reverse_lookup(df: DataFrame, names: DataFrame, name_column: str) -> DataFrame:
    """The smallest id that a provided name belongs to, synonyms included."""
    back = names.groupBy(F.lower(F.trim("name")).alias("_k")).agg(F.min("id").alias("found_id"))
    return df.join(back, F.lower(F.trim(F.col(name_column))) == F.col("_k"), "left").drop("_k")


def identical_names(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(same_text(a, b))


def issues(df: DataFrame, issue: str, keys: Sequence[str], most: int = 10) -> DataFrame:
    """The first distinct rows of each issue, with the issue's total of distinct rows."""
    once = df.select(issue, *keys).distinct()
    w = Window.partitionBy(issue)
    return once.withColumns({"total": F.count("*").over(w), "no": F.row_number().over(w.orderBy(*keys))}).where(F.col("no") <= most)


def generator_validity(rows: DataFrame, positives: DataFrame, prefix: bool = False) -> DataFrame:
    """rows (concept_id, sentence, label) by outcome: label 1 must be a known pair; label 0 must not, unless the sentence names
    several concepts (ambiguous). prefix: a leading <|...|> token is taken off the sentences of the stream first."""
    if prefix:
        rows = rows.withColumn("sentence", strip_prefix("sentence"))
    many = positives.select("concept_id", "sentence").distinct().groupBy("sentence").agg(F.count("*").alias("_c"))
    flagged = pair_flag(rows, positives, ["concept_id", "sentence"], "_in").join(many, "sentence", "left")
    ok = F.when(F.col("label") == 1, F.col("_in")).otherwise(~F.col("_in"))
    outcome = F.when(ok, "valid").when((F.col("label") == 0) & (F.col("_c") > 1), "ambiguous").otherwise("invalid")
    return flagged.groupBy("label", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def kind_label_conflicts(rows: DataFrame, kind: str = "from") -> DataFrame:
    """Rows by kind whose label contradicts it."""
    wrong = (F.col(kind) == "positive") != (F.col("label") == 1)
    return rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(wrong.cast("long")).alias("n_conflicts"))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls by column in one pass."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return counts.unpivot([], counts.columns, "column_name", "n_null").withColumn("n_null", F.coalesce("n_null", F.lit(0)).cast("long"))


def array_lengths(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Rows whose parallel arrays differ in length, and the total length of each array."""
    first = F.size(arrays[0])
    differ = F.lit(False)
    for a in arrays[1:]:
        differ = differ | ~F.size(a).eqNullSafe(first)
    return df.agg(F.sum(differ.cast("long")).alias("n_unequal"), *[F.sum(F.greatest(F.size(a), F.lit(0))).cast("long").alias(f"total_{a}") for a in arrays])


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values that only one side has."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def latest(paths: DataFrame, path: str = "path") -> DataFrame:
    """The path with the largest number at its end, a checkpoint's; paths without one do not count."""
    rows = paths.withColumn("_n", integer_suffix(path)).where("_n is not null")
    return rows.agg(F.max_by(path, "_n").alias("path"), F.max("_n").alias("number"))


#: Bytes of a value by type; other types count by their length as text or, for arrays, by their elements.
_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def _bytes(column: Column, kind: T.DataType) -> Column:
    width = _WIDTH.get(kind.simpleString())
    if width:
        size = F.lit(width)
    elif isinstance(kind, T.ArrayType):
        inner = _WIDTH.get(kind.elementType.simpleString())
        size = F.size(column) * inner if inner else F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(_bytes(x, kind.elementType), F.lit(0).cast("long")))
    else:
        size = F.octet_length(column if isinstance(kind, T.StringType | T.BinaryType) else column.cast("string"))
    return F.when(column.isNotNull(), size).otherwise(0).cast("long")


def sketches(df: DataFrame, *by: str) -> DataFrame:
    """A row a column (and group of `by`): column_name, type, rows, n_null, bytes, distincts and quantiles, the last two as sketches.

    One pass with partial aggregation, whatever the number of columns; sketches have a bounded size and merge, so profiles of parts, or
    of yesterday's table and today's rows, add up with merged_sketches. Numbers have quantiles, all columns distincts.
    """
    out = []
    for f in df.schema.fields:
        if f.name in by:
            continue
        c, kind = F.col(f"`{f.name}`"), f.dataType
        numeric = isinstance(kind, T.NumericType)
        whole = isinstance(kind, T.IntegerType | T.LongType | T.StringType | T.BinaryType)
        text = c if whole else F.to_json(F.struct(c)) if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else c.cast("string")
        sketch = F.kll_sketch_agg_double(c.cast("double")) if numeric else F.lit(None).cast("binary")
        known = F.when(c.isNotNull(), text)
        out.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(kind.simpleString()).alias("type"), F.count("*").alias("rows"), F.sum(c.isNull().cast("long")).alias("n_null"), F.sum(_bytes(c, kind)).alias("bytes"), F.hll_sketch_agg(known).alias("distincts"), sketch.alias("quantiles")))
    return df.groupBy(*by).agg(F.array(*out).alias("_s")).select(*by, F.inline("_s"))


def merged_sketches(found: DataFrame, *by: str) -> DataFrame:
    """Rows of sketches() of several parts as those of the whole, by column (and group of `by`)."""
    sums = [F.sum(c).alias(c) for c in ("rows", "n_null", "bytes")]
    return found.groupBy(*by, "column_name", "type").agg(*sums, F.hll_union_agg("distincts").alias("distincts"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def table_profile(found: DataFrame, cuts: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Rows of sketches() read: rows, nulls and bytes are exact, n_distinct and the quantiles (an array, null unless numeric) estimates."""
    known = F.col("type").rlike("^(tiny|small|big)?int|^float|^double|^decimal") & (F.col("rows") > F.col("n_null"))
    at = F.kll_sketch_get_quantile_double("quantiles", F.array(*map(F.lit, cuts)))
    distinct = F.when(F.col("rows") > F.col("n_null"), F.hll_sketch_estimate("distincts")).otherwise(0)
    return found.select(*[c for c in found.columns if c not in ("distincts", "quantiles")], F.coalesce(distinct, F.lit(0)).cast("long").alias("n_distinct"), F.when(known, at).alias("quantiles"))
