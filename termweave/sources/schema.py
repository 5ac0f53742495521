"""Logical tables and checks that raise before a plan is built."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_L, _S, _I = T.LongType(), T.StringType(), T.IntegerType()


def _struct(text: str) -> T.StructType:
    kinds = {"l": _L, "s": _S, "i": _I, "d": T.DoubleType(), "v": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


TABLES: dict[str, T.StructType] = {
    "concept": _struct("concept_id:l concept_name:s domain_id:s vocabulary_id:s standard_concept:s concept_code:s"),
    "concept_relationship": _struct("concept_id_1:l concept_id_2:l relationship_id:s"),
    "concept_synonym": _struct("concept_id:l concept_synonym_name:s"),
    "concept_ancestor": _struct("ancestor_concept_id:l descendant_concept_id:l min_levels_of_separation:i max_levels_of_separation:i"),
    "std_bridge": _struct("concept_id:l std_concept_id:l"),
    "mrconso": _struct(" ".join(f"{c}:s" for c in "CUI LAT TS LUI STT SUI ISPREF AUI SAUI SCUI SDUI SAB TTY CODE STR SRL SUPPRESS CVF".split())),
    "mrdef": _struct(" ".join(f"{c}:s" for c in "CUI AUI ATUI SATUI SAB DEF SUPPRESS CVF".split())),
    "map_table": _struct("concept_id:l source:s source_id:s type:s name:s"),
    "matching_map_table": _struct("concept_id:l source:s source_id:s type:s name_id:l name:s"),
    "target_concepts": _struct("concept_id:l concept_name:s"),
    "name_bridge": _struct("concept_id:l name_id:l"),
    "name_table": _struct("name_id:l source:s source_id:s type:s name:s"),
    "embeddings": _struct("vec_id:l embedding:v label:i"),
}


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def require_integer(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    require_columns(df, columns, what)
    wrong = [c for c in columns if not isinstance(df.schema[c].dataType, T.IntegralType)]
    if wrong:
        raise ValueError(f"{what}: {', '.join(wrong)} must be integers")
    return df


def resolve_aliases(df: DataFrame, choices: Iterable[Mapping[str, str]]) -> DataFrame:
    """Renames by the first choice (wanted name -> present name) whose present names are all there."""
    for choice in choices:
        if all(c in df.columns for c in choice.values()):
            return df.select(*[df[c].alias(n) for n, c in choice.items()], *[df[c] for c in df.columns if c not in choice.values() and c not in choice])
    raise ValueError(f"no known column set among {df.columns}")
