"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text go. Native expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, spread, word_array

SYMBOLS = "#*$%&|<>"
#: Phrases of lines that carry no prose.
BOILERPLATE = r"all rights reserved|licensed under the|terms of (use|service)|privacy policy|accept (all )?cookies|enable javascript|lorem ipsum|subscribe to our|click here to"
MIN_WORDS = 50
KEEP_PERCENT = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; optimizer rules never copy it into body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _occurs(text: Column, marks: str) -> Column:
    """As a long, so that products with it do not overflow on very long texts."""
    return F.char_length(text).cast("long") - F.char_length(F.translate(text, marks, ""))


def bare(text: Column) -> Column:
    """The text without separators, which is what words consist of."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def line_fails(line: Column) -> Column:
    """Navigation bars, symbol noise, shouting, boilerplate phrases, and long lines without any punctuation."""
    n = F.char_length(line)
    pipes = _occurs(line, "|")
    return (
        ((pipes >= 3) & (pipes * 15 >= n))
        | ((_occurs(line, "#*$%&<>") >= 3) & (_occurs(line, "#*$%&<>") * 12 >= n))
        | ((n >= 20) & (F.upper(line) == line) & (F.lower(line) != line))
        | F.lower(line).rlike(BOILERPLATE)
        | ((n >= 300) & ~line.rlike(r"[.!?,;:]"))
    )


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more, the first occurrence included."""

    def of(h: Column) -> Column:
        m = F.greatest(F.size(h) - 2, F.lit(0))
        two = F.zip_with(F.slice(h, 1, m), F.slice(h, 2, m), lambda a, b: F.xxhash64(a, b))
        three = F.zip_with(two, F.slice(h, 3, m), lambda a, b: F.xxhash64(a, b))
        rows = F.sort_array(F.transform(three, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False)))
            return F.sort_array(F.transform(same, lambda e: e["i"]))

        def covered(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda q, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - q, F.lit(3)))), F.lit(0), lambda a, b: a + b)

        return let(let(rows, starts), covered)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of).cast("long")


def quality(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and cleaned (the lines that pass).

    Row by row, without a shuffle unless the input is too small to keep the cores busy. A null or empty text has zero counts, fails and is not kept; other columns, also null or of
    clashing names, pass through unless they bear one of the names above, which are replaced. Texts of any length are read whole.
    Repeated rows, and so ties, get equal results; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = F.filter(F.split(text, "\n"), lambda x: bare(x) != "")
    counts = let(
        word_array(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    dups = let(with_words, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    cleaned = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~line_fails(x)), "\n")
    out = spread(docs).withColumns({"_c": counts, "n_dup_lines": dups, "cleaned": cleaned, "word_chars": F.char_length(bare(text)).cast("long"), "n_symbols": _occurs(text, SYMBOLS).cast("long")})
    out = out.withColumns({"n_words": F.col("_c.n_words"), "n_repeat_words": F.col("_c.n_repeat_words")})
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    enough = F.char_length(bare(F.col("cleaned"))).cast("long") * 100 >= F.col("word_chars") * KEEP_PERCENT
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & enough).drop("_c")


ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') text FROM documents),
w AS (SELECT rid, unnest(list_filter(regexp_split_to_array(text, '[{SEPARATORS}]+'), lambda x: x <> '')) w, generate_subscripts(list_filter(regexp_split_to_array(text, '[{SEPARATORS}]+'), lambda x: x <> ''), 1) i FROM t),
g AS (SELECT rid, i, w, lead(w, 1) OVER v w2, lead(w, 2) OVER v w3 FROM w WINDOW v AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, (w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w2, w3) > 1)::INT d FROM g),
n AS (SELECT rid, count(*) n_words, sum(c) n_repeat_words FROM (SELECT rid, max(d) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) c FROM r) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) line FROM t),
p AS (SELECT rid, line, translate(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') b FROM l),
f AS (SELECT rid, line, length(b) b, NOT (
    (length(line) - length(replace(line, '|', '')) >= 3 AND (length(line) - length(replace(line, '|', ''))) * 15 >= length(line))
    OR (length(line) - length(translate(line, '#*$%&<>', '')) >= 3 AND (length(line) - length(translate(line, '#*$%&<>', ''))) * 12 >= length(line))
    OR (length(line) >= 20 AND upper(line) = line AND lower(line) <> line)
    OR regexp_matches(lower(line), '{BOILERPLATE}') OR (length(line) >= 300 AND NOT regexp_matches(line, '[.!?,;:]'))) ok FROM p WHERE b <> ''),
k AS (SELECT rid, sum(b) word_chars, sum(CASE WHEN ok THEN b ELSE 0 END) kept_chars, count(*) - count(DISTINCT line) n_dup_lines FROM f GROUP BY rid),
a AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT n_words, coalesce(word_chars, 0)::BIGINT word_chars, (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT n_repeat_words, coalesce(kept_chars, 0) kept_chars FROM t LEFT JOIN n USING (rid) LEFT JOIN k USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND kept_chars * 100 >= word_chars * {KEEP_PERCENT} kept FROM a
"""
