"""Line dedup over content-defined chunks of lines. Native expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side
from .quality import bare, let

#: A chunk ends after a line whose rolling hash starts with one of these digits: four lines on average.
CUT_DIGITS = "0123"
#: Rows of one chunk that are compared with its first place in one go; a chunk with more is dealt over several.
HOT = 256


def _chunks(text: Column) -> Column:
    """Chunks of two lines or more that hold a word: ci, start (0-based line), lines, body."""

    def of(lines: Column) -> Column:
        def cut(h: Column) -> Column:
            last = F.size(h) - 1
            rolled = F.transform(h, lambda x, i: F.substring(F.md5(F.concat(F.coalesce(F.get(h, i - 1), F.lit("")), x)), 1, 1))
            ends = F.filter(F.transform(rolled, lambda d, i: F.when((i == last) | F.lit(CUT_DIGITS).contains(d), i)), lambda i: i.isNotNull())
            return let(ends, lambda e: F.transform(e, lambda b, k: F.struct(k.alias("ci"), F.coalesce(F.get(e, k - 1) + 1, F.lit(0)).alias("start"), b.alias("last"))))

        spans = let(F.transform(lines, lambda x: F.md5(x)), cut)
        multi = F.filter(spans, lambda s: s["last"] > s["start"])
        body = F.transform(multi, lambda s: F.struct(s["ci"].alias("ci"), s["start"].alias("start"), (s["last"] - s["start"] + 1).alias("lines"), F.array_join(F.slice(lines, s["start"] + 1, s["last"] - s["start"] + 1), "\n").alias("body")))
        return F.filter(body, lambda s: bare(s["body"]) != "")

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), of)


def windows(text: Column) -> Column:
    """Every two neighbouring lines that hold a word, as chunks that overlap."""

    def of(lines: Column) -> Column:
        pairs = F.transform(lines, lambda x, i: F.struct(i.alias("ci"), i.alias("start"), F.lit(2).alias("lines"), F.concat(x, F.lit("\n"), F.get(lines, i + 1)).alias("body")))
        return F.filter(pairs, lambda s: bare(s["body"]) != "")

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), of)


def line_dedup(docs: DataFrame, spans: Callable[[Column], Column] = _chunks) -> DataFrame:
    """docs with cleaned (text without the removed chunks), n_lines and n_removed_lines.

    spans cuts a text: by default into chunks that a hash ends, which miss a passage unless a whole chunk lies inside it. With
    windows every passage of two lines or more goes that an earlier place has, whatever stands around it, and each removed line
    still stands at its first place. A single line between unshared neighbours stays under both.

    Rolling hashes over the hashes of two neighbouring lines choose chunk ends, so an inserted line shifts no other boundary.
    Of equal chunks with two lines or more, in one document or many, the one with the smallest (doc_id, place) stays; the others
    are removed after their bytes are compared with it. Keys are counted by partial aggregates without texts; only chunks whose
    key repeats are moved, a very common one in parts. Null and empty texts have no chunks (a null text stays null); a text of any
    length is cut whole; rows with a null doc_id are left as they are; repeated rows of a doc_id are one document; ties go by place.
    Empty tables give empty results. Other columns, null or not, pass through unless they bear one of the three new names, which are
    replaced; names that start with an underscore are reserved.
    """
    chunks = docs.where("doc_id is not null").select("doc_id", F.inline(spans(F.col("text"))))
    keyed = chunks.select("doc_id", "ci", "start", "lines", "body", F.xxhash64("body").alias("key"), F.octet_length("body").alias("size"))
    first = keyed.groupBy("key", "size").agg(F.min(F.struct("doc_id", "ci")).alias("first"), F.max(F.struct("doc_id", "ci")).alias("final"), F.ceil(F.count("*") / HOT).alias("parts"))
    first = small_side(first.where("first <> final").select("key", "size", "first", "parts"), "chunk-keys")
    found = keyed.join(first, ["key", "size"]).withColumn("part", F.pmod(F.xxhash64("doc_id", "ci"), "parts"))
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("ci") == F.col("first.ci"))
    kept = found.where(is_first).select("key", "size", F.col("body").alias("kept_body"), "parts").distinct()
    kept = kept.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    gone = found.where(~is_first).join(kept, ["key", "size", "part"]).where("body = kept_body")
    per_doc = gone.groupBy("doc_id").agg(F.collect_set(F.struct("start", "lines")).alias("_gone"))
    per_doc = small_side(per_doc.withColumnRenamed("doc_id", "_id"), "chunk-spans")
    out = docs.join(per_doc, docs["doc_id"] == F.col("_id"), "left")

    def rest(lines: Column) -> Column:
        gone = F.flatten(F.transform("_gone", lambda g: F.sequence(g["start"], g["start"] + g["lines"] - 1)))
        left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
        return F.struct(F.size(lines).alias("n"), F.size(left).alias("m"), F.array_join(left, "\n").alias("t"))

    full = F.col("_gone").isNull()
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    out = out.withColumn("_r", F.when(~full, let(F.split("text", "\n"), rest)))
    return out.withColumns({"n_lines": n.cast("long"), "n_removed_lines": F.coalesce(F.col("_r.n") - F.col("_r.m"), F.lit(0)).cast("long"), "cleaned": F.when(full, F.col("text")).otherwise(F.col("_r.t"))}).drop("_r", "_gone", "_id")


ORACLE = f"""
WITH t AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) x FROM documents),
l AS (SELECT doc_id, unnest(x) line, generate_subscripts(x, 1) i, len(x) n FROM t),
h AS (SELECT *, md5(line) m FROM l),
c AS (SELECT *, (i = n OR substr(md5(coalesce(lag(m) OVER v, '') || m), 1, 1) IN ('0', '1', '2', '3'))::INT e FROM h WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) k FROM c),
b AS (SELECT doc_id, k, count(*) z, string_agg(line, chr(10) ORDER BY i) body FROM d GROUP BY doc_id, k),
g AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) r FROM b WHERE z > 1 AND translate(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '') WHERE r > 1),
s AS (SELECT d.doc_id, count(*) n_lines, count(g.k) n_removed_lines, string_agg(CASE WHEN g.k IS NULL THEN line END, chr(10) ORDER BY i) cleaned FROM d LEFT JOIN g ON d.doc_id = g.doc_id AND d.k = g.k GROUP BY d.doc_id)
SELECT doc_id, n_lines::BIGINT n_lines, n_removed_lines::BIGINT n_removed_lines, length(coalesce(cleaned, ''))::BIGINT kept_chars, md5(coalesce(cleaned, '')) kept_md5 FROM s
"""

ORACLE_WINDOWS = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) x FROM documents),
l AS (SELECT doc_id, unnest(x) line, generate_subscripts(x, 1) i FROM t),
w AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) body FROM l),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) r FROM w WHERE translate(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '') WHERE r > 1),
x AS (SELECT doc_id, i FROM g UNION SELECT doc_id, i + 1 FROM g),
s AS (SELECT l.doc_id, count(*) n_lines, count(x.i) n_removed_lines, string_agg(CASE WHEN x.i IS NULL THEN line END, chr(10) ORDER BY l.i) cleaned FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id)
SELECT doc_id, n_lines::BIGINT n_lines, n_removed_lines::BIGINT n_removed_lines, length(coalesce(cleaned, ''))::BIGINT kept_chars, md5(coalesce(cleaned, '')) kept_md5 FROM s
"""
