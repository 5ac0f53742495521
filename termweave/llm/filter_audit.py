"""How filters interact: what any subset of them leaves, so what each removes in any order, from one cube over the failure flags."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, spread, word_array, written
from .quality import let

#: A: under MIN_WORDS words. B: distinct words under DISTINCT percent. C: capitals over CAPITALS percent. D: a symbol. E: an earlier copy.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT, CAPITALS = 200, 50, 2
SYMBOLS = "[#$%&*|]"


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, the flags A to E (true: the document fails that filter), good and toxic: a row a document.

    A null text is empty: it fails A and, with a smaller doc_id beside it that is empty too, E. A null part is ''. A row with a null
    doc_id is no copy and makes none, and has no labels; repeated rows of one doc_id are no copies of each other. Labels that come
    twice for a document count if one of them does. Other columns are ignored. Texts are read once, in place; after that only their
    digests of 256 bits move, joined by (doc_id, digest), which no group of copies makes a hot key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    by_words = let(
        word_array(F.col("text")),
        lambda w: F.struct((F.size(w) < MIN_WORDS).alias("A"), (F.size(F.array_distinct(w)).cast("long") * 100 < F.size(w).cast("long") * DISTINCT).alias("B")),
    )
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    rows = spread(docs).select(
        "doc_id",
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        by_words.alias("w"),
        (capitals * 100 > F.char_length(text).cast("long") * CAPITALS).alias("C"),
        text.rlike(SYMBOLS).alias("D"),
    )
    rows = written(rows.select("doc_id", "part", "digest", "w.A", "w.B", "C", "D"), "flags")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    out = rows.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return out.select("part", "A", "B", "C", "D", copy.alias("E"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def survivors(flags: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """(part, subset, n, good, toxic): what each subset of the filters leaves of a part; a part of null is the whole table.

    Flags are counted by part first, so the cube expands at most 2^filters rows a part, however many documents there are. Of the
    cube's rows those stay whose selected flags are all false. subset has bit i for filter i. A subset that leaves nothing has no row.
    """
    count = flags.groupBy("part", *filters).agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("good", "toxic")])
    chosen = sum(((1 - F.grouping(f)).cast("int") * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    rows = count.cube("part", *filters).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")], chosen.alias("subset"), F.grouping("part").alias("whole"))
    alive = ~F.coalesce(F.greatest(*[F.coalesce(f, F.lit(False)) for f in filters]), F.lit(False))
    return rows.where(alive).select(F.when(F.col("whole") == 0, F.col("part")).alias("part"), "subset", "n", "good", "toxic")


def interactions(flags: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row a part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. An empty table has no part and so no row; filters that nothing fails have rows of zeros.

    A step joins two subsets: the filters before it, and those with its own. What fails a filter is what it removes as the first, what
    fails it alone is what it removes as the last, and its share is what it removes over all orders.
    """
    alive = written(survivors(flags, filters).where("part is not null"), "subsets")
    orders = ",".join(map("".join, permutations(filters)))
    bits = lambda upto: sum((F.when(F.locate(f, F.col("filter_order")) <= upto, 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    steps = alive.where("subset = 0").select("part", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step")).withColumns({"filter": F.expr("substring(filter_order, step, 1)"), "before": bits(F.col("step") - 1), "after": bits(F.col("step"))})
    for side in ("before", "after"):
        steps = steps.join(alive.select("part", F.col("subset").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "good", "toxic")]), ["part", side], "left")
    lost = {c: F.coalesce(f"before_{c}", F.lit(0)) - F.coalesce(f"after_{c}", F.lit(0)) for c in ("n", "good", "toxic")}
    rows = steps.select("part", "filter_order", "step", "filter", F.coalesce("after_n", F.lit(0)).alias("kept"), lost["n"].alias("removed"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"))
    own = Window.partitionBy("part", "filter")  # as many rows as there are orders
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("removed"))).over(own)
    rows = rows.withColumns({"redundant": at(1) - F.col("removed"), "unique_fails": at(len(filters)), "shapley": F.sum("removed").over(own)})
    return rows.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """interactions of the filters A to E over whole documents. For nulls, copies and repeated rows see failures."""
    return interactions(failures(docs, labels, part))


#: Each document goes with the first filter of an order that it fails; nothing of the cube is used.
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') text, list_filter(regexp_split_to_array(coalesce(text, ''), '[{SEPARATORS}]+'), lambda x: x <> '') w FROM documents),
f AS (SELECT part, len(w) < {MIN_WORDS} a, 100 * len(list_distinct(w)) < {DISTINCT} * len(w) b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITALS} * length(text) c,
    regexp_matches(text, '{SYMBOLS}') d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) e,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) bad FROM t),
g AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) fails, count(*) n, sum(coalesce(good, false)::INT) good, sum(coalesce(bad, false)::INT) bad FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) x),
o AS (SELECT v.x || w.x || y.x || z.x || u.x AS o FROM l v, l w, l y, l z, l u WHERE len(list_distinct([v.x, w.x, y.x, z.x, u.x])) = 5),
s AS (SELECT o, unnest([1, 2, 3, 4, 5]) step FROM o),
r AS (SELECT part, o, step, substr(o, step, 1) x, CASE WHEN len(fails) = 0 THEN 6 ELSE list_min(list_transform(fails, lambda y: instr(o, y))) END hit, fails, n, good, bad FROM g, s),
k AS (SELECT part, o, step, x, sum(CASE WHEN hit > step THEN n ELSE 0 END) kept, sum(CASE WHEN hit = step THEN n ELSE 0 END) removed, sum(CASE WHEN hit < step AND list_contains(fails, x) THEN n ELSE 0 END) redundant,
    sum(CASE WHEN fails = [x] THEN n ELSE 0 END) unique_fails, sum(CASE WHEN hit = step THEN good ELSE 0 END) good_lost, sum(CASE WHEN hit = step THEN bad ELSE 0 END) toxic_lost FROM r GROUP BY part, o, step, x)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT kept, removed::BIGINT removed, redundant::BIGINT redundant, unique_fails::BIGINT unique_fails, good_lost::BIGINT good_lost, toxic_lost::BIGINT toxic_lost,
    sum(removed) OVER (PARTITION BY part, x)::BIGINT shapley FROM k
"""
