"""Secret scans: strong spans by pattern, and weak candidates that count only beside a complementary part in their scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, written


def either_case(word: str) -> str:
    """A pattern for the word's ASCII letters in either case, the same in any engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _assigned(names: tuple[str, ...], value: str) -> str:
    return f"({'|'.join(map(either_case, names))})[\"']?\\x20*[:=]\\x20*[\"']?({value})"


#: Kinds in the order of the listing. The first three are the strong ones; a run of at least n characters is what is left of all runs
#: when the shorter ones are dropped, as no run can begin inside another.
KINDS = ("assign", "access", "hex", "user", "key", "endpoint")
STRONG = 3
PATTERNS = {
    "assign": _assigned(("password", "passwd", "secret", "token", "api_?key"), "[A-Za-z0-9+/_.=-]+"),
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "user": _assigned(("user_?name", "user_?id", "login", "account_?id", "client_?id"), "[A-Za-z0-9._@+-]+"),
    "key": "[A-Za-z0-9+/_=-]{20,}",
    "endpoint": "(?:https?|ftps?|ssh|postgres|postgresql|mysql|mongodb|redis|amqps?|s3)://[^\\x20\\x09-\\x0D\"'<>]+|" + _assigned(("host", "endpoint", "server"), "[A-Za-z0-9._:/-]+"),
}
#: Least length of an assigned value.
LEAST = {"assign": 6, "user": 3}
#: A scope ends at a blank line.
BREAK = r"\n[\x20\t\r]*\n"
#: Kinds that are secrets; the others say whose or where.
SECRET = ("assign", "hex", "key")
#: Code points between the starts of parts that belong together.
REACH = 300


def _matches(text: Column, kind: int, pattern: str, ok) -> Column:
    """Every match of a pattern with the gap before it, in order; ok(match, value) drops failing ones later, as they take part in the sums."""
    name = KINDS[kind] if kind < len(KINDS) else ""
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if name in LEAST else 0))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"), value.alias("v"))
    row = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["m"]).alias("len"), ok(x["m"], x["v"]).alias("ok"))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>")
    return F.when(text.rlike(pattern), F.transform(F.filter(found, lambda x: x["m"].isNotNull()), row)).otherwise(none)


def _tests(name: str):
    if name in LEAST:
        return lambda m, v: F.char_length(v) >= LEAST[name]
    if name == "key":
        return lambda m, v: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    return lambda m, v: F.lit(True)


def secrets(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns `keep`, and spans: array of (start, kind, end, base) by start, then kind, in code points, end exclusive.

    Strong spans (base) are every assigned secret, access identifier and hexadecimal run of a text. Weak candidates are user names that
    are assigned, mixed runs that may be keys, and endpoints; one that begins inside a strong span is part of it. A weak secret is
    reported if an identifier or endpoint, and a weak identifier or an endpoint if a secret, strong or weak, begins within REACH in the
    same scope, which is a block without blank lines.

    That join of intervals meets no pairs: parts go to buckets of REACH, of which only the least and the largest start stay for each
    side, and a candidate looks at its own bucket and both beside it. Texts are scanned once, in place; only documents with a match go
    on, as rows of matches keyed by (doc_id, digest of the text), so equal texts of many documents are no hot key.

    A null or empty text has no spans, an empty table gives an empty result; a null doc_id is kept; repeated rows get equal results,
    and so do ties. Texts of any length are read whole; matches are summed in windows that spill. Other columns are ignored, and
    those of `keep` may bear any name but doc_id and spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sought = [_matches(text, i, PATTERNS[k], _tests(k)) for i, k in enumerate(KINDS)]
    rows = spread(docs).select("doc_id", F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"), F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(text)).alias("key"), F.concat(*sought).alias("found"), text.alias("text"))
    weak = F.exists("found", lambda x: (x["kind"] >= STRONG) & x["ok"])
    breaks = _matches(F.col("text"), len(KINDS), BREAK, lambda m, v: F.lit(True))
    rows = written(rows.withColumn("found", F.when(weak, F.concat("found", breaks)).otherwise(F.filter("found", lambda x: x["kind"] < STRONG))).drop("text"), "matches")

    once = rows.where(F.size("found") > 0).groupBy("key").agg(F.first("found").alias("found"))
    row = once.select("key", F.inline("found"))
    upto = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    row = row.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(upto)).where("ok").select("key", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    along = Window.partitionBy("key").orderBy("start", "kind")
    scope = F.sum((F.col("kind") == len(KINDS)).cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    covered = F.coalesce(F.max(F.when(F.col("kind") < STRONG, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = row.withColumns({"scope": scope, "covered": covered}).where((F.col("kind") < STRONG) | (F.col("kind") < len(KINDS)) & (F.col("covered") <= F.col("start")))
    secret = F.col("kind").isin(*[KINDS.index(k) for k in SECRET])
    part = written(part.select("key", "kind", "start", "end", "scope", secret.alias("secret"), F.floor(F.col("start") / (REACH + 1)).alias("bucket")), "parts")

    ends = part.groupBy("key", "scope", "secret", "bucket").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    seek = part.where(F.col("kind") >= STRONG).withColumns({"secret": ~F.col("secret"), "bucket": F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)]))})
    beside = seek.join(ends, ["key", "scope", "secret", "bucket"]).where((F.col("low") <= F.col("start") + REACH) & (F.col("high") >= F.col("start") - REACH))
    out = part.where(F.col("kind") < STRONG).select("key", "kind", "start", "end").unionByName(beside.select("key", "kind", "start", "end").distinct())
    names = F.array(*map(F.lit, KINDS))
    out = out.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    spans = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.get(names, x["kind"]).alias("kind"), x["end"].alias("end"), (x["kind"] < STRONG).alias("base")))
    out = rows.join(out, "key", "left")
    none = F.array().cast("array<struct<start:bigint,kind:string,end:bigint,base:boolean>>")
    return out.select("doc_id", *([F.col(f"kept.{c}").alias(c) for c in keep]), F.coalesce(spans, none).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of strong spans of each kind, the digest of their listing, and the listing of all spans."""
    base = F.filter("spans", lambda x: x["base"])
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    count = [of(k) for k in KINDS[:STRONG]]
    return secrets(docs).select("doc_id", *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql() -> str:
    one = []
    for i, (name, p) in enumerate([*((k, PATTERNS[k]) for k in KINDS), ("", BREAK)]):
        ok = f"length(v) >= {LEAST[name]}" if name in LEAST else "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')" if name == "key" else "true"
        value = f"unnest(regexp_extract_all(text, {_literal(p)}, 2))" if name in LEAST else "''"
        cut = f"SELECT rid, {i} kind, unnest(regexp_extract_all(text, {_literal(p)})) m, {value} v, unnest(regexp_split_to_array(text, {_literal(p)})[:-2]) gap, unnest(range(len(regexp_split_to_array(text, {_literal(p)})) - 1)) i FROM t WHERE regexp_matches(text, {_literal(p)})"
        one.append(f"SELECT rid, kind, length(m) len, sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY i) e, ({ok}) ok FROM ({cut})")
    secret = ", ".join(str(KINDS.index(k)) for k in SECRET)
    names = ", ".join(map(_literal, KINDS))
    count = ", ".join(f"count(*) FILTER (kind = {i}) n_{k}" for i, k in enumerate(KINDS[:STRONG]))
    return f"""
WITH t AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') text FROM documents),
m AS ({" UNION ALL ".join(one)}),
s AS (SELECT rid, kind, (e - len)::BIGINT s, e::BIGINT e FROM m WHERE ok),
p AS (SELECT *, (SELECT count(*) FROM s b WHERE b.rid = s.rid AND b.kind = {len(KINDS)} AND b.s < s.s) scope, kind IN ({secret}) secret FROM s WHERE kind < {len(KINDS)}),
q AS MATERIALIZED (SELECT * FROM p WHERE kind < {STRONG} OR NOT EXISTS (SELECT 1 FROM p b WHERE b.rid = p.rid AND b.kind < {STRONG} AND b.s <= p.s AND b.e > p.s)),
r AS (SELECT DISTINCT a.* FROM q a LEFT JOIN q b ON b.rid = a.rid AND b.scope = a.scope AND b.secret <> a.secret AND abs(b.s - a.s) <= {REACH} WHERE a.kind < {STRONG} OR b.rid IS NOT NULL),
g AS (SELECT rid, {count}, coalesce(string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < {STRONG}), '') base, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, kind) spans
    FROM (SELECT *, [{names}][kind + 1] k FROM r) GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT n_{k}" for k in KINDS[:STRONG])}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans FROM t LEFT JOIN g USING (rid)
"""


ORACLE = _sql()
