"""Filter audits, tokenizer alignment and secret scans on odd rows, and against brute force."""

import hashlib
import os
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave.llm import align, filter_audit, queries, secrets

SCHEMA = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def run(spark, rows, f, schema=SCHEMA):
    return f(spark.createDataFrame(rows, schema).repartition(3))


def against_sql(rows, sql, labels=()):
    """The statement's rows over a documents table of (doc_id, text, source)."""
    c = duckdb.connect()
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    c.register("documents", pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1], pa.string()), "source": pa.array(cols[2], pa.string())}))
    c.register("labels", pa.table({k: pa.array([x[i] for x in labels], pa.int64()) for i, k in enumerate(("doc_id", "quality", "toxic"))}))
    out = c.sql(sql)
    return [dict(zip(out.columns, r, strict=True)) for r in out.fetchall()]


def same(got, want):
    def key(r):
        return str(sorted((k, r[k]) for k in r))

    assert sorted(map(key, (r.asDict() for r in got))) == sorted(map(key, want))


# ---------------------------------------------------------------- filter audit


def audited(seed):
    r = random.Random(seed)
    rows = []
    for i in range(240):
        words = [r.choice(("alpha", "beta", "Gamma", "DELTA", "x", f"u{r.randrange(500)}")) for _ in range(r.choice((0, 1, 150, 199, 200, 201, 400)))]
        text = " ".join(words) + r.choice(("", "", "", " #", " |", "\t*"))
        text = r.choice(rows)[1] if rows and r.random() < 0.3 else text
        rows.append((None if r.random() < 0.05 else r.randrange(300), text if r.random() > 0.05 else None, r.choice((None, "", "hot", "hot", "s1"))))
    labels = [(i, r.randrange(2), r.randrange(2)) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None)]
    return rows + rows[:5] + rows[:5], labels


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_first_failing_filter(spark, seed):
    rows, labels = audited(seed)
    got = run(spark, rows, lambda d: filter_audit.filter_audit(d, spark.createDataFrame(labels, LABELS))).collect()
    assert len(got) == 600 * len({s or "" for _, _, s in rows})
    same(got, against_sql(rows, filter_audit.ORACLE, labels))


def test_audit_by_hand(spark):
    """Two documents: one fails A and E only after its copy, the other nothing."""
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, "a b", "p"), (2, "a b", "p"), (3, long, "p"), (4, long + "#", "q")]
    out = run(spark, rows, lambda d: filter_audit.filter_audit(d, spark.createDataFrame([(2, 1, 1)], LABELS))).collect()
    by = {(r["part"], r["filter_order"], r["step"]): r for r in out}
    assert {r["filter_order"] for r in out} == set(map("".join, permutations("ABCDE"))) and len(out) == 1200
    first, last = by["p", "ABCDE", 1], by["p", "ABCDE", 5]
    assert (first["kept"], first["removed"], first["redundant"], first["unique_fails"], first["good_lost"], first["toxic_lost"]) == (1, 2, 0, 1, 1, 1)
    assert (last["kept"], last["removed"], last["redundant"], last["unique_fails"]) == (1, 0, 1, 0)
    # document 1 always falls to A; document 2 to A or E, whichever comes first: in half of the orders
    assert first["shapley"] == 120 + 60 and last["shapley"] == 60
    assert by["q", "DABCE", 1]["removed"] == by["q", "ABCED", 5]["removed"] == 1 and by["q", "ABCED", 5]["unique_fails"] == 1


def test_audit_of_nothing_and_clashing_columns(spark):
    none = spark.createDataFrame([], LABELS)
    assert run(spark, [], lambda d: filter_audit.filter_audit(d, none)).count() == 0
    rows = [(1, "A b", "s"), (1, "A b", "s"), (None, None, None)]
    plain = run(spark, rows, lambda d: filter_audit.filter_audit(d, none)).collect()
    more = {c: F.lit(True) for c in ("A", "B", "E", "part", "digest", "good", "first", "n", "subset", "step", "kept", "quality")}
    odd = run(spark, rows, lambda d: filter_audit.filter_audit(d.withColumns(more), none)).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, odd)) and {r["part"] for r in plain} == {"", "s"}


def test_audit_reads_very_long_texts(spark):
    rows = [(1, "Abc " * 6_000_000, "s"), (2, "Abc " * 6_000_000, "s")]
    out = run(spark, rows, lambda d: filter_audit.filter_audit(d, spark.createDataFrame([], LABELS))).where("filter_order = 'BCEAD'").collect()
    assert {r["step"]: (r["kept"], r["removed"], r["redundant"]) for r in out} == {1: (0, 2, 0), 2: (0, 0, 2), 3: (0, 0, 1), 4: (0, 0, 0), 5: (0, 0, 0)}


def test_any_filters_interact(spark):
    flags = [("p", i % 2 == 0, i % 3 == 0, False, False) for i in range(12)]
    out = filter_audit.interactions(spark.createDataFrame(flags, "part string, x boolean, y boolean, good boolean, toxic boolean"), "xy").collect()
    by = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in out}
    assert by == {("xy", 1): (6, 6, 0, 4, 10), ("xy", 2): (4, 2, 2, 2, 6), ("yx", 1): (8, 4, 0, 2, 6), ("yx", 2): (4, 4, 2, 4, 10)}


# ---------------------------------------------------------------- alignment

PARTS = [*"abcXYZ019 .,'!\n\t\r  \n\x1c\x85\xa0é日本\x00<|>", " the", "ing", "<|endoftext|>", "<0x41>", "</s>", "'s", "  ", "\n\n", "\r\n", "🎉", "́", "　", "ﬁ", " word", " other"]


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(*align.default_tokenizers())


def plainly(al, text):
    """(A ids, B ids, groups, links) of a whole text by ranges, or None without tokens."""
    data = f" {text}".encode()
    a, b = al.a.encode(f" {text}", add_special_tokens=False).ids if text else [], al.b.encode(text) if text else []
    if not text or b"".join(al.a_bytes[i] for i in a) != data or b"".join(al.b_bytes[i] for i in b) != data:
        return None

    def ranges(ids, table):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(table[i])))
            at = out[-1][1]
        return out

    ra, rb = ranges(a, al.a_bytes), ranges(b, al.b_bytes)
    groups, at = [], 0
    for end in sorted({e for _, e in ra} & {e for _, e in rb}):
        groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, r, strict=True) if at < e <= end) for ids, r in ((a, ra), (b, rb))))
        at = end
    links = [(i, j) for i, (s, e) in zip(a, ra, strict=True) for j, (u, v) in zip(b, rb, strict=True) if s < v and u < e]
    return a, b, groups, links


def brute(al, rows):
    found = [plainly(al, t) for _, t, _ in rows]
    held = Counter(p for x in found if x for p in set(x[3]))
    most: dict = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for (d, _, _), x in zip(rows, found, strict=True):
        if x is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        out.append((d, len(a), len(b), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def some_texts(n, seed=4):
    r = random.Random(seed)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(1, 40))) for _ in range(n)]
    return [*texts, *texts[:4], None, "", " ", "\n", "a", "x▁y", "a▁", "日本" * 60, "word other " * 300]


def test_segments_equal_whole_texts(aligner):
    texts = [t for t in some_texts(4000) if t]
    for t, g in zip(texts, aligner.align(texts, True), strict=True):
        w = plainly(aligner, t)
        assert (g is None) == (w is None), t
        if g:
            assert g[6] == ";".join(w[2]) and g[:4] == (len(w[0]), len(w[1]), len(w[2]), len(w[3])), t
            assert sorted(g[5].tolist()) == sorted(a << 32 | b for a, b in w[3]), t


def test_a_full_cache_and_long_texts(monkeypatch):
    monkeypatch.setattr(align, "AT_ONCE", 7)
    al = align.Aligner(*align.default_tokenizers(), segments=10)
    for t in ("one two three", "four five six seven", "one two eight", "nine, " * 40 + "x" * 90 + " ten", "lost ▁ " * 9):
        got = al.align([t, t, "one"], True)
        want = plainly(al, t)
        assert got[0] == got[1] if want is None else got[0][6] == got[1][6] == ";".join(want[2]) and got[0][4] == hashlib.sha256(got[0][6].encode()).hexdigest()
        assert len(al.kept) <= 5 + 7


@pytest.mark.parametrize("hot", [1 << 20, 40, 1])
def test_alignment_equals_brute_force(spark, aligner, hot):
    rows = [(None if i % 9 == 0 else i % 150, t, None) for i, t in enumerate(some_texts(150))]
    got = run(spark, rows, lambda d: align.alignment(d, hot_pairs=hot)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(aligner, rows), key=str)


def test_alignment_gives_groups(spark, aligner):
    out = run(spark, [(1, "the tokenizers differ", None)], lambda d: align.links(d, with_groups=True)).first()
    assert out["groups"] == ";".join(plainly(aligner, "the tokenizers differ")[2]) and sum(out["times"]) == out["n_links"]


def test_alignment_of_odd_rows(spark, aligner):
    assert run(spark, [], align.alignment).count() == 0
    rows = [(None, None, None), (5, "same text", None), (5, "same text", None), (5, "x" * 3_000, "s")]
    more = {c: F.lit("z") for c in ("row", "pair", "pairs", "n", "times", "best", "n_a", "groups")}
    got = run(spark, rows, lambda d: align.alignment(d.withColumns(more))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(aligner, rows), key=str)


# ---------------------------------------------------------------- secrets


def plain_secrets(text):
    """Spans (start, kind, end) of one text by pairwise comparison, from the patterns in Python's own engine."""
    text = text or ""
    found = []
    for i, k in enumerate(secrets.KINDS):
        for m in re.finditer(secrets.PATTERNS[k], text):
            long = k not in secrets.LEAST or len(m.group(2)) >= secrets.LEAST[k]
            mixed = k != "key" or all(re.search(c, m.group()) for c in ("[A-Z]", "[a-z]", "[0-9]"))
            if long and mixed:
                found.append((m.start(), i, m.end()))
    breaks = [m.start() for m in re.finditer(secrets.BREAK, text)]
    base = [x for x in found if x[1] < secrets.STRONG]
    parts = base + [x for x in found if x[1] >= secrets.STRONG and not any(s <= x[0] < e for s, _, e in base)]
    secret = lambda x: secrets.KINDS[x[1]] in secrets.SECRET
    scope = lambda x: sum(b < x[0] for b in breaks)
    near = lambda x: any(secret(x) != secret(y) and scope(x) == scope(y) and abs(x[0] - y[0]) <= secrets.REACH for y in parts)
    return sorted(x for x in parts if x[1] < secrets.STRONG or near(x))


def base_by_contract(text):
    """The base as its three patterns say, failing matches dropped afterwards."""
    out = []
    rules = [("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]+", 0)]
    for i, (k, p, flags) in enumerate(rules):
        for m in re.finditer(p, text or "", flags):
            if len(m.group(2)) >= 6 if k == "assign" else len(m.group()) >= (20 if k == "access" else 24):
                out.append((m.start(), i, m.end()))
    return sorted(out)


def secret_texts(n=160, seed=6):
    r = random.Random(seed)
    key = lambda k, c: "".join(r.choice(c) for _ in range(k))
    low, mixed, caps = "0123456789abcdef", "ABCdefgh0123456789+/", "ABCDEFGHIJ0123456789"
    made = [
        lambda: "token = \"" + key(r.randrange(3, 40), low) + '"', lambda: "Password: " + key(r.randrange(4, 9), mixed), lambda: "secret:token:" + key(8, low),
        lambda: "AKIA" + key(r.randrange(10, 24), caps), lambda: "AKIAAKIA" + key(r.randrange(10, 16), caps), lambda: key(r.randrange(20, 44), low), lambda: key(r.randrange(17, 44), mixed),
        lambda: "user_name = " + key(r.randrange(1, 8), low), lambda: "Login:'ann@b.org'", lambda: "https://" + key(9, low) + ".org/a?b=" + key(24, mixed), lambda: "host: db" + key(3, low), lambda: "\n\n", lambda: "\n \t\n", lambda: "\n",
        lambda: "é日🎉" * r.randrange(1, 40), lambda: "plain words here " * r.randrange(1, 30), lambda: 'apikey"=' + key(12, mixed), lambda: "api_key:token=" + key(5, low) + "=",
    ]
    texts = ["".join(r.choice(made)() + r.choice((" ", " ", "\n", "; ")) for _ in range(r.randrange(1, 25))) for _ in range(n)]
    return [*texts, None, "", " ", "user_name = ann " + "x " * 200 + "AKIA" + "B" * 16, ("user_id=bob AKIA" + "Q" * 16 + " ") * 50]


def test_secrets_equal_brute_force(spark):
    rows = [(None if i % 13 == 0 else i, t, None) for i, t in enumerate(secret_texts())]
    rows += rows[:3]
    got = {}
    for r in run(spark, rows, lambda d: secrets.secrets(d, "text")).collect():
        spans = [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["spans"]]
        assert spans == plain_secrets(r["text"]), r["text"]
        assert [x for x in spans if x[1] < secrets.STRONG] == base_by_contract(r["text"])
        got[r["doc_id"]] = spans
    kinds = Counter(k for x in got.values() for _, k, _ in x)
    assert len(kinds) == len(secrets.KINDS) and min(kinds.values()) > 5


def test_secret_digests_equal_sql(spark):
    rows = [(i, t, None) for i, t in enumerate(secret_texts(80, 9))]
    same(run(spark, rows, secrets.secret_digests).collect(), against_sql(rows, secrets.ORACLE))


def test_weak_parts_need_each_other(spark):
    key = "aB3" * 8
    far = "words " * 60
    rows = [(1, f"user_name = ann and {key}", None), (2, f"only {key} here", None), (3, f"user_name = ann\n\n{key}", None), (4, f"user_name = ann {far} {key}", None), (5, "see https://a.org/b and user_id: x12", None), (6, f"https://a.org {key}", None)]
    out = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in run(spark, rows, secrets.secrets).collect()}
    assert out == {1: ["user", "key"], 2: [], 3: [], 4: [], 5: [], 6: ["endpoint", "key"]}


def test_secrets_of_odd_rows(spark):
    assert run(spark, [], secrets.secret_digests).count() == 0
    text = "token = abcdef123 user_id=ann"
    rows = [(None, text, None), (None, None, None), (5, text, "s"), (5, text, "s"), (5, "token", "s")]
    more = {c: F.lit("z") for c in ("key", "found", "kept", "spans", "start", "end", "kind", "n_hex")}
    got = run(spark, rows, lambda d: secrets.secret_digests(d.withColumns(more))).collect()
    same(got, against_sql(rows, secrets.ORACLE))
    kept = run(spark, rows, lambda d: secrets.secrets(d.withColumns(more), "source", "key", "found")).collect()
    assert len(kept) == 5 and {r["key"] for r in kept} == {"z"} and Counter(r["source"] for r in kept) == Counter({None: 2, "s": 3})


def test_secrets_of_a_very_long_text(spark):
    text = ("token = abcdef0123 " + "x" * 60 + " AKIA" + "Z" * 16 + " ") * 30_000 + "y" * 22_000_000
    r = run(spark, [(1, text, None)], secrets.secret_digests).first()
    n = len("token = abcdef0123 " + "x" * 60 + " AKIA" + "Z" * 16 + " ")
    assert (r["n_assign"], r["n_access"]) == (30_000, 30_000) and r["spans"].endswith(f"access:{n * 30_000 - 21}:{n * 30_000 - 1}")


def test_new_queries_are_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert {"op11", "op12", "op13"} <= names and {n.split("_")[0] for n in queries.ORACLES} >= {"op11", "op13"}


def test_small_tables_are_dealt_over_the_cores_and_large_ones_stay(spark):
    from termweave.llm.common import spread

    sf = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(sf) if os.path.exists(sf) else spark.range(10)
    assert spread(docs).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        assert "Repartition" not in spread(docs)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("separator", [" ", "\n"])
def test_quality_rules_read_very_long_texts(spark, separator):
    """Texts whose lengths times a rule's factor pass 32 bits: kept, or failed by their symbols, as short ones are."""
    from termweave.llm.quality import quality

    words = separator.join(f"word{i} and{i}." for i in range(1_500_000))
    rows = [(1, words, None), (2, separator.join(["|" * 4_000_000] * 12) + separator + words[:1000], None)]
    out = {r["doc_id"]: r for r in run(spark, rows, quality).select("doc_id", "n_words", "word_chars", "n_symbols", "base_failed", "kept").collect()}
    assert out[1]["word_chars"] > 21_500_000 and out[1]["n_words"] == 3_000_000 and out[1]["kept"]
    assert out[2]["n_symbols"] == 48_000_000 and not out[2]["kept"]
