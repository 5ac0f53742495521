"""Maximal repeats against brute force, of all lengths and in odd rows."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from termweave.llm.repeat_groups import repeat_groups
from termweave.llm.repeats import maximal_repeats


def brute(rows, least=50):
    """{string: occurrences (doc_id, start)} by growing every string that two texts hold, byte by byte."""
    texts = sorted({(d, t.encode()) for d, t in rows if d is not None and t is not None})
    distinct = sorted({b for _, b in texts})
    now = defaultdict(list)
    for k, b in enumerate(distinct):
        for i in range(len(b) - least + 1):
            now[b[i : i + least]].append((k, i))
    out = {}
    while now:
        nxt = defaultdict(list)
        for s, at in now.items():
            if len({k for k, _ in at}) < 2:
                continue
            before = {distinct[k][i - 1] if i else (k, i) for k, i in at}
            after = {distinct[k][i + len(s)] if i + len(s) < len(distinct[k]) else (k, i) for k, i in at}
            if len(before) > 1:
                if len(after) > 1:
                    out[s] = sorted((d, i) for k, i in at for d, b in texts if b == distinct[k])
                for k, i in at:
                    if i + len(s) < len(distinct[k]):
                        nxt[distinct[k][i : i + len(s) + 1]].append((k, i))
        now = nxt
    for b in distinct:
        ds = sorted({d for d, x in texts if x == b})
        if len(ds) > 1 and len(b) >= least:
            out.setdefault(b, [(d, 0) for d in ds])
    return out


def groups(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(v) for c, v in more.items()})
    by = defaultdict(list)
    texts = defaultdict(set)
    for d, t in rows:
        texts[d].add((t or "").encode())
    out = repeat_groups(docs).collect()
    for r in out:
        by[r["repeat"], r["length"]].append((r["doc_id"], r["start"]))
    assert len({n for n, _ in by}) == len(by)
    got = {}
    for (_, n), at in by.items():
        strings = set.intersection(*({t[s : s + n] for t in texts[d] if len(t) >= s + n} for d, s in at))
        assert len(strings) == 1  # all occurrences spell one string
        got[strings.pop()] = sorted(at)
    assert len(got) == len(by)
    return got


def made(r, n, alphabet="abcdefgh "):
    return "".join(r.choice(alphabet) for _ in range(n))


def test_one_group_for_a_passage_of_any_length(spark):
    r = random.Random(1)
    rows, want = [], {}
    for k, size in enumerate((50, 80, 81, 400, 5000, 60_000)):
        p = made(r, size)
        for j, (a, b) in enumerate(((f"{k}A", "1"), (f"{k}B", "2"), (f"{k}C", "3"))):
            rows.append((3 * k + j, made(r, 10 + 7 * j) + a + p + b + made(r, 30)))
        want[p.encode()] = [(3 * k + j, 12 + 7 * j) for j in range(3)]
    assert groups(spark, rows) == want


def test_groups_equal_brute_force(spark):
    r = random.Random(2)
    passage, other, short = made(r, 230), made(r, 90), made(r, 55)
    rows = [(i, made(r, r.randrange(0, 40)) + passage[r.choice((0, 0, 31)) : r.choice((150, 230, 230))] + made(r, r.randrange(0, 30))) for i in range(8)]
    rows += [(10, passage), (11, passage), (12, passage + passage + "x"), (13, "ü" + passage[40:200] + "日本"), (14, "日" + passage[40:200] + "本")]
    rows += [(20 + i, made(r, 5) + other[:60] + str(i % 2) + other[60:] + short) for i in range(5)] + [(30, short), (31, short + "q" + short), (32, other[10:] + short)]
    rows += [(40, made(r, 300)), (41, made(r, 49)), (42, made(r, 49)), (43, None), (44, ""), (45, "\0" * 3 + other + "\0" * 4), (46, "\0" + other + "\0")]
    assert groups(spark, rows) == brute(rows)


def test_periodic_texts_equal_brute_force(spark):
    rows = [(1, "a" * 90), (2, "b" + "a" * 75), (3, "ab" * 60), (4, "ab" * 45 + "c"), (5, "a" * 64 + "b"), (6, "a" * 300), (7, "xyz" * 40), (8, "xyz" * 40)]
    assert groups(spark, rows) == brute(rows)


def test_odd_rows(spark):
    r = random.Random(4)
    p, q = made(r, 120), made(r, 70)
    assert repeat_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, p), (None, None), (1, None), (2, "a" + p), (2, "a" + p), (3, "b" + p), (3, "b" + p + "c" + q), (4, q), (4, q), (5, p[:30])]
    found = groups(spark, rows, key="k", rep="r", w=1, h="h", start=3, places="p", text_="t", length=0, hashes=1)
    assert found == brute(rows)
    assert found[p.encode()] == [(2, 1), (3, 1), (3, 1)] and found[q.encode()] == [(3, 122), (4, 0)]


def test_one_repeat_in_a_third_of_the_rows(spark):
    r = random.Random(5)
    p = made(r, 700)
    rows = [(i, (made(r, 20) + "ABC"[i % 3] + p + "DEF"[i % 3] + made(r, 20)) if i % 3 < 2 else made(r, 100)) for i in range(900)]
    found = groups(spark, rows)
    assert len(found[p.encode()]) == 600 and max(map(len, found)) < 730


def test_intervals_know_the_bytes_before_pieces():
    pieces, groups_ = [b"abcdefghij" * 6, b"abcdefghij" * 6 + b"z"], np.zeros(2, int)
    assert max(n for n, *_ in maximal_repeats(pieces, groups_)) == 60
    assert max((n for n, *_ in maximal_repeats(pieces, groups_, lefts=np.array([120, 120]))), default=0) < 60
    assert max(n for n, *_ in maximal_repeats(pieces, groups_, lefts=np.array([120, 121]))) == 60
    assert max(n for n, *_ in maximal_repeats(pieces, groups_, lefts=np.array([-1, -1]))) == 60
