"""Small fixtures with known answers, after the invariants that the operators promise."""

import math
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from termweave.functions import text as X
from termweave.operators import audit, blending, hierarchy, ivf, loaders, mapping, metrics, mining, ranges, rerank, sampling, vector
from termweave.sources import arrow, blocks, readers, schema, sheets, writers
from termweave.streaming.replay import buffered_shuffle, replay, shuffled_batches
from termweave.streaming.shuffle import remaining, shuffled_stream

NAMES = ["Diabetes mellitus", "Hypertension", "Heart failure", "Chronic kidney disease", "Pneumonia"]


@pytest.fixture(scope="module")
def corpus(spark):
    return vector.corpus_from_lists(spark, [1, 2, 3, 4, 5], NAMES, None).persist()


@pytest.fixture(scope="module")
def two(spark):
    return vector.encoded(spark.createDataFrame([(11, "Diabetes"), (12, "High blood pressure")], "query_id long, query_name string"), "query_name")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_repository_lifecycle(spark, corpus, two):
    r = vector.Repositories()
    assert not r.is_initialized()
    with pytest.raises(ValueError):
        r.search(two)
    with pytest.raises(ValueError):
        r.build(corpus.limit(0))
    with pytest.raises(ValueError):
        vector.corpus_from_lists(spark, [1], ["a", "b"], None)
    r.build(corpus)
    assert r.is_initialized() and not r.is_initialized(encoder="other")
    assert r.search(two, 3).count() == 6
    assert r.search(two, 10).count() == 10
    r.delete()
    assert not r.is_initialized()
    r.build(corpus, lists=True)
    assert rows(r.search(two, 3).select("query_id", "corpus_id", "score"), "query_id", "corpus_id") == rows(vector.search(two, corpus, 3).select("query_id", "corpus_id", "score"), "query_id", "corpus_id")
    r.delete()


def test_topk_strategies_agree_and_break_ties_by_id(spark):
    c = spark.createDataFrame([(i, f"n{i}", [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(8)] + [(99, "null", None)], "corpus_id long, corpus_name string, vector array<float>")
    q = spark.createDataFrame([(1, "q", [1.0, 0.5])], "query_id long, query_name string, vector array<float>")
    a, b = (rows(vector.topk(q, c, 5, s).select("corpus_id", "score", "rank"), "rank") for s in ("arrow", "expr"))
    assert a == b and [x[0] for x in a] == [1, 3, 5, 7, 0]


def test_topk_in_query_blocks(spark, monkeypatch):
    c = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)] + [(99, None)], "corpus_id long, vector array<float>")
    q = c.select(F.col("corpus_id").alias("query_id"), "vector")
    one = rows(vector.topk(q, c, 4), "query_id", "rank")
    monkeypatch.setattr(vector, "QUERY_BYTES", 200)
    monkeypatch.setattr(vector, "CORPUS_BYTES", 300)
    assert len(one) == 160 and rows(vector.topk(q, c, 4), "query_id", "rank") == one
    assert vector.scored(q, c).count() == 1600


def test_list_index_against_exact_search(spark, monkeypatch):
    """Vectors in clusters, one of which holds a third of all rows, in small parts and blocks: recall, and how little is read."""
    monkeypatch.setattr(ivf, "PART_ROWS", 50)
    monkeypatch.setattr(ivf, "ASK_ROWS", 4)
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 24))
    near = np.where(r.random(1500) < 0.33, 0, r.integers(0, 30, 1500))
    v = centres[near] + 0.15 * r.normal(size=(1500, 24))
    c = spark.createDataFrame([(i, [float(x) for x in row / np.linalg.norm(row)]) for i, row in enumerate(v)] + [(9999, None)], "corpus_id long, vector array<float>")
    q = c.where("corpus_id % 50 = 0 or corpus_id = 9999").withColumnRenamed("corpus_id", "query_id")
    index = ivf.ListIndex.build(c, 10)
    assert index.rows.count() == 1500 and index.sizes.agg(F.sum("size")).first()[0] == 1500
    f = index.figures(q, 10).first()
    assert f["queries"] == 30 and f["corpus"] == 1500 and f["recall"] >= 0.9 and f["read"] < 0.6 and f["scored"] <= 0.1
    hits = index.topk(q, 10)
    assert hits.groupBy("query_id").count().where("count <> 10").count() == 0 and hits.where("rank = 1 and query_id <> corpus_id").count() == 0


def test_list_index_of_few_equal_and_no_rows(spark):
    c = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)], "corpus_id long, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<float>")
    assert rows(ivf.ListIndex.build(c, 3).topk(q, 3).select("corpus_id", "rank"), "rank") == [(0, 1), (1, 2), (2, 3)]
    assert vector.topk(q, c, 100, "lists").count() == 30
    assert ivf.ListIndex.build(c.limit(0), 3).topk(q, 3).count() == 0



def test_draws_off_short_blacklists_are_not_written(spark, monkeypatch):
    wanted = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).alias("concept_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("s"))
    names = spark.range(50).select((F.col("id") * 3).alias("candidate_id"), F.col("id").cast("string").alias("sentence2"))
    black = spark.range(300).select((F.col("id") % 6).alias("concept_id"), (F.pmod(F.xxhash64("id"), F.lit(60)) * 3).alias("candidate_id"))
    made, write = [], sampling.written
    monkeypatch.setattr(sampling, "written", lambda df, name: made.append(name) or write(df, name))
    got = sampling.free_draws(wanted, "k", names, black, 4, beside=["s"])
    assert "draws" not in made and {"k", "s"} <= set(got.columns)
    monkeypatch.setattr(sampling, "LISTED", 25)  # some concepts by arrays, some by ranges
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sampling.free_draws(wanted, "k", names, black, 4, beside=["s"]).collect()))
    assert "draws" in made
    assert got.join(black.distinct(), ["concept_id", "candidate_id"]).count() == 0 and got.where(F.col("s") != F.concat(F.lit("s"), F.col("k").cast("string"))).count() == 0


def test_positives_are_numbered_by_concept_and_name(spark):
    targets = spark.createDataFrame([(i, f"c{i}") for i in (2, 1, 9, 5)], "concept_id long, concept_name string")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "name_id long, name string")
    bridge = spark.createDataFrame([(9, 0), (1, 5), (1, 2), (2, 3), (1, 2), (7, 1), (5, 8)], "concept_id long, name_id long")
    got = sampling.numbered_positives(targets, names, bridge).select("pos_idx", "concept_id", "name_id", "sentence1", "sentence2")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, "c1", "n2"), (2, 1, 5, "c1", "n5"), (3, 2, 3, "c2", "n3"), (4, 9, 0, "c9", "n0")]


def _found(search, ids, vectors):
    import pyarrow as pa

    batches = [pa.record_batch([pa.array(ids[x : x + 64]), pa.array(vectors[x : x + 64].tolist(), pa.list_(pa.float64()))], names=["corpus_id", "vector"]) for x in range(0, len(ids), 64)]
    return sorted((q, c, s) for b in search(iter(batches)) for q, c, s in zip(*b.to_pydict().values(), strict=True) if c is not None)


@pytest.mark.parametrize(("scale", "step"), [(1.0, 1e-9), (1e-12, 1e-9), (2.0**70, 0.25)])
def test_rough_scores_lose_no_hit(scale, step):
    """Scores that single precision can not tell apart, ties, NaN and lengths beyond it."""
    r = np.random.default_rng(4)
    v = np.ones((300, 8)) + r.integers(0, 4, (300, 8)) * step
    v[57], v[78, 2], v[9] = -1.0, np.nan, 0.0
    v, ids = v * scale, np.arange(300)[::-1].copy()
    q = np.arange(40)
    got = _found(vector._search(q, v[:40], 6), ids, v)
    score = np.round(v[:40] @ v.T, 9)
    score[np.isnan(score)] = -np.inf
    want = [(int(a), int(ids[c])) for a in q for c in np.lexsort((ids, -score[a]))[:6] if score[a, c] > -np.inf]
    assert sorted(want) == [x[:2] for x in got]


def test_search_asks_whether_pairs_are_allowed_only_near_the_top():
    r, asked = np.random.default_rng(5), []
    v, ids, q = r.normal(size=(6400, 8)), np.arange(6400), np.arange(20)

    def allowed(queries, at, batch):
        asked.append(len(at))
        return (queries + batch["corpus_id"].to_numpy()[at]) % 3 > 0

    got = _found(vector._search(q, v[:20], 5, allowed=allowed), ids, v)
    score = np.where((q[:, None] + ids) % 3 > 0, np.round(v[:20] @ v.T, 9), -np.inf)
    assert [x[:2] for x in got] == sorted((int(a), int(c)) for a in q for c in np.lexsort((ids, -score[a]))[:5])
    assert sum(asked) < 20 * 6400 / 10


def test_expressions_rank_few_of_all_pairs(spark):
    r = np.random.default_rng(6)
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(1500, 6)))], "corpus_id long, vector array<double>")
    q = c.where("corpus_id < 40").withColumnRenamed("corpus_id", "query_id")
    assert vector._expressed(q, c, 3).count() < 40 * 1500 / 10
    assert rows(vector.topk(q, c, 3, "expr").select("query_id", "rank", "corpus_id", "score"), "query_id", "rank") == rows(vector.topk(q, c, 3).select("query_id", "rank", "corpus_id", "score"), "query_id", "rank")


def test_list_index_never_broadcasts_vectors(spark):
    """Files of repeated vectors are small, so the guess by file size would send them all through the driver."""
    c = spark.range(3000).select(F.col("id").alias("corpus_id"), F.array(*[F.lit(float(i)).cast("float") for i in range(128)]).alias("vector"))
    index = ivf.ListIndex.build(c, 3)
    pairs = index.pairs(c.limit(5).withColumnRenamed("corpus_id", "query_id"), 3)
    assert pairs.columns == ["corpus_id", "query_id", "_q", "_c"]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [corpus_id" not in plan and "BroadcastHashJoin [query_id" not in plan

def test_draws_serve_every_key_that_the_blacklist_leaves(spark):
    names = spark.createDataFrame([(i, f"n{i}") for i in range(60)], "candidate_id long, sentence2 string")
    black = spark.createDataFrame([(1, i) for i in range(58)] + [(2, i) for i in range(60)] + [(3, i) for i in range(0, 60, 2)] + [(1, 5), (1, 900), (None, 3)], "concept_id long, candidate_id long")
    wanted = spark.createDataFrame([(c * 10 + k, c) for c in range(5) for k in range(3)], "k long, concept_id long")
    out = rows(sampling.free_draws(wanted, "k", names, black, 4).groupBy("concept_id", "k").agg(F.count("*"), F.count_distinct("candidate_id")), "k")
    assert [(c, n, d) for c, _, n, d in out] == [(c, n, n) for c, n in ((0, 4), (1, 2), (3, 4), (4, 4)) for _ in range(3)]
    assert sampling.free_draws(wanted, "k", names.limit(0), black, 4).count() == 0
    assert sampling.free_draws(wanted, "k", names, black.limit(0), 4).count() == 60


def test_draws_under_a_dense_blacklist_make_only_the_rows_they_keep(spark):
    """A concept that blacklists all but five names, with many keys: each gets all five, once, and nothing else is made on the way."""
    free = {3, 700, 701, 1500, 1999}
    names = spark.range(2000).select(F.col("id").alias("candidate_id"), F.concat(F.lit("n"), "id").alias("sentence2"))
    black = names.where(~F.col("candidate_id").isin(*free)).select(F.lit(7).cast("long").alias("concept_id"), "candidate_id")
    wanted = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") < 390, 7).otherwise(8).cast("long").alias("concept_id"))
    got = sampling.free_draws(wanted, "k", names, black, 5).collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append((r["seq"], r["candidate_id"]))
    assert len(got) == 2000 and all({c for _, c in x} == free and [s for s, _ in sorted(x)] == [1, 2, 3, 4, 5] for k, x in by.items() if k < 390)
    assert all(len({c for _, c in by[k]}) == 5 for k in range(390, 400)) and len({tuple(sorted(x)) for x in by.values()}) > 5


def test_search_leaves_barred_pairs_out_and_keeps_k(spark):
    """One anchor bars half of the corpus; every anchor still gets k rows, and its best barred score."""
    c = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)] + [(99, None)], "corpus_id long, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "query_id long, vector array<float>")
    barred = spark.createDataFrame([(1, i) for i in range(20, 40)] + [(2, 39), (2, 39), (2, 500), (9, 1)], "query_id long, corpus_id long")
    hits, best = vector.topk_barred(q, c, 3, barred)
    assert rows(hits.select("query_id", "rank", "corpus_id"), "query_id", "rank") == [(1, 1, 19), (1, 2, 18), (1, 3, 17), (2, 1, 38), (2, 2, 37), (2, 3, 36), (3, 1, 0), (3, 2, 1), (3, 3, 2)]
    assert rows(best, "query_id") == [(1, 39.0), (2, 39.0)]
    wide, _ = vector.topk_barred(q, c, 60, barred)
    assert rows(wide.groupBy("query_id").count(), "query_id") == [(1, 20), (2, 39), (3, 40)]
    assert vector.topk_barred(q, c.limit(0), 3, barred)[0].count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("parts", [1, 4, 8, 200])
def test_numbers_are_whole_and_in_order_after_a_shuffle(spark, parts, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        df = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("k"), (F.col("id") % 3).alias("g")).groupBy("k").agg(F.max("g").alias("g"))
        got = [r["name_id"] for r in mapping.numbered(df, ["k"]).orderBy("k").collect()]
        assert got == list(range(1, 20_001))
        within = ranges.numbered_within(df, "g", ["k"], "at").groupBy("g").agg(F.count("*").alias("n"), F.max("at").alias("m"), F.count_distinct("at").alias("d")).collect()
        assert all(r["n"] == r["d"] == r["m"] + 1 for r in within)
        assert ranges.running(df, ["k"], total="k").where("total <> k * (k + 1) / 2").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_synonym_map_has_one_id_a_row(spark):
    import os

    from termweave.plans import catalogue

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    got = rows(catalogue.QUERIES["combine_pipeline"](spark, "/root/testdata/sf0.01").select("name_id", "concept_id"), "name_id")
    assert [r[0] for r in got] == list(range(1, len(got) + 1)) and [r[1] for r in got] == sorted(r[1] for r in got)


def test_false_positives_are_mined_once(spark, corpus, two, tmp_path):
    path = f"file://{tmp_path}/fp"
    first = rows(loaders.false_positive_set(spark, path, corpus, two, n_fp=2), "query_id", "corpus_id")
    assert rows(loaders.false_positive_set(spark, path, corpus, two, n_fp=5), "query_id", "corpus_id") == first
    assert loaders.false_positive_set(spark, path, corpus, two, n_fp=5, resample=True).count() > len(first)


def test_loaders_from_a_folder(spark, letters, tmp_path):
    t, n, b = letters
    folder = f"file://{tmp_path}"
    fp = t.select("concept_id", F.lit(1).alias("seq"), F.lit(1).alias("fp_id"), F.lit("x").alias("sentence2"))
    for name, df in {"target_concepts": t, "name_table": n, "name_bridge": b, "false_positives": fp, "relation_false_positives": fp}.items():
        writers.write_table(df, f"{folder}/{name}")
    out = loaders.matching_from(spark, folder, n_neg=2)
    kinds = dict(rows(out.groupBy("from").count(), "from"))
    assert kinds == {"positive": 10, "negative": 20, "false_positive": 4}
    rel = spark.createDataFrame([(101, 1, "a", "a1"), (102, 2, "b", "b1")], "concept_id1 long, concept_id2 long, sentence1 string, sentence2 string")
    writers.write_table(rel, f"{folder}/relations")
    writers.write_table(n.select(F.col("name_id").alias("candidate_id"), F.col("name").alias("sentence2")), f"{folder}/candidates")
    down, up = loaders.relations_from(spark, folder, n_neg=3), loaders.relations_from(spark, folder, "ancestors", n_neg=3)
    assert all(r["sentence1"].startswith(X.CHILD_TOKEN) for r in down.collect()) and all(r["sentence2"].startswith(X.PARENT_TOKEN) for r in up.collect())
    assert up.where("label = 1").select("concept_id").distinct().count() == 2


def test_arrow_files(spark, tmp_path):
    import pandas as pd
    import pyarrow.feather

    frame = pd.DataFrame({"i": range(1000), "s": [f"x{i}" for i in range(1000)], "c": pd.Categorical(["a", "b"] * 500)})
    pyarrow.feather.write_feather(frame, f"{tmp_path}/a.feather", chunksize=100)
    (tmp_path / "many").mkdir()
    for k in range(2):
        pyarrow.feather.write_feather(frame, f"{tmp_path}/many/{k}.feather")
    for path, n in ((f"file://{tmp_path}/a.feather", 1), (f"file://{tmp_path}/many", 2)):
        got = arrow.read_arrow(spark, path)
        assert rows(got.groupBy("c").agg(F.count("*"), F.sum("i")), "c") == [("a", 500 * n, 249500 * n), ("b", 500 * n, 250000 * n)]


def test_arrow_reads_only_columns_and_rows_asked_for(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/wide"
    wide = spark.range(3000).select(*[(F.col("id") * k).alias(f"c{k}") for k in range(9)], F.when(F.col("id") % 2 > 0, F.col("id").cast("string")).alias("s"))
    arrow.write_arrow(wide.repartition(3), path)
    arrow.write_arrow(wide.limit(0), path, "append")
    df = arrow.read_arrow(spark, path, ["s", "c3"]).where("c3 >= 6000 and s is not null and c3 in (6003, 6006, 6009)")
    assert rows(df, "c3") == [("2001", 6003), ("2003", 6009)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "c1#" not in plan and "c8#" not in plan
    reader = arrow.ArrowReader(path, df.schema)
    assert list(reader.pushFilters([arrow.GreaterThan(("c3",), 8990), arrow.EqualTo(("a", "b"), 1)])) == [arrow.EqualTo(("a", "b"), 1)]
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert {tuple(b.schema.names) for b in batches} == {("s", "c3")} and sum(b.num_rows for b in batches) == 3
    monkeypatch.setattr(arrow, "SLICE_BYTES", 100)
    many = arrow.ArrowReader(path, df.schema).partitions()
    assert len(many) > 3 and sum(b.num_rows for p in many for b in arrow.ArrowReader(path, df.schema).read(p)) == 3000
    with pytest.raises(Exception, match="lacks"):
        spark.read.format(arrow.NAME).schema("nope long").load(path).collect()
    arrow.write_arrow(wide.limit(5), path)
    assert arrow.read_arrow(spark, path).count() == 5 and not [f for f in (tmp_path / "wide").iterdir() if f.name.startswith(".part")]


def test_sheets_keep_texts(spark, tmp_path):
    texts = ["plain", " two  spaces ", "<a & b>", "line\nbreak", "é日🎉", "bad\x01char", None, "", '"quoted"']
    df = spark.createDataFrame([(i, x, i * 0.5) for i, x in enumerate(texts)], "i long, s string, other double")
    path = f"file://{tmp_path}/new/a.xlsx"
    assert sheets.write_sheet(df, path, ["i"], None) == 9
    got = {int(r["i"]): r["s"] for r in sheets.read_sheet(spark, path, ["s", "i"]).collect()}
    assert got == dict(enumerate(texts)) | {5: "badchar"}
    assert sheets.write_sheet(df, path, [F.desc("i")], 2) == 2 and [r["i"] for r in sheets.read_sheet(spark, path, ["i"]).collect()] == ["8", "7"]
    assert sheets.write_sheet(df.limit(0), path, ["i"]) == 0 and sheets.read_sheet(spark, path, ["i"]).count() == 0
    with pytest.raises(Exception, match="lacks"):
        sheets.read_sheet(spark, path, ["nope"]).collect()
    assert [sheets._column(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and sheets._place("AAA10") == 702


def test_cells_that_span_lines(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('id\tname\n1\t"two\nlines"\n2\tx\n')
    assert [r["name"] for r in readers.read_tsv(spark, f"file://{tmp_path}/c.tsv", multi_line=True).orderBy("id").collect()] == ["two\nlines", "x"]


def test_a_buffered_shuffle_keeps_rows_and_its_reach(spark):
    df = spark.range(0, 5000, 1, 3).withColumn("p", F.spark_partition_id())
    got = buffered_shuffle(df, 100, 5).collect()
    assert sorted(r["id"] for r in got) == list(range(5000))
    first = {p: min(r["id"] for r in got if r["p"] == p) for p in range(3)}
    assert all(r["place"] >= r["id"] - first[r["p"]] - 100 for r in got)
    assert sum(r["place"] != r["id"] - first[r["p"]] for r in got) > 4000
    assert sorted(map(tuple, got)) == sorted(map(tuple, buffered_shuffle(df, 100, 5).collect()))


def test_batches_of_a_stream_come_in_a_drawn_order(spark, tmp_path):
    spark.range(100).withColumnRenamed("id", "k").coalesce(1).write.parquet(f"{tmp_path}/s")
    seen = []
    q = shuffled_batches(replay(spark, f"file://{tmp_path}/s", spark.read.parquet(f"{tmp_path}/s").schema), lambda b, e: seen.extend(r["k"] for r in b.collect()), 4, "k")
    q.awaitTermination()
    assert sorted(seen) == list(range(100)) and seen != sorted(seen)


def test_false_positives_honour_the_blacklist(spark, corpus, two):
    black = spark.createDataFrame([(11, 1)], "query_id long, corpus_id long")
    out = mining.false_positives(corpus, two, black, 3)
    assert out.where("query_id = 11 and corpus_id = 1").count() == 0
    assert out.where("label <> 0").count() == 0 and out.count() <= 6
    assert mining.false_positives(corpus, n_fp=3).count() <= 15


def test_wide_and_long_negatives(spark):
    n = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.8), (2, 7, 0.5)], "query_id long, corpus_id long, score double")
    assert rows(mining.long_negatives(mining.wide_negatives(n, 2)), "query_id", "negative") == [(1, 5, 0), (1, 6, 0), (2, 7, 0)]
    assert mining.long_negatives(spark.createDataFrame([(1,)], "query_id long")).count() == 0


@pytest.fixture(scope="module")
def letters(spark):
    names = ["a1", "b1", "b2", "c1", "c2", "c3", "d1", "d2", "d3", "d4"]
    t = spark.createDataFrame([(101 + i, x) for i, x in enumerate("abcd")], "concept_id long, concept_name string")
    n = spark.createDataFrame([(i + 1, x) for i, x in enumerate(names)], "name_id long, name string")
    b = spark.createDataFrame([(101 + "abcd".index(x[0]), i + 1) for i, x in enumerate(names)], "concept_id long, name_id long")
    return t, n, b


@pytest.mark.parametrize(("most", "expected"), [(10, [1, 2, 3, 4]), (2, [1, 2, 2, 2]), (0, [])])
def test_positives_are_capped(letters, most, expected):
    out = sampling.positives(*letters, most=most).groupBy("concept_id").count()
    assert [n for _, n in rows(out, "concept_id")] == expected


@pytest.mark.parametrize(("most", "expected"), [(100, [9, 8, 7, 6]), (2, [2, 2, 2, 2])])
def test_negatives_avoid_the_blacklist(letters, most, expected):
    t, n, b = letters
    out = sampling.negatives(t, n, b, most=most)
    assert [x for _, x in rows(out.groupBy("concept_id").count(), "concept_id")] == expected
    assert out.join(b, ["concept_id", "name_id"]).count() == 0
    assert out.select("concept_id", "name_id").distinct().count() == out.count()


def test_seeds_decide_draws(letters):
    t, n, b = letters
    one, same, other = (rows(sampling.negatives(t, n, b, 3, s).select("concept_id", "name_id"), "concept_id", "name_id") for s in (1, 1, 2))
    assert one == same and one != other


def test_interleaved_has_the_promised_length(spark, letters):
    t, n, b = letters
    p = sampling.positives(t, n, b, most=2).withColumn("pos_idx", F.col("name_id"))
    c = n.select(F.col("name_id").alias("candidate_id"), F.col("name").alias("sentence2"))
    black = b.withColumnRenamed("name_id", "candidate_id")
    fp = t.select("concept_id", F.lit(1).alias("seq"), F.lit(1).alias("fp_id"), F.lit("x").alias("sentence2"))
    out = sampling.interleaved(p, c, black, fp, n_neg=8)
    assert out.count() == sampling.interleaved_length(p, 10, black, fp, 8).first()[0]
    assert audit.kind_label_conflicts(out).agg(F.sum("n_conflicts")).first()[0] == 0


def test_split_sizes_add_up(spark):
    pairs = spark.createDataFrame([(i % 20, i) for i in range(100)], "concept_id long, name_id long")
    out = dict(rows(mapping.split_pairs(pairs, 3, 2).groupBy("split").count(), "split"))
    assert out == {"test": 3, "train": 95, "valid": 2}
    assert dict(rows(mapping.split_pairs(pairs, 3, 2, disjoint=True).groupBy("split").count(), "split"))["train"] == 75


def test_concatenation_keeps_order_and_permutes(spark):
    a = spark.createDataFrame([(i,) for i in (1, 2, 3)], "a int")
    b = spark.createDataFrame([(i,) for i in (4, 5, 6)], "a int")
    out = blending.concatenated({"x": a, "y": b}, {"x": "a", "y": "a"}, seed=3)
    assert [r[0] for r in rows(out.select("a", "global_pos"), "global_pos")] == [1, 2, 3, 4, 5, 6]
    assert sorted(r[0] for r in out.select("shuffled_pos").collect()) == list(range(6))


def test_quotas_and_iteration_sizes():
    assert blending.quotas({"a": 1, "b": 1, "c": 1}, 8) == {"a": 3, "b": 3, "c": 2}
    assert blending.iteration_sizes({"a": 10}, {"a": 3}) == {"a": 4}
    with pytest.raises(ValueError):
        blending.iteration_sizes({"a": 1}, {"b": 1})
    with pytest.raises(ValueError):
        blending.iteration_sizes({"a": 1}, {"a": 0})


@pytest.fixture(scope="module")
def tree(spark):
    e = [(1, 4, 1), (2, 4, 1), (7, 8, 1), (7, 8, 2), (20, 8, 1), (10, 11, 1), (12, 11, 1), (13, 15, 1), (10, 15, 2)]
    return spark.createDataFrame(e, "ancestor long, descendant long, level int")


def test_parents_of_the_worked_example(tree):
    out = {r["concept_id"]: r["parents"] for r in hierarchy.neighbours(tree).collect()}
    assert (out[4], out[8], out[11], out[15]) == ([1, 2], [7, 20], [10, 12], [13])


def test_distances(spark, tree):
    p = spark.createDataFrame([(4, 1), (1, 4), (11, 15), (4, 8)], "a long, b long")
    assert rows(hierarchy.distance(p, tree), "a", "b") == [(1, 4, 1), (4, 1, 1), (4, 8, None), (11, 15, 3)]


def test_expansion_reaches_further_each_hop(spark, tree):
    s = spark.createDataFrame([(11,)], "concept_id long")
    assert [r["concept_id"] for r in hierarchy.expanded(s, tree, 1).orderBy("concept_id").collect()] == [10, 11, 12]


def test_adaptive_tiers(spark):
    df = spark.createDataFrame([(0.2, 0.6), (0.5, 0.4), (0.95, 0.25), (0.5, 0.1), (0.5, 0.17), (0.5, None)], "s double, p double")
    got = [r[0] for r in df.select(rerank.adaptive(F.col("s"), F.col("p"))).collect()]
    assert [round(x, 6) for x in got] == [0.56, 0.578, 0.96, 0.46, 0.5, 0.5]


def test_metrics_against_brute_force(spark):
    data = [(1, 1, 0.9, 1), (1, 2, 0.8, 0), (1, 3, 0.8, 1), (2, 1, 0.7, 0), (2, 2, 0.3, 0), (2, 3, 0.3, 1)]
    df = spark.createDataFrame(data, "query_id long, corpus_id long, score double, label int")
    pos, neg = [r[2] for r in data if r[3]], [r[2] for r in data if not r[3]]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / 9
    assert math.isclose(metrics.roc_auc(df).first()[0], auc)
    m = metrics.ranking_metrics(df).first()
    assert m["best_hit_1"] == 0.5 and math.isclose(m["best_reciprocal_rank"], (1 + 1 / 3) / 2) and math.isclose(m["worst_reciprocal_rank"], 1 / 3)
    one = df.withColumn("label", F.lit(0))
    assert metrics.roc_auc(one).first()[0] is None and metrics.threshold_metrics(one).first()["f1"] == 0.0


def test_multi_target_score(spark):
    df = spark.createDataFrame([([5, 6, 7], [5, 6]), ([5, 6, 7], [7]), ([5], [9])], "r array<long>, t array<long>")
    assert [r[0] for r in df.select(metrics.multi_target_score(metrics.positions(F.col("r"), F.col("t")))).collect()] == [1, 3, 99999]


def test_text_functions(spark):
    df = spark.createDataFrame([("<|parent of|> Type: Älter Name",)], "s string")
    r = df.select(X.strip_prefix("s"), X.after_colon("s"), X.is_ascii("s"), X.truncated("s", 10)).first()
    assert tuple(r) == ("Type: Älter Name", "Älter Name", False, "<|paren...")
    ids = spark.createDataFrame([("12",), (" 7 ",), ("1.5",), ("x",), (None,)], "s string")
    assert [r[0] for r in ids.select(X.tolerant_id("s")).collect()] == [12, 7, 1, None, None]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1 << 20,), (5 << 30,), (3 << 40,), (1 << 50,), (7 << 60,), (None,)], "n long")
    assert [r[0] for r in sizes.select(X.bytes_text("n")).collect()] == ["0.00 B", "1023.00 B", "1.00 KB", "1.50 KB", "1.00 MB", "5.00 GB", "3.00 TB", "1.00 PB", f"{7 * 1024:.2f} PB", None]
    assert X.bytes_label(2048) == "2.00 KB"


def test_delimited_scans_keep_and_drop_what_they_should(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('concept_id\tconcept_name\tstandard_concept\n1\t"say ""x"""\tS\n2\tNA\t\n')
    got = rows(readers.read_tsv(spark, f"file://{tmp_path}/c.tsv"), "concept_id")
    assert got == [("1", 'say "x"', "S"), ("2", "NA", "")]
    a, b = mapping.split_standard(readers.read_tsv(spark, f"file://{tmp_path}/c.tsv"))
    assert (a.count(), b.count()) == (1, 1)
    (tmp_path / "d.rrf").write_text("C1|A1|AT1|S|SRC|text|N||\nC2|A2|AT2|S|SRC|NA|N||\n")
    got = readers.read_definitions(spark, f"file://{tmp_path}/d.rrf").orderBy("CUI").collect()
    assert [r["DEF"] for r in got] == ["text", None] and "CVF" not in got[0].asDict()


def test_sinks_and_collections(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    writers.write_table(df, f"file://{tmp_path}/t")
    writers.write_review(df, f"file://{tmp_path}/r", ["k"], 1)
    assert rows(readers.read_csv(spark, f"file://{tmp_path}/r"), "k") == [("1", "a")]
    writers.write_metrics(df, f"file://{tmp_path}/m")
    assert spark.read.json(f"file://{tmp_path}/m").count() == 2
    c = writers.Collection(spark, f"file://{tmp_path}/col")
    assert not c.exists()
    c.add(df.select(F.col("k").alias("id"), F.col("v").alias("document"), F.array(F.lit(1.0)).alias("embedding")))
    assert c.load().count() == 2
    c.empty()
    assert not c.exists()
    assert readers.first_existing(spark, [f"file://{tmp_path}/none", f"file://{tmp_path}/t"]).endswith("/t")
    assert readers.read_tables(spark, f"file://{tmp_path}/t", f"file://{tmp_path}/t").count() == 4


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(ValueError):
        schema.require_columns(df, ["c"])
    with pytest.raises(ValueError):
        schema.require_integer(df, ["b"])
    assert schema.resolve_aliases(df, [{"q": "zz"}, {"q": "a"}]).columns == ["q", "b"]


def test_null_keys_and_empty_tables(spark):
    e = spark.createDataFrame([], "query_id long, corpus_id long, score double, label int")
    assert metrics.roc_auc(e).first()[0] is None
    assert mapping.numbered(spark.createDataFrame([("b",), ("a",), ("a",)], "x string"), ["x"]).agg(F.sum("name_id")).first()[0] == 6
    f = mapping.factorized(spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "i int, v string"), "v", "i")
    assert [r["code"] for r in f.orderBy("i").collect()] == [0, 1, 0, -1]


def test_merge_of_a_hot_rank(spark):
    """One rank holds a third of the rows, one stream of it most of them; capped and not, against the windows it stands for."""
    r = np.random.default_rng(3)
    n = 6000
    rank = np.where(r.random(n) < 0.34, 0, r.integers(1, 200, n)).tolist()
    made = [(i, None if k == 7 else k, None if s == 3 else f"s{s}") for i, k, s in zip(r.permutation(n).tolist(), rank, np.where(r.random(n) < 0.6, 0, r.integers(0, 5, n)).tolist(), strict=True)]
    df = spark.createDataFrame(made, "i long, rank long, stream string").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        for most in (None, 1, 40):
            own, whole = Window.partitionBy("rank", "stream").orderBy("i"), Window.partitionBy("rank").orderBy("stream", "i")
            want = df.withColumn("n", F.row_number().over(own)).where(F.col("n") <= (most or n)).withColumn("pos", F.row_number().over(whole)).select("i", "pos")
            got = blending.merged(df, "rank", "stream", "i", most)
            assert got.columns == ["i", "rank", "stream", "pos"] and rows(got.select("i", "pos"), "i") == rows(want, "i")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    parts = ranges.ranged(df, ["rank", "stream", "i"]).where("rank = 0").select("_part").distinct().count()
    assert parts > 1


def _events_in(spark, path, first, last):
    for i in range(first, last):
        spark.range(i * 40, i * 40 + 40).select(F.col("id"), F.concat(F.lit("v"), "id").alias("v")).coalesce(1).write.mode("append").parquet(path)


def test_shuffle_buffer_lives_from_batch_to_batch_and_survives_a_restart(spark, tmp_path):
    schema = "id long, v string"
    got = {}
    for name, cuts in (("once", [(0, 5)]), ("twice", [(0, 2), (2, 5)])):
        path, done, point = (f"{tmp_path}/{name}-{x}" for x in ("in", "out", "checkpoint"))
        for first, last in cuts:
            _events_in(spark, path, first, last)
            stream = shuffled_stream(replay(spark, path, spark.createDataFrame([], schema).schema), 60, 9, ["id"], F.col("id") % 2)
            stream.writeStream.format("parquet").option("path", done).option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination()
        left = remaining(spark, point, spark.createDataFrame([], schema).schema, 9)
        out = spark.read.schema(stream.schema).parquet(done)
        assert out.count() == 80 and left.count() == 120
        got[name] = rows(out.unionByName(left), "shard", "place")
    assert got["once"] == got["twice"] and sorted(r[0] for r in got["once"]) == list(range(200))
    for shard in (0, 1):
        own = [r for r in got["once"] if r[2] == shard]
        assert [r[3] for r in own] == list(range(100)) and all(r[1] == f"v{r[0]}" and r[0] % 2 == shard for r in own)
        at = {r[0]: r[3] for r in own}
        # a row of the first file (ids below 40) leaves after all of the first two have come; none leaves more than a buffer early
        assert max(at[i] for i in at if i < 40) >= 40 and all(at[i] >= i // 2 - 60 for i in at) and [r[0] for r in own] != sorted(r[0] for r in own)


def test_shuffle_buffer_is_emptied_by_timer(spark, tmp_path):
    _events_in(spark, f"{tmp_path}/in", 0, 1)
    stream = shuffled_stream(replay(spark, f"{tmp_path}/in", spark.createDataFrame([], "id long, v string").schema), 25, 9, ["id"], idle=500)
    q = stream.writeStream.format("memory").queryName("emptied").trigger(processingTime="300 milliseconds").start()
    end = time.time() + 60
    while time.time() < end and spark.table("emptied").count() < 40:
        time.sleep(0.5)
    q.stop()
    assert sorted((r["id"], r["place"]) for r in spark.table("emptied").collect())[0][0] == 0
    assert sorted(r["place"] for r in spark.table("emptied").collect()) == list(range(40))
    with pytest.raises(ValueError):
        shuffled_stream(stream, 0, 1, ["id"])


def test_block_reads_open_only_the_blocks_asked_for(spark, tmp_path):
    path = f"file://{tmp_path}/blocks"
    df = spark.range(1000).select(((F.col("id") * 7) % 1000).alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), "id")).alias("v")).repartition(5)
    blocks.write_blocks(df, path, ["k"], 64)
    held = blocks.Blocks(spark, path)
    assert held.rows == 1000 and held.index.agg(F.count("*"), F.count_distinct("block")).first()[0] == 16
    want = {r["k"]: r["v"] for r in df.collect()}
    asked = [0, 1, 63, 64, 999, 999, 500, 501, 502]
    opened = spark.sparkContext.accumulator(0)
    got = held.at(spark.createDataFrame([(i,) for i in asked], "position int"), opened).collect()
    assert sorted(r["position"] for r in got) == sorted(asked) and all(r["k"] == r["position"] and r["v"] == want[r["k"]] for r in got)
    assert opened.value == 4  # blocks 0, 1, 7 and 15, each once
    assert held.at(spark.range(1000).withColumnRenamed("id", "position")).count() == 1000
    for bad in (-1, 1000):
        with pytest.raises(IndexError):
            held.at(spark.createDataFrame([(bad,), (3,)], "position long"))
    blocks.write_blocks(df.limit(0), f"{path}-none", ["k"], 64)
    none = blocks.Blocks(spark, f"{path}-none")
    assert none.rows == 0 and none.at(spark.createDataFrame([], "position long")).count() == 0
    with pytest.raises(ValueError):
        none.cycle(5, 1)


@pytest.mark.parametrize(("n", "block"), [(1000, 64), (64, 64), (10, 64), (130, 1)])
def test_a_cycle_meets_every_row_once_an_epoch(spark, n, block):
    places = spark.range(3 * n).select(F.expr(f"id div {n}").alias("epoch"), (F.col("id") % n).alias("place"))
    got = blocks.cycle_places(places, n, block, n // block, 5).select("epoch", "place", (F.col("_block") * block + F.col("_at")).alias("row")).collect()
    orders = [[r["row"] for r in sorted(got, key=lambda r: r["place"]) if r["epoch"] == e] for e in range(3)]
    assert all(sorted(o) == list(range(n)) for o in orders) and len({tuple(o) for o in orders}) == 3
    runs = [o[i] // block == o[i + 1] // block for o in orders for i in range(n - 1)]
    assert block == 1 or sum(runs) >= len(runs) - 3 * (n // block)


def test_collection_versions(spark, tmp_path):
    row = "id string, document string, embedding array<float>"
    held = writers.Collection(spark, f"file://{tmp_path}/vectors")
    assert not held.exists() and held.load().count() == 0
    assert held.get_or_create().version() == held.get_or_create().version() == 1
    held.add(spark.createDataFrame([("a", "A", [1.0]), ("b", "B", [1.0]), ("b", "A", [9.0]), (None, "x", [1.0])], row))
    old = held.load()
    held.add(spark.createDataFrame([("b", "new", [2.0]), ("c", None, None)], row))
    assert rows(old, "id") == [("a", "A", [1.0]), ("b", "B", [1.0])]  # a reader keeps its version
    assert rows(held.load(), "id") == [("a", "A", [1.0]), ("b", "new", [2.0]), ("c", None, None)] and rows(held.load(2), "id") == rows(old, "id")
    held.remove(spark.createDataFrame([("a",), ("z",)], "id string"))
    held.add(spark.createDataFrame([("a", "back", [3.0])], row))
    assert [r[0] for r in rows(held.load(4), "id")] == ["b", "c"] and rows(held.load(), "id")[0] == ("a", "back", [3.0])
    before = rows(held.load(), "id")
    assert held.compact() == 6 and len(held.batches()) == 1 and rows(held.load(), "id") == before and len(held.batches(5)) == 4
    with pytest.raises(RuntimeError):
        held._commit(lambda old: old, 3)


def test_collection_writers_at_once(spark, tmp_path):
    held = writers.Collection(spark, f"file://{tmp_path}/vectors")
    add = lambda i: held.add(spark.createDataFrame([("same", f"d{i}", [1.0]), (f"own{i}", "d", [1.0])], "id string, document string, embedding array<float>"))
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(add, range(6)))
    assert sorted(versions) == list(range(1, 7)) and held.load().count() == 7
    assert held.load().where("id = 'same'").first()["document"] == f"d{versions.index(6)}"


def test_table_profile_is_exact_where_it_says_and_near_elsewhere(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 700).cast("int").alias("few"), F.concat(F.lit("é"), (F.col("id") % 9000).cast("string")).alias("s"), F.when(F.col("id") % 4 > 0, F.col("id") / 2).alias("half"), F.lit(None).cast("string").alias("none"), F.array(F.col("id"), F.lit(None)).alias("a"), (F.col("id") % 2 == 0).alias("flag"), F.lit(1).cast("decimal(9,2)").alias("d"))
    by = df.withColumn("part", F.col("id") % 5)
    for found in (audit.sketches(df), audit.merged_sketches(audit.sketches(by, "part").drop("part"))):
        out = {r["column_name"]: r for r in audit.table_profile(found).collect()}
        assert all(r["rows"] == 20_000 for r in out.values()) and {c: r["n_null"] for c, r in out.items() if r["n_null"]} == {"half": 5000, "none": 20_000}
        assert out["id"]["bytes"] == 160_000 and out["half"]["bytes"] == 120_000 and out["none"]["bytes"] == 0 and out["flag"]["bytes"] == 20_000 and out["a"]["bytes"] == 320_000
        assert out["s"]["bytes"] == sum(2 + len(str(i % 9000)) for i in range(20_000)) and out["d"]["type"] == "decimal(9,2)"
        exact = {"id": 20_000, "few": 700, "s": 9000, "half": 15_000, "none": 0, "a": 20_000, "flag": 2, "d": 1}
        assert all(abs(out[c]["n_distinct"] - n) <= 0.05 * n for c, n in exact.items())
        assert all(abs(q - want) <= 400 for q, want in zip(out["id"]["quantiles"], (5000, 10_000, 15_000), strict=True)) and out["s"]["quantiles"] is None and out["d"]["quantiles"] == [1.0, 1.0, 1.0]
    none = {r["column_name"]: r for r in audit.table_profile(audit.sketches(df.limit(0))).collect()}
    assert all(r["rows"] == 0 and r["n_distinct"] == 0 and r["quantiles"] is None for r in none.values())


def _grouped(spark, n=300, copies=0):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if copies:
        v[:copies] = v[0]
    v = v.astype(np.float32)
    g = rng.integers(0, 5, n)
    rows = [(i, v[i].tolist(), int(g[i]) if i % 17 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, vector array<float>, g int")
    return df.select(F.col("i").alias("query_id"), "vector", F.col("g").alias("qg")), df.select(F.col("i").alias("corpus_id"), "vector", F.col("g").alias("cg")), np.round(v.astype(float) @ v.astype(float).T, 9), [r[2] for r in rows]


def _positives_of(g):
    return [[a is not None and a == b and i != j for j, b in enumerate(g)] for i, a in enumerate(g)]


@pytest.mark.parametrize("dealt", [False, True])
def test_metrics_over_all_pairs_equal_the_plain_ones(spark, monkeypatch, dealt):
    if dealt:
        monkeypatch.setattr(vector, "QUERY_BYTES", 5000)
        monkeypatch.setattr(vector, "CORPUS_BYTES", 7000)
    monkeypatch.setattr(vector, "PAIRS", 500)
    q, c, score, g = _grouped(spark)
    pos = _positives_of(g)
    rows = [(i, j, float(score[i, j]), int(pos[i][j])) for i in range(len(g)) for j in range(len(g))]
    plain = spark.createDataFrame(rows, "query_id long, corpus_id long, score double, label int").withColumn("score", F.round("score", 2))
    want = {(r["score"], r["label"]): r["n"] for r in plain.groupBy("score", "label").agg(F.count("*").alias("n")).collect()}
    counts = vector.score_counts(q, c, ("qg", "cg"))
    assert {(r["score"], r["label"]): r["n"] for r in counts.collect()} == want
    assert sorted(map(str, vector.positive_ranks(q, c, ("qg", "cg")).collect())) == sorted(map(str, metrics.query_ranks(plain).collect()))
    for f in (metrics.roc_auc, metrics.average_precision, metrics.threshold_metrics):
        assert f(counts, weight="n").first() == pytest.approx(f(plain).first())


@pytest.mark.parametrize("dealt", [False, True])
def test_groups_bar_and_label_as_their_pairs_do(spark, monkeypatch, dealt):
    if dealt:
        monkeypatch.setattr(vector, "QUERY_BYTES", 5000)
        monkeypatch.setattr(vector, "CORPUS_BYTES", 7000)
    monkeypatch.setattr(vector, "PAIRS", 500)
    q, c, _, g = _grouped(spark)
    pos = mining.group_pairs(q.select("query_id", "qg"), c.select("corpus_id", "cg"), ("qg", "cg"))
    flags = _positives_of(g)
    assert {tuple(r) for r in pos.select("query_id", "corpus_id").collect()} == {(i, j) for i in range(len(g)) for j in range(len(g)) if flags[i][j]}
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(mining.hard_negatives(q, c, pos, 2, 30), mining.hard_negatives(q, c, ("qg", "cg"), 2, 30))
    hits = vector.topk(q, c, 9).drop("rank")
    assert same(mining.labelled_hits(hits, pos), mining.labelled_by_group(hits, q, c, ("qg", "cg")))
    firsts = {r["query_id"]: r["truths"] for r in mining.first_of_group(q, c, ("qg", "cg"), 2).collect()}
    assert firsts == {i: [j for j in range(len(g)) if flags[i][j]][:2] for i in range(len(g)) if any(flags[i])}
    before, after = vector.topk(q, c, 9), vector.topk(q, c, 20).withColumn("rank", 21 - F.col("rank"))
    assert same(rerank.rank_change(before, after, pos), rerank.group_rank_change(before, after, q, c, ("qg", "cg")))


def test_scores_that_are_no_numbers_are_no_pairs(spark):
    q = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(3)], "query_id long, vector array<double>, qg long")
    c = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [float("nan"), 0.0], 0), (2, [0.25, 0.5], 0)], "corpus_id long, vector array<double>, cg long")
    counts = {(r["score"], r["label"]): r["n"] for r in vector.score_counts(q, c, ("qg", "cg")).collect()}
    assert counts == {(1.0, 0): 1, (1.0, 1): 2, (0.25, 1): 1, (0.75, 1): 1, (1.25, 0): 1}
    assert {(r["query_id"], r["corpus_id"], r["rank"]) for r in vector.topk(q, c, 3).collect()} == {(0, 0, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2), (2, 2, 1), (2, 0, 2)}
    assert {(r["query_id"], r["corpus_id"]) for r in vector.within(q, c, 1.0).collect()} == {(0, 0), (1, 0), (2, 0), (2, 2)}


def test_near_perfect_pairs_are_all_found(spark):
    q, c, score, _ = _grouped(spark, 60, copies=12)
    got = {(r["query_id"], r["corpus_id"]) for r in vector.within(q, c).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if score[i, j] >= 0.999} and len(got) >= 12 * 12


def test_a_search_scores_few_pairs_at_a_time():
    """A block of queries and a batch of the corpus were scored as one matrix: 2 GB for 65,536 queries and 4,096 rows."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 4)).round(2)
    batches = [pa.record_batch([pa.array(np.arange(i, i + 3000)), pa.array(list(x[i : i + 3000]), pa.list_(pa.float32()))], names=["corpus_id", "vector"]) for i in (3000, 0)]
    tracemalloc.start()
    out = pa.Table.from_batches(list(vector._search(np.arange(6000), x, 5)(iter(batches))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and out.num_rows == 30000
    score = np.round(x[:50] @ x.astype(np.float32).astype(float).T, 9)
    want = {(i, int(j)) for i in range(50) for j in np.lexsort((np.arange(6000), -score[i]))[:5]}
    assert {(a, b) for a, b in zip(out["query_id"].to_pylist(), out["corpus_id"].to_pylist(), strict=True) if a < 50} == want


def test_signatures_are_compared_in_blocks(spark, monkeypatch):
    q, c, _, _ = _grouped(spark, 200)
    want = sorted(map(str, vector.lsh_topk(q, c, 4, planes=5, tables=3).collect()))
    monkeypatch.setattr(vector, "QUERY_BYTES", 3000)
    monkeypatch.setattr(vector, "CORPUS_BYTES", 3000)
    found = vector.lsh_topk(q, c, 4, planes=5, tables=3)
    assert sorted(map(str, found.collect())) == want and len(want) == 800


def test_lists_are_fitted_some_rows_at_a_time(spark, monkeypatch):
    import tracemalloc

    x = np.random.default_rng(2).normal(size=(8192, 4))
    tracemalloc.start()
    near = ivf._nearest(x, x[:2048])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20 and (near[:100] == (x[:100] @ x[:2048].T).argmax(1)).all()  # 134 MB as one matrix
    monkeypatch.setattr(ivf, "FIT_ROWS", 20)
    _, c, _, _ = _grouped(spark)
    c = c.repartition(7)
    drawn = c.orderBy(X.seeded_order(7, "corpus_id"), "corpus_id").limit(20).collect()
    index = ivf.ListIndex.build(c, 3)
    assert np.allclose(index.centroids, ivf._centroids(np.array([r["vector"] for r in drawn], float), len(index.centroids)))


def test_expression_search_deals_a_table_of_one_file(spark):
    q, c, _, _ = _grouped(spark, 50)
    found = vector.topk(q.coalesce(1), c.coalesce(1), 3, "expr")
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "query_id", "rank") == rows(vector.topk(q, c, 3), "query_id", "rank")


def test_ranges_grow_in_number_and_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50)
    out = ranges.ranged(spark.range(5000), ["id"])
    sizes = [r["count"] for r in out.groupBy("_part").count().collect()]
    assert sum(sizes) == 5000 and len(sizes) > 50 and max(sizes) < 500
    assert [r["n"] for r in ranges.numbered(spark.range(5000), ["id"], "n").orderBy("id").collect()] == list(range(1, 5001))


def test_pairs_are_dealt_by_their_number_and_equal_the_plain_join(spark, monkeypatch):
    from termweave.plans import catalogue, standins

    monkeypatch.setattr(ranges, "RANGE_ROWS", 100)
    d = "/root/testdata/sf0.001"
    sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    bridge, names = standins.bridge(spark, d), standins.table(spark, d, "supplier").selectExpr("s_suppkey as name_id", "s_name as name")
    want = bridge.join(standins.concept(spark, d), "concept_id").join(names, "name_id")
    found = sampling.positives(standins.concept(spark, d), names, bridge, most=1 << 30)
    assert sorted(map(str, found.select("concept_id", "name_id", "sentence2").collect())) == sorted(map(str, want.select("concept_id", "name_id", F.col("name").alias("sentence2")).collect()))
    named = want.select("concept_id", F.concat("concept_name", F.lit(" by "), "name").alias("name")).distinct()
    assert sorted(map(str, catalogue.definition_join(spark, d).collect())) == sorted(map(str, named.collect()))
    rows = bridge.count()
    for out in (bridge, found, catalogue.definition_join(spark, d), catalogue.pair_frames(spark, d)):
        assert sum(sizes(out)) == rows and max(sizes(out)) < rows / 8


def test_compared_metrics_search_once(spark):
    from termweave.plans import catalogue

    plan = catalogue.metric_compare(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "Relation" in plan
