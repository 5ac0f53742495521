"""The training-data operators on nasty rows, and against brute force."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termweave.llm import encode, media, mixing, ngram_join, packing, quality, repeats, token_counts, token_files, toxicity
from termweave.llm.components import components
from termweave.llm.line_dedup import line_dedup
from termweave.llm.ngram_join import linked, near_duplicates
from termweave.llm.repeat_groups import repeat_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed=3, n=60):
    """Copies, near copies, shared passages and lines, short, empty, null and very long texts, null sources, Unicode."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Straße", "naïve", "don't", "x", "日本", "<|endoftext|>", "İx"]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = text(40)
    lines = "\n".join(text(9) + "." for _ in range(12))
    texts = []
    for _ in range(n):
        kind = r.randrange(9)
        if kind == 0 and texts:
            texts.append(r.choice(texts))
        elif kind in (1, 2) and texts:
            base = (r.choice(texts) or "a b").split(" ")
            for _ in range(r.randrange(1, 4)):
                base[r.randrange(len(base))] = "edit"
            texts.append(" ".join(base))
        elif kind == 3:
            texts.append(text(r.randrange(5, 60)) + " " + passage + "\t" + text(r.randrange(0, 30)))
        elif kind == 4:
            texts.append(text(20) + "\n" + lines + "\n" + text(20))
        elif kind == 5:
            texts.append(text(r.randrange(0, 7)))
        else:
            texts.append("\n".join(text(r.randrange(1, 25)) + "." for _ in range(r.randrange(1, 9))))
    texts += [None, "", " \t\n", text(6000), "a" * 300, "one", "ONE"]
    return [(i, t, "en", None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 4}", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k=5):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts):
    sets = {d: shingles(t) for d, t in texts}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_near_duplicates_equal_brute_force(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == brute_components([(r[0], r[1]) for r in rows])


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr("termweave.llm.ngram_join.BLOCK", 8)
    monkeypatch.setattr("termweave.llm.ngram_join.LONG_LIST", 6)
    r = random.Random(1)
    base = [f"t{r.randrange(50)}" for _ in range(60)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(r.randrange(0, 4)):
            t[r.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(t)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_linked_pairs_equal_brute_force():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 62, 40).astype(np.uint64)) for _ in range(4)]
    sets += [np.unique(np.concatenate((s[: len(s) - k], r.integers(0, 1 << 62, k).astype(np.uint64)))) for s in sets for k in range(8)]
    want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert sorted(linked(sets, 80)) == want
    side = np.arange(len(sets)) % 2
    assert sorted(tuple(sorted(p)) for p in linked(sets, 80, side)) == [(i, j) for i, j in want if side[i] != side[j]]


def test_a_full_frequency_table_still_tells_frequent_shingles():
    table = np.random.default_rng(1).poisson(350, 1 << 16).astype(np.int64)  # as at 6 GB
    table[:50] += 150  # counters with a shingle of 150 texts
    grades = ngram_join.graded(table)
    assert (grades[:50] > 0).all() and (grades[50:] > 0).mean() < 0.001
    assert not ngram_join.graded(np.zeros(8, np.int64)).any()


def test_a_long_list_of_unrelated_texts_brings_no_blocks_together():
    """100 classes in as many blocks share one shingle, 98 of them at the end of their prefix; only the last two may be similar."""
    at = np.arange(100, dtype=np.int64)
    place = np.where(at < 98, 199, 0).astype(np.int32)
    rows = {"token": at * 0, "key": at, "n": (at * 0 + 1000).astype(np.int32), "place": place, "block": at, "hub": at}
    out = list(ngram_join._meetings(80)(iter([pa.record_batch({c: pa.array(x) for c, x in rows.items()})])))
    assert {(r["kind"], r["a"], r["b"], r["key"]) for b in out for r in b.to_pylist()} == {(0, 98, 99, 98), (0, 98, 99, 99)}


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = dict(map(tuple, components(e).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_repeats(rows):
    seen, out = set(), {}
    for d, text in sorted(rows):
        b = (text or "").encode()
        mine = [b[i : i + 50] for i in range(len(b) - 49)]
        gone = np.zeros(len(b), bool)
        for i, w in enumerate(mine):
            if w in seen:
                gone[i : i + 50] = True
        seen |= set(mine)
        out[d] = (len(b), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeats_equal_brute_force(docs, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(docs).collect()}
    assert got == brute_repeats([(r[0], r[1]) for r in rows])


def test_repeats_of_one_doc_id_with_several_texts(spark):
    r = random.Random(12)
    a, b = ("".join(r.choice("abcdefgh ") for _ in range(120)) for _ in range(2))
    rows = [(1, a), (2, b), (2, a + "zz"), (3, b + "qq"), (3, b + "qq"), (None, a), (4, None)]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 120, 0), (1, 120, 0), (2, 120, 0), (2, 122, 120), (3, 122, 120), (3, 122, 120), (4, 0, 0)]


def test_groups_hold_every_occurrence_of_a_repeat(spark):
    r = random.Random(13)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared, whole = text(70), text(90)
    rows = [(1, text(30) + shared + text(40)), (2, shared + text(20)), (3, text(10) + shared), (4, whole), (5, whole), (6, text(200))]
    texts = dict(rows)
    found = [tuple(x) for x in repeat_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    by: dict = {}
    for name, n, d, s in found:
        by.setdefault(name, []).append((d, texts[d][s : s + n]))
    assert all(len({t for _, t in x}) == 1 and len(x) > 1 for x in by.values())
    covered = {(d, s + i) for _, n, d, s in found for i in range(n)}
    want = {(d, texts[d].index(p) + i) for p, ds in ((shared, (1, 2, 3)), (whole, (4, 5))) for d in ds for i in range(len(p))}
    assert covered >= want and not any(d == 6 for d, _ in covered)


def test_maximal_repeats_have_all_occurrences():
    pieces = [b"x" + b"abcdefghij" * 6, b"y" + b"abcdefghij" * 6, b"abcdefghij" * 6 + b"z"]
    found = list(repeats.maximal_repeats(pieces, np.zeros(3, int)))
    assert max(n for n, *_ in found) == 60
    assert any(n == 60 and sorted(o.tolist()) == [0, 1, 2] for n, o, _ in found)


def test_media_round_trip(docs, rows):
    got = {r["doc_id"]: r for r in media.media_digests(docs).collect()}
    for d, text, *_ in rows:
        b = (text or "").encode()
        p = media.payload_of(b)
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert len(p) % 576 == 0 and r["media_sha256"] == hashlib.sha256(media.to_png(p)).hexdigest() and r["feature"] == media.feature(p)


def test_media_ranges_and_retries(tmp_path):
    uri = f"file://{tmp_path}/a.zip"
    w = media.ArchiveWriter(uri)
    for i in range(9):
        w.add(f"{i}".encode(), bytes([i]) * 100)
    w.close()
    import zipfile

    assert len(zipfile.ZipFile(tmp_path / "a.zip").namelist()) == 9
    reader = media.MediaReader({"path": f"file://{tmp_path}", "range_bytes": 300})
    parts = reader.partitions()
    assert len(parts) > 2
    names = [n for p in parts for b in reader.read(p) for n in b["name"].to_pylist()]
    assert names == [str(i) for i in range(9)]
    for wanted in (1, 2):
        fewer = media.MediaReader({"path": f"file://{tmp_path}", "range_bytes": 300, "partitions": wanted}).partitions()
        assert len(fewer) <= 2 * wanted and len(fewer) < len(parts)
        assert [n for p in fewer for b in reader.read(p) for n in b["name"].to_pylist()] == names
    many = [(f"u{k}", np.arange(0, 10 * (k % 5 + 1), 10)) for k in range(100)]
    dealt = media.MediaReader({"path": "", "partitions": 7})._dealt(many)
    assert len(dealt) <= 14 and sum(b - a for p in dealt for _, a, b in p.ranges) == sum(int(c[-1]) for _, c in many)
    real, fails = reader._member, [2]

    class Flaky:
        def __init__(self, f):
            self.f = f

        def read_at(self, n, at):
            if fails[0]:
                fails[0] -= 1
                raise OSError("lost")
            return self.f.read_at(n, at)

    fs, path = media.opened(uri)
    assert real(Flaky(fs.open_input_file(path)), lambda: fs.open_input_file(path), 0)[1] == "0"
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[50] ^= 1
    (tmp_path / "a.zip").write_bytes(raw)
    with pytest.raises(OSError):
        list(reader.read(parts[0]))


def test_media_is_planned_from_the_manifest(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(media, "RANGE_BYTES", 300)
    w = media.ArchiveWriter(f"file://{tmp_path}/a.zip")
    for i in range(9):
        w.add(f"{i}".encode(), bytes([i]) * 100)
    w.close()
    assert w.cuts[0] == 0 and len(w.cuts) == 4 and sorted(w.cuts) == w.cuts
    (tmp_path / "manifest").mkdir()
    pq.write_table(pa.table({"uri": [w.uri], "members": [9], "cuts": [w.cuts]}), f"{tmp_path}/manifest/part-0.parquet")
    reader = media.MediaReader({"path": "", "manifest": f"file://{tmp_path}/manifest"})
    monkeypatch.setattr(media, "directory", None)  # no archive is opened for the plan
    parts = reader.partitions()
    assert [(p.start, p.end) for p in parts] == list(zip(w.cuts[:-1], w.cuts[1:]))
    assert [n for p in parts for b in reader.read(p) for n in b["name"].to_pylist()] == [str(i) for i in range(9)]


def library_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.default_tokenizer())
    return {d: t.encode(x or "", add_special_tokens=False).ids for d, x, *_ in rows}


def test_encoder_equals_the_library(rows):
    odd = ["It's  WE'LL don''t", "a b c\x1cd", "Ångström é é", "ΣΑΣ ſ", "x<|endoftext|>y <|startoftext|>", "1234 ١٢ ½", "***'s!!", "x yz ² ª º µ ÿ ſ Ǆ", "日本語テキスト", "\x85q", "a_b-c", "a\x03b", "x\x7fy", "plain\x00", "\x1b[31mred\x1b[0m", "é\x03d", "w" * 300 + "\x00"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + r[0], r[1]) for r in rows]
    want = library_ids(rows)
    e = encode.WordEncoder(encode.default_tokenizer(), words=50)
    for d, t in rows:
        assert np.frombuffer(e.encode([(t or "").encode()])[0], "<u2").tolist() == want[d], t


def test_encoder_on_every_character_below_0250():
    from tokenizers import Tokenizer

    path, r = encode.default_tokenizer(), random.Random(9)
    t = Tokenizer.from_file(path)
    alphabet = [chr(c) for c in range(0x250)] + list("日本Σς\u0327\u0301\u3000\u200d가<|>") + ["<|endoftext|>"]
    texts = ["".join(r.choice(alphabet if r.random() < 0.8 else " \t\n") for _ in range(r.randrange(14))) for _ in range(6000)] + [f"a{chr(c)}b {chr(c)}" for c in range(0x250)]
    for plain in (False, True):
        t.encode_special_tokens = plain
        got = encode.WordEncoder(path, plain, words=500).encode([x.encode() for x in texts])
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_other_tokenizers_get_whole_texts(tmp_path, rows):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    spec = json.load(open(encode.default_tokenizer(), encoding="utf-8"))
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    for path in (str(tmp_path / "other.json"), public_tokenizers.path("byte_bpe_50k.json")):
        e, t = encode.WordEncoder(path), Tokenizer.from_file(path)
        assert e.words is None
        texts = [x or "" for _, x, *_ in rows] + ["a\x03b  c"]
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_files_are_cut_and_read_from_the_middle(spark, docs, rows, tmp_path, monkeypatch):
    w = token_files.Writer(f"file://{tmp_path}/a.tok")
    parts = [np.arange(n, dtype=np.uint32) * 7 % 50000 for n in (3, 5000, 1, 9000, 4096, 2)]
    w.add([4, None, 6, 7, 8, 9], [len(p) for p in parts], np.concatenate(parts))
    w.close()
    with token_files.TokenFile(f"file://{tmp_path}/a.tok") as f:
        assert f.docs[~f.nulls].tolist() == [4, 6, 7, 8, 9] and f.nulls.tolist() == [False, True] + [False] * 4
        assert all(f.document(i).tolist() == p.tolist() for i, p in enumerate(parts))
        assert [sum(map(len, x)) for x in f.parts(3)] == [9000, 4096, 2]


def test_writer_tasks_cut_files_by_size(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "FILE_DOCS", 300)
    batch = pa.record_batch([pa.array([None, *range(999)], pa.int64()), pa.array([f"text {i}" for i in range(1000)])], names=["doc_id", "text"])
    out = [r for b in token_files._write(f"file://{tmp_path}", encode.default_tokenizer(), 1)(iter([batch])) for r in b.to_pylist()]
    assert [(r["seq"], r["docs"], r["nulls"], r["first"]) for r in out] == [(0, 512, True, None), (1, 488, True, None)]
    manifest = pa.record_batch([pa.array([r["uri"] for r in out]), pa.array([0, out[0]["ids"]])], names=["uri", "start"])
    got = [r for b in token_files._read(iter([manifest])) for r in b.to_pylist()]
    assert [r["doc_id"] for r in got] == [None, *range(999)] and all(r["start"] + r["n_tokens"] == s["start"] for r, s in zip(got, got[1:]))


def test_token_files_of_one_doc_id(spark):
    two = [(1, "b c"), (1, "a"), (1, None), (2, "x"), (None, "n"), (None, "m m"), (1, "a")]
    runs = []
    for n in (1, 5):
        out = token_files.read_token_files(token_files.write_token_files(spark.createDataFrame(two, "doc_id long, text string").repartition(n)))
        runs.append(sorted(map(tuple, out.collect()), key=lambda r: r[1]))
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == [None, None, 1, 1, 1, 1, 2]


def test_token_files_round_trip(docs, rows):
    want = library_ids(rows)
    out = token_files.read_token_files(token_files.write_token_files(docs)).collect()
    at = 0
    for r in sorted(out, key=lambda r: r["doc_id"]):
        ids = [*want[r["doc_id"]], 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["last_id"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), 1)
        at += len(ids)


@pytest.mark.parametrize("ids", [[0], [7] * 4096, list(range(4096)), [5, 1 << 31, 3, 2**32 - 1], [1] * 95 + [60000] * 5])
def test_blocks_round_trip(ids):
    x = np.array(ids, np.uint32)
    assert token_files.unpack_block(token_files.pack_block(x)).tolist() == ids


def test_token_counts(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.default_tokenizer())
    t.encode_special_tokens = True
    want = {d: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for d, x, *_ in rows}
    assert dict(map(tuple, token_counts.document_token_counts(docs).collect())) == want
    (tmp_path / "f.bin").write_bytes(np.array([9, 1, 2, 9, 9, 3, 4, 5, 6, 7, 8, 1, 9, 4], "<u2").tobytes())
    files = spark.createDataFrame([(f"file://{tmp_path}/f.bin", 28)], "uri string, bytes long")
    for block in (2, 4, 6, 1 << 20):
        got = token_counts.count_tokens(files, 9, 2, block).orderBy("ordinal").collect()
        assert [(r["start"], r["n_tokens"]) for r in got] == [(0, 1), (1, 3), (4, 1), (5, 8), (13, 1)]


def test_quality_counts_equal_brute_force(docs, rows):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for d, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)} if len(grams) < 3000 else None
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)))
        if hit is not None:
            assert r["n_repeat_words"] == len(hit)
            assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_bad_lines_go_and_clean_text_stays(spark):
    clean = "\n".join(f"Word{i} tells other{i}, then some{i} thing{i}." for i in range(12))
    bad = "Home | News | About | Contact | Login | Help | Shop | More"
    got = quality.quality(spark.createDataFrame([(1, clean), (2, clean + "\n" + bad), (3, "\n".join([bad] * 3 + [f"| a{i} | b{i} | c{i} | d{i} |" for i in range(9)]))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == [True, True, False]
    assert got[0]["cleaned"] == clean and got[1]["cleaned"] == clean


def plain_chunks(texts):
    """Texts without the chunks that an earlier place has: a chunk ends after a line whose rolling hash starts with 0, 1, 2 or 3."""
    seen, out = set(), {}
    for d in sorted(texts):
        lines, before, chunks = (texts[d] or "").split("\n"), "", [[]]
        for i, x in enumerate(lines):
            own = hashlib.md5(x.encode()).hexdigest()
            chunks[-1].append(i)
            if hashlib.md5((before + own).encode()).hexdigest()[0] in "0123":
                chunks.append([])
            before = own
        gone = set()
        for at in chunks:
            body = "\n".join(lines[i] for i in at)
            if len(at) > 1 and WORD.search(body):
                gone |= set(at) if body in seen else set()
                seen.add(body)
        out[d] = None if texts[d] is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("hot", [256, 2])
def test_line_chunks_equal_brute_force(spark, docs, rows, hot, monkeypatch):
    monkeypatch.setattr("termweave.llm.line_dedup.HOT", hot)
    got = {r["doc_id"]: r["cleaned"] for r in line_dedup(docs).collect()}
    want = plain_chunks({r[0]: r[1] for r in rows})
    assert got == want and any(want[r[0]] != r[1] for r in rows)
    block = "\n".join(f"line {i} of it" for i in range(40))
    many = spark.createDataFrame([(i, f"{block}\nown {i}") for i in range(30)], "doc_id long, text string")
    assert {r["doc_id"]: r["cleaned"] for r in line_dedup(many).collect()} == plain_chunks({i: f"{block}\nown {i}" for i in range(30)})


def test_planted_passages_all_go(spark):
    runs = {n: [f"passage {n} line {j} here" for j in range(n)] for n in range(1, 9)}
    rows = [(c * 100 + n, "\n".join([f"own {c} {n} before", *run, f"own {c} {n} after"]), "x", "s", 0) for c in range(3) for n, run in runs.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    for d, text, *_ in rows:
        c, n = divmod(d, 100)
        assert got[d] == (text if c == 0 or n == 1 else f"own {c} {n} before\nown {c} {n} after")


def test_whole_line_dedup_equals_its_sql(spark, docs):
    import duckdb

    from termweave.llm import queries

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    got = queries.op5_line_dedup_whole(spark, "/root/testdata/sf0.001")
    db = duckdb.connect()
    db.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = db.sql(queries.ORACLES["op5_line_dedup_whole"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_mix_meets_targets(docs, rows):
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    total = sum(r["size"] for r in out)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in out}
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6 * total
    for s, (t, z) in targets.items():
        mine = [r for r in out if r["source"] == s]
        assert t <= 2 * z + 1e-9 and abs(sum(r["taken"] for r in mine) - t) <= max(r["size"] for r in mine)
        assert all(r["taken"] <= 2 * r["size"] for r in mine)


def test_mix_takes_documents_by_odds_over_inclusion_odds(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.choice((1, 3, 9, 30, 100, 900))), "a" if i % 4 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = 0
    for seed in (0, 1):
        out = [x.asDict() for x in mixing.mix(docs, seed=seed).collect()]
        for s in ("a", "b"):
            mine = [x for x in out if x["source"] == s]
            target, most = mine[0]["target"], 2.0
            low, high = 0.0, 10.0
            for _ in range(200):  # the factor by bisection
                mid = (low + high) / 2
                low, high = (mid, high) if sum(min(most, mid * x["size"].bit_length()) * x["size"] for x in mine) < target else (low, mid)
            for x in mine:
                e = min(most, low * x["size"].bit_length())
                x["whole"], x["p"] = int(e + 1e-9), e - int(e + 1e-9)
                u = (int(hashlib.md5(f"{seed}:{x['doc_id']}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                x["u"], x["rank"] = u, (u / (1 - u)) / (x["p"] / (1 - x["p"])) if x["p"] > 1e-9 else None
            left, at = target - sum(x["whole"] * x["size"] for x in mine), 0
            for x in sorted((x for x in mine if x["rank"] is not None), key=lambda x: (x["rank"], x["doc_id"])):
                assert x["copies"] == x["whole"] + (at + x["size"] / 2 <= left)
                at += x["size"]
            assert all(x["copies"] == x["whole"] for x in mine if x["rank"] is None)
            assert len({round(x["p"], 6) for x in mine}) > 1
            drawn = [x for x in mine if x["rank"] is not None]
            plain += max((x["u"] for x in drawn if x["copies"] > x["whole"]), default=0) > min((x["u"] for x in drawn if x["copies"] == x["whole"]), default=1)
    assert plain  # an order by the random number alone would take others


def check_bins(placed, sizes, capacity, per_source, clusters, sources):
    used, where, taken = {}, {}, {}
    for r in placed:
        used[r["bin_id"]] = used.get(r["bin_id"], 0) + r["length"]
        where.setdefault(r["bin_id"], []).append(r["doc_id"])
        key = r["bin_id"], sources[r["doc_id"]]
        taken[key] = taken.get(key, 0) + 1
    assert max(taken.values()) <= per_source and per_source in taken.values()
    assert all(n <= capacity for n in used.values())
    assert all(r["residual"] == capacity - used[r["bin_id"]] for r in placed)
    words = {}
    for r in placed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["length"]
    assert words == sizes
    for ids in where.values():
        mine = [clusters[i] for i in ids if sizes[i]]
        assert len(mine) == len(set(mine))


def test_packing_respects_conflicts(docs, rows):
    sizes = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    placed = packing.pack(docs, capacity=128, shard=40).collect()
    check_bins(placed, sizes, 128, 4, {r[0]: (r[1] or "").lower() for r in rows} | {r[0]: r[0] for r in rows if sizes[r[0]] > 128}, {r[0]: r[3] for r in rows})


@pytest.mark.parametrize("seed", range(6))
def test_every_piece_goes_to_the_tightest_bin_that_takes_it(seed, monkeypatch):
    monkeypatch.setattr(packing, "SMALL", 3)
    r = random.Random(seed)
    rows = [(i, r.choice("aaaabc"), r.choice((0, 5, 9, 17, 33, 60, 100, 250)), r.choice((1, 1, 1, 2, 3, *range(10, 60)))) for i in range(300)]
    capacity, per_source, bins = 100, 3, {}
    placed = packing.pack_shard(rows, capacity, per_source)
    for i, _, start, length, b in placed:
        _, source, _, cluster = rows[i]
        copies = sum(x[3] == cluster for x in rows) > 1

        def takes(x, source=source, cluster=cluster, length=length, copies=copies):
            return capacity - x["used"] >= length and x["sources"].count(source) < per_source and not (copies and cluster in x["clusters"])

        fits = [capacity - x["used"] for x in bins.values() if takes(x)]
        if b in bins:
            assert takes(bins[b]) and capacity - bins[b]["used"] == min(fits)
        else:
            assert not fits
        x = bins.setdefault(b, {"used": 0, "sources": [], "clusters": set()})
        x["used"] += length
        x["sources"].append(source)
        x["clusters"].add(cluster)
    assert sum(p[3] for p in placed) == sum(x[2] for x in rows)


def test_one_row_repeated_is_dealt_over_shards(spark):
    rows = spark.createDataFrame([(None, "a b c", "s")] * 300 + [(i, "d e", "s") for i in range(100)], "doc_id long, text string, source string")
    out = packing.pack(rows, shard=50).collect()
    shards = [b["bin_id"] >> 24 for b in out]
    assert len(out) == 400 and len(set(shards)) == 8 and max(map(shards.count, set(shards))) < 100
    whole = packing.pack(rows, shard=None).collect()
    assert len({b["bin_id"] for b in whole if b["doc_id"] is None}) == 300 and {b["bin_id"] >> 24 for b in whole} == {0}


def test_best_fit_takes_the_tightest_compatible_bin():
    rows = [(1, "a", 60, 1), (2, "a", 50, 2), (4, "b", 40, 3), (3, "b", 30, 2)]
    got = {rows[i][0]: b for i, _, _, _, b in packing.pack_shard(rows, 100, 4)}
    assert got[4] == got[1] and got[3] not in (got[2], got[1])


@pytest.mark.parametrize("rule", ["and", "xor"])
def test_toxicity_learns_pairs_of_terms(rule):
    r = np.random.default_rng(2)
    rows = []
    for _ in range(3000):
        noise = set(r.integers(100, 400, 8).tolist())
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append((int(a and b if rule == "and" else a != b), np.array(sorted(noise | ({1} if a else set()) | ({2} if b else set())), np.int32)))
    m = toxicity.fit(rows[:2500])
    got = [m.scores(np.zeros(len(t), int), t.astype(np.int64), 1)[0] >= 0.5 for _, t in rows[2500:]]
    assert np.mean([g == bool(y) for g, (y, _) in zip(got, rows[2500:], strict=True)]) > 0.97


def test_toxicity_score_is_the_sum_over_terms_and_pairs():
    r = np.random.default_rng(4)
    m = toxicity.Model(np.arange(3, 40, 4), -0.4, r.normal(size=10), r.normal(size=(10, toxicity.FACTORS)))
    for _ in range(20):
        terms = np.unique(r.integers(0, 45, 12))
        kept = [int(m.place[t]) for t in terms if m.place[t] >= 0]
        z = m.bias + sum(m.w[k] for k in kept) + sum(float(m.v[a] @ m.v[b]) for i, a in enumerate(kept) for b in kept[i + 1 :])
        assert np.isclose(m.scores(np.zeros(len(terms), int), terms, 1)[0], 1 / (1 + np.exp(-z)))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    out = sorted(out, key=lambda r: -r["score"])
    hits = [i for i, r in enumerate(out) if r["toxic"]]
    assert sum((k + 1) / (i + 1) for k, i in enumerate(hits)) / len(hits) > 0.9
    assert sum(r["predicted"] for r in out if r["toxic"]) > 0.8 * len(hits) and not any(r["predicted"] for r in out if not r["toxic"])


def test_toxicity_scores_every_row(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(40)] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert toxicity.toxicity(docs, labels.limit(0)).count() == docs.count()


OPERATORS = {
    "near_duplicates": near_duplicates,
    "remove_repeats": repeats.remove_repeats,
    "media_digests": media.media_digests,
    "token_files": lambda d: token_files.read_token_files(token_files.write_token_files(d)),
    "token_counts": token_counts.document_token_counts,
    "quality": quality.quality,
    "line_dedup": line_dedup,
    "mix": mixing.mix,
    "toxicity": lambda d: toxicity.toxicity(d, d.select("doc_id", F.lit(1).alias("toxic"))),
}


#: Columns that an operator adds, where it passes others through.
ADDED = {"quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"], "line_dedup": ["doc_id", "cleaned", "n_lines", "n_removed_lines"]}
LONG = "some words here " * 20


def odd_values(name, out):
    """Results for the rows (null, LONG), (null, null), (5, LONG) twice, in any order."""
    by = lambda *c: sorted((tuple(r[x] for x in c) for r in out), key=str)
    n = len(LONG.encode())
    if name == "near_duplicates":
        assert by("doc_id", "n_shingles", "component_id") == sorted([(None, 3, None), (None, 0, None), (5, 3, 5), (5, 3, 5)], key=str)
    elif name == "remove_repeats":
        assert by("doc_id", "n_bytes", "n_removed", "n_spans") == sorted([(None, n, 0, 0), (None, 0, 0, 0), (5, n, 0, 0), (5, n, 0, 0)], key=str)
    elif name == "media_digests":
        assert by("doc_id", "n_bytes", "payload_bytes") == sorted([(None, n, 576), (None, 0, 576), (5, n, 576), (5, n, 576)], key=str)
    elif name == "token_files":
        assert by("doc_id", "start", "n_tokens") == sorted([(None, 0, 1), (None, 1, 61), (5, 62, 61), (5, 123, 61)], key=str)
    elif name == "token_counts":
        assert by("doc_id", "n_tokens") == sorted([(None, 61), (None, 1), (5, 61), (5, 61)], key=str)
    elif name == "quality":
        assert by("doc_id", "n_words", "n_repeat_words", "base_failed", "kept") == sorted([(None, 60, 60, True, False), (None, 0, 0, True, False), (5, 60, 60, True, False), (5, 60, 60, True, False)], key=str)
    elif name == "line_dedup":
        assert by("doc_id", "cleaned", "n_lines", "n_removed_lines") == sorted([(None, LONG, 1, 0), (None, None, 1, 0), (5, LONG, 1, 0), (5, LONG, 1, 0)], key=str)
    elif name == "mix":
        got = by("doc_id", "source", "size", "source_size")
        assert got == sorted([(None, None, 60, 60), (None, "s", 0, 120), (5, "s", 60, 120), (5, "s", 60, 120)], key=str)
    else:
        assert by("doc_id", "held_out") == sorted([(None, None)] * 2 + [(5, zlib.crc32(b"5") % 5 == 0)] * 2, key=str)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables_null_ids_and_clashing_columns(spark, empty, name):
    f = OPERATORS[name]
    assert f(empty).count() == 0
    odd = spark.createDataFrame([(None, LONG, "x", None, 1, 1.0), (None, None, None, "s", 2, 2.0), (5, LONG, "x", "s", 3, 3.0), (5, LONG, "x", "s", 3, 3.0)], "doc_id long, text string, lang string, source string, n int, score double")
    plain = odd.select("doc_id", "text", "source")
    odd = odd.withColumns({"key": F.lit("k"), "size": F.lit(1), "rank": F.lit(2), "spans": F.lit("z"), "label": F.lit(0), "component_id": F.lit("c"), "task": F.lit(1), "kept": F.lit("k"), "cleaned": F.lit(0), "n_lines": F.lit("n"), "bits": F.lit("b"), "rules": F.lit(0), "copies": F.lit("c"), "first": F.lit(1), "hashes": F.lit(0), "part": F.lit("p")})
    out, same = f(odd), f(plain)
    if name in ADDED:
        out, same = out.select(ADDED[name]), same.select(ADDED[name])
    got = sorted(map(tuple, out.collect()), key=str)
    if name != "media_digests":
        assert got == sorted(map(tuple, same.collect()), key=str)
    odd_values(name, out.collect())


def test_packing_of_empty_and_repeated_rows(spark, empty):
    assert packing.pack(empty).count() == 0
    two = spark.createDataFrame([(5, "a b", "s")] * 2 + [(None, None, None)], "doc_id long, text string, source string").withColumns({"shard": F.lit(1), "size": F.lit(9), "cluster": F.lit("q")})
    out = packing.pack(two).collect()
    assert len(out) == 3 and len({r["bin_id"] for r in out if r["doc_id"] == 5}) == 2


def test_packing_apart_of_odd_rows(spark, empty):
    assert packing.pack_apart(empty).count() == 0
    base = " ".join(f"v{i}" for i in range(60))
    rows = [(1, base, "s"), (2, base + " end", "s"), (2, "quite other words", None), (3, "quite other words", "t"), (5, LONG, "s"), (5, LONG, "s"), (None, LONG, None), (None, None, "s"), (6, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = docs.withColumns({c: F.lit("x") for c in ("component_id", "cluster", "_cluster", "size", "shard", "copy", "n", "content", "bin_id", "piece")})
    got, same = (sorted(map(tuple, packing.pack_apart(d).select("doc_id", "piece", "start", "length", "residual").collect()), key=str) for d in (odd, docs))
    assert got == same and len(got) == len(rows)
    assert sorted(x[3] for x in got) == sorted([60, 61, 3, 3, 60, 60, 60, 0, 0])
    bins = [r["bin_id"] for r in packing.pack_apart(odd).collect() if r["doc_id"] in (1, 2, 3)]
    assert len(bins) == 4 and len(set(bins)) == 4  # the texts of doc_id 2 tie 1 and 3 into one cluster
    assert len({r["bin_id"] for r in packing.pack_apart(odd).collect() if r["doc_id"] == 5}) == 2


def test_near_copies_share_no_bin(spark):
    base = [f"word{i}" for i in range(80)]
    texts = [" ".join([*base[:40], f"edit{c}", *base[41:]]) for c in range(6)] + [" ".join(base).replace(" ", "  ", 1), "other text here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.col("doc_id").cast("string"))
    out = packing.pack_apart(docs).collect()
    assert len(out) == 8 and len({r["bin_id"] for r in out if r["doc_id"] < 7}) == 7


def test_pipeline_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.quality_stage(spark, docs, "")
    deduped = corpus_pipeline.line_dedup_stage(spark, kept, "")
    near = corpus_pipeline.near_dup_stage(spark, deduped, "")
    texts = {r["doc_id"]: r["text"] for r in deduped.collect()}
    want = {d for d, (_, c) in brute_components(list(texts.items())).items() if c == d}
    assert {r["doc_id"] for r in near.collect()} == want
    assert near.columns == corpus_pipeline.COLUMNS
    mixed = corpus_pipeline.mixing_stage(spark, near, "")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(near).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {d: c for d, c in copies.items() if c}
    placed = corpus_pipeline.packing_stage(spark, mixed, "").collect()
    words = sum(len(WORD.findall(texts[d] or "")) * c for d, c in counts.items())
    assert sum(r["length"] for r in placed) == words


def plain_quality(text):
    """The lines of a text that pass, or None if the text is rejected."""
    words = WORD.findall(text or "")
    grams: dict = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return None

    def fails(x):
        pipes, marks, n = x.count("|"), sum(c in "#*$%&<>" for c in x), len(x)
        loud = n >= 20 and x.upper() == x and x.lower() != x
        return (pipes >= 3 and pipes * 15 >= n) or (marks >= 3 and marks * 12 >= n) or loud or re.search(quality.BOILERPLATE, x.lower()) or (n >= 300 and not re.search("[.!?,;:]", x))

    kept = [x for x in text.split("\n") if not fails(x)]
    return "\n".join(kept) if 100 * sum(map(len, WORD.findall("\n".join(kept)))) >= 50 * sum(map(len, words)) else None


def plain_line_dedup(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        lines = texts[d].split("\n")
        gone = set()
        for i in range(len(lines) - 1):
            pair = (lines[i], lines[i + 1])
            if WORD.search("\n".join(pair)):
                gone |= {i, i + 1} if pair in seen else set()
                seen.add(pair)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def plain_mix(rows):
    """rows (doc_id, source, size) -> copies by doc_id."""
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, t, n in rows if t == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, total = {}, set(names), 1.5 * sum(size.values())
    while True:
        rest = total - sum(target.values())
        over = {s for s in left if rest * weight[s] / sum(weight[x] for x in left) >= 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= over
    target |= {s: (total - sum(target[x] for x in names if x not in left)) * weight[s] / sum(weight[x] for x in left) for s in left}
    out = {}
    for s in names:
        mine = [(d, n) for d, t, n in rows if t == s]
        low, high = 0.0, 100.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(2.0, mid * max(1, n.bit_length())) * n for _, n in mine) < target[s] else (low, mid)
        ranked, used = [], 0
        for d, n in mine:
            e = min(2.0, low * max(1, n.bit_length()))
            whole, p = int(e + 1e-9), e - int(e + 1e-9)
            out[d], used = whole, used + whole * n
            if p > 1e-9:
                u = (int(hashlib.md5(f"0:{d}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                ranked.append(((u / (1 - u)) / (p / (1 - p)), d, n))
        at = 0
        for _, d, n in sorted(ranked):
            out[d] += at + n / 2 <= target[s] - used
            at += n
    return out


def test_pipeline_run_equals_brute_force(spark, tmp_path):
    rows = made(seed=21, n=160)
    bar = "Home | News | About | Contact | Login | Help"
    rows = [(d, f"{bar}\n{t}" if t and d % 5 == 0 else t, *rest) for d, t, *rest in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    placed = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    texts = {d: plain_quality(t) for d, t, *_ in rows}
    texts = plain_line_dedup({d: t for d, t in texts.items() if t is not None})
    stay = {d for d, (_, c) in brute_components(list(texts.items())).items() if c == d}
    size = {d: len(WORD.findall(texts[d])) for d in stay}
    copies = plain_mix([(r[0], r[3], size[r[0]]) for r in rows if r[0] in stay])
    words: dict = {}
    bins: dict = {}
    for r in placed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["length"]
        bins.setdefault(r["bin_id"], []).append(r)
    assert len(stay) < len(texts) < len(rows) and len(set(copies.values())) > 1
    assert words == {d: c * size[d] for d, c in copies.items() if c}
    source = {r[0]: r[3] for r in rows}
    for here in bins.values():
        assert sum(r["length"] for r in here) == packing.CAPACITY - here[0]["residual"] >= 0
        assert len({r["doc_id"] for r in here}) == len(here)
        assert all([source[r["doc_id"]] for r in here].count(s) <= packing.PER_SOURCE for s in {source[r["doc_id"]] for r in here})


def test_pipeline_stages_on_odd_rows(spark, empty):
    prose = "\n".join(f"Line {i} tells a{i}b about c{i}d, then e{i}f." for i in range(30))
    odd = spark.createDataFrame([(None, prose, "en", None, None), (3, prose + " End.", None, "s", 1), (3, prose + " End.", None, "s", 1), (4, None, "en", "s", 0), (None, "", "en", "s", 0)], SCHEMA)
    odd = odd.withColumns({"size": F.lit("x"), "key": F.lit(1), "copies": F.lit(2), "cleaned": F.lit("c"), "kept": F.lit("k"), "component_id": F.lit(0)})
    want = {"quality_rules": 3, "line_dedup": 5, "ngram_jaccard_join": 5}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        out = stage(spark, odd, "")
        if name in want:
            assert out.count() == want[name], name
        if name != "best_fit_packing":
            assert out.columns == corpus_pipeline.COLUMNS
        else:
            assert out.count() == 5 and len({r["bin_id"] for r in out.collect() if r["doc_id"] == 3}) == 2
