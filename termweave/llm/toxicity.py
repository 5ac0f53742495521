"""Toxicity by a factorization machine over hashed terms: weights of terms and of pairs of terms, learnt from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, small_side
from .shingle import chunks, words

BITS = 20
FACTORS = 8
#: Labelled rows, and bytes of their texts, that the model is fitted on, on average at most; rows are taken by the hash of doc_id.
FIT_ROWS, FIT_BYTES = 20_000, 64 << 20
#: A longer text is scored like any other but not learnt from, so that what reaches the driver is bounded.
FIT_LONGEST = 256 << 10
#: Least chi-square of a term that tells alone: beyond what chance gives the best of a million terms.
SURE = 30.0
#: Least gain (twice a log-likelihood ratio) of a pair of terms over either of its terms: beyond the best of ten million pairs by chance.
SURE_PAIR = 45.0
#: Pairs are counted of terms in so many fitted rows or more; a rarer pair cannot reach SURE_PAIR. Of the most frequent ones at most.
COMMON, PAIR_TERMS = 10, 4096


def _terms(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, hashed term) pairs of chunks of texts, distinct in each text. Letters count, not case or punctuation."""
    for row, data, offsets in chunks(column):
        cleaned = _CLEAN[data]
        h, at = words(cleaned, offsets)
        owner = np.repeat(np.arange(row, row + len(offsets) - 1), np.diff(at))
        code = np.unique(owner.astype(np.int64) << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64))
        yield code >> BITS, code & ((1 << BITS) - 1)


_CLEAN = np.full(256, 0x20, np.uint8)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _CLEAN[list(_r)] = list(_r)


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [np.zeros(0, np.int32)] * batch.num_rows
        for owner, term in _terms(batch["text"]):
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for o, t in zip(owner[np.append(0, cuts)] if len(owner) else [], np.split(term, cuts), strict=False):
                terms[int(o)] = t.astype(np.int32)
        yield pa.record_batch([batch["label"], pa.array([t.tobytes() for t in terms], pa.binary())], names=["label", "terms"])


class Model:
    """score = sigmoid(bias + sum of w + pairwise products of v), over the kept terms of a text."""

    def __init__(self, terms: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[terms] = np.arange(len(terms))
        self.terms, self.bias, self.w, self.v = terms, bias, w, v

    def scores(self, owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        place = self.place[term]
        owner, place = owner[place >= 0], place[place >= 0]
        z = np.full(n, self.bias) + np.bincount(owner, self.w[place], n)
        for f in range(self.v.shape[1]):
            x = self.v[place, f]
            z += 0.5 * (np.bincount(owner, x, n) ** 2 - np.bincount(owner, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gain(n: np.ndarray, k: np.ndarray, rate: np.ndarray | float) -> np.ndarray:
    """Twice the log-likelihood ratio of k of n at rate k / n against a given rate."""
    own = np.clip(k / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    rate = np.clip(rate, 1e-6, 1 - 1e-6)
    return 2 * (k * np.log(own / rate) + (n - k) * np.log((1 - own) / (1 - rate)))


def telling_pairs(owner: np.ndarray, term: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Terms of pairs that tell together what neither of them tells alone, such as two harmless words that insult side by side.

    All pairs of common terms are counted in all rows; a pair stays if its rate of label 1 differs for sure from the rate of either
    term's rows. Its terms need not tell anything by themselves.
    """
    names, place, count = np.unique(term, return_inverse=True, return_counts=True)
    often = np.argsort(-count, kind="stable")[:PAIR_TERMS]
    often = np.sort(often[count[often] >= COMMON])
    names, column = names[often], np.full(len(names), -1)
    column[often] = np.arange(len(often))
    place = column[place]
    owner, place = owner[place >= 0], place[place >= 0]
    z = len(names)
    rate = np.bincount(place, y[owner], z) / np.maximum(np.bincount(place, minlength=z), 1)
    at = np.searchsorted(owner, np.arange(0, len(y) + 1024, 1024))
    out = np.zeros(z, bool)
    for low in range(0, z, 512):  # 512 terms against all, so that memory holds a strip of the pairs
        some = slice(low, min(low + 512, z))
        both, yes = (np.zeros((some.stop - low, z), np.float32) for _ in range(2))
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            x = np.zeros((min(1024, len(y) - 1024 * i), z), np.float32)
            x[owner[a:b] - 1024 * i, place[a:b]] = 1
            both += x[:, some].T @ x
            x = x[y[1024 * i : 1024 * (i + 1)] == 1]
            yes += x[:, some].T @ x
        for i in range(low, some.stop):
            n, k = both[i - low].astype(float), yes[i - low].astype(float)
            sure = (_gain(n, k, rate[i]) > SURE_PAIR) & (_gain(n, k, rate) > SURE_PAIR) & (n > 0)
            sure[i] = False
            if sure.any():
                out[i] = True
                out |= sure
    return names[out]


def fit(rows: list[tuple[int, np.ndarray]], epochs: int = 40, seed: int = 7) -> Model:
    """Adagrad over mini-batches; rows are (label, distinct hashed terms). With one label or none only a bias is learnt.

    The model keeps the terms that tell alone and the terms of pairs that tell together; chance terms and pairs are left out, which
    on a few thousand rows would outnumber and drown them. The rarer label weighs more, by the root of the ratio.
    """
    rng = np.random.default_rng(seed)
    y = np.array([r[0] for r in rows], float)
    p = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    term = np.concatenate([r[1] for r in rows])
    yes = np.bincount(term, y[owner], 1 << BITS)
    all_ = np.bincount(term, minlength=1 << BITS).astype(float)
    expected = all_ * y.mean()
    chi = np.where(all_ >= 5, (yes - expected) ** 2 / np.maximum(expected * (1 - y.mean()), 1e-9), 0)
    kept = np.union1d(np.flatnonzero(chi > SURE), telling_pairs(owner, term, y)).astype(np.int64)
    model = Model(kept, bias, np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), FACTORS)))
    place = model.place[term]
    owner, place = owner[place >= 0], place[place >= 0]
    at = np.searchsorted(owner, np.arange(len(rows) + 1))
    weight = np.where(y == (y.mean() < 0.5), np.sqrt(max(y.mean(), 1 - y.mean()) / min(y.mean(), 1 - y.mean())), 1.0)
    gw, gv, gb = np.full(len(kept), 1e-6), np.full(model.v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 256):
            batch = order[i : i + 256]
            sizes = at[batch + 1] - at[batch]
            o = np.repeat(np.arange(len(batch)), sizes)
            x = place[np.repeat(at[batch] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            v = model.v[x]
            total = np.zeros((len(batch), FACTORS))
            square = np.zeros(len(batch))
            np.add.at(total, o, v)
            np.add.at(square, o, (v * v).sum(1))
            z = model.bias + np.bincount(o, model.w[x], len(batch)) + 0.5 * ((total**2).sum(1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weight[batch] / len(batch)
            dw = np.bincount(x, g[o], len(kept)) + 1e-5 * model.w
            dv = np.zeros_like(model.v)
            np.add.at(dv, x, g[o][:, None] * (total[o] - v))
            dv += 1e-4 * model.v
            gw += dw * dw
            gv += dv * dv
            gb += g.sum() ** 2
            model.w -= 0.1 * dw / np.sqrt(gw)
            model.v -= 0.02 * dv / np.sqrt(gv)
            model.bias -= 0.05 * g.sum() / np.sqrt(gb)
    return model


def learnt(docs: DataFrame, known: DataFrame, most: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Model:
    """A model from docs (doc_id, text) and known (doc_id, label), without nulls in doc_id and label.

    Sizes are counted without moving texts; then the labels of the sample, whose number is bounded, go to the texts. Only hashes of
    distinct terms reach the driver, four bytes each, of FIT_BYTES of text on average at most.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    sizes = docs.select("doc_id", size.alias("size")).where(F.col("doc_id").isNotNull() & (F.col("size") <= FIT_LONGEST))
    n, total = sizes.join(known, "doc_id").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = min(1.0, most / max(n, 1), most_bytes / max(total, 1))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)
    rows = docs.select("doc_id", "text").where(drawn & (size <= FIT_LONGEST)).join(small_side(known.where(drawn), "fit-labels"), "doc_id")
    got = rows.select("label", "text").mapInArrow(_featurised, "label int, terms binary").collect()
    got = sorted((r["label"], bytes(r["terms"])) for r in got)
    return fit([(a, np.frombuffer(b, np.int32)) for a, b in got])


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            score = np.full(batch.num_rows, 1 / (1 + np.exp(-m.bias)))
            for owner, term in _terms(batch["text"]):
                if len(owner):
                    low, high = int(owner[0]), int(owner[-1]) + 1
                    score[low:high] = m.scores(owner - low, term, high - low)
            yield pa.record_batch([*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text, however long; null and empty texts score the bias. Equal texts, and so repeated rows and
    ties, score the same; a null doc_id stays null; an empty table gives no row; other columns, of any name, are ignored."""
    arrow_limits(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**20 places and the kept terms of the bounded fit, whatever the input
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(held), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels whose crc32(doc_id) mod 5 is 0 are never learnt from.

    A null doc_id is held out by no label and has held_out null. A doc_id with several labels counts as toxic if one says so; repeated
    rows of a labelled doc_id are learnt from each. Without labels, or with one class, every score is the base rate. See score for
    empty and long texts, ties, empty tables and other columns.
    """
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).where(~held)
    out = score(docs, learnt(docs, known))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
