"""Maximal repeats of any length: groups of equal byte strings across documents, each with all its occurrences.

A maximal repeat of 50 bytes or more starts with a 50-byte window whose occurrences do not all follow one byte. These windows come
from the suffix array of pieces (repeats.py) and bring all their occurrences along; there are no more such rows than occurrences of
repeats. From there strings grow in rungs: a row hashes its text at 50, 51, 52, 54, 58, ... bytes, rows with equal hashes are one
class, counted by a plain aggregate. A class whose rows differ in the byte before and in the byte after is a maximal repeat. Where a
class splits between two rungs, its rows are asked again in sixteenths of that step, down to single bytes, so a repeat of a million
bytes takes a few rounds, and strings that no text shares are left at once. No group is held in one task: hot classes are counted
before the shuffle, and only their verdict is joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, written
from .repeats import LENGTH, _keyed, _shared_pieces, _streams, _whole_hashes, maximal_repeats
from .shingle import _BYTE, chunks, mixed, powers

DOUBLINGS = 31  # a text has less than 2**31 bytes
STEPS = 16  # rungs that a step is divided into
RUNG = "w long, doc_id long, key long, start int, a int, h long, fresh boolean, before int, after int, b int, hb long"


def _name(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)


def _diverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by hash -> (w, doc_id, key, start) of the 50-byte windows whose occurrences do not all follow one byte."""
    for rows in _whole_hashes(batches):
        index: dict[tuple[int, bytes], int] = {}
        pieces, lefts, hashes, where = [], [], [], []
        for h, text, start, piece in rows:
            left, piece = (piece[0], piece[1:]) if start else (-1, piece)
            if left < 0 and (left, piece) in index:
                left = -2  # starts of texts differ from each other: two entries of a piece say so
            k = index.setdefault((left, piece), len(pieces))
            if k == len(pieces):
                pieces.append(piece)
                lefts.append(left)
                hashes.append(h)
                where.append([])
            where[k].append((text, start))
        codes = np.unique(np.array(hashes), return_inverse=True)[1]
        found = {}
        for _, owner, place in maximal_repeats(pieces, codes, lefts=np.array(lefts)):
            k, p = int(owner[0]), int(place[0])
            found[pieces[k][p : p + LENGTH]] = owner, place  # the interval of all occurrences comes last
        for window, (owner, place) in found.items():
            out = [(*t, s + p) for k, p in zip(owner.tolist(), place.tolist(), strict=True) for t, s in where[k]]
            if len({t[:2] for t in out}) > 1:
                doc, key, start = zip(*out, strict=True)
                yield pa.record_batch([pa.array([_name(window)] * len(out)), pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int32())], names=["w", "doc_id", "key", "start"])


def _rungs(first: bool):
    """(doc_id, key, text, places[w, start, lo, hi]) -> a row a place and rung from lo on, before hi and within the text: hash of the string,
    the bytes beside it (-1: none), and the next rung with its hash (null beyond the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, places = batch["doc_id"].to_numpy(), batch["key"].to_numpy(), batch["places"]
            at, flat = places.offsets.to_numpy(), places.values
            w, start, lo, hi = (flat.field(c).to_numpy() for c in ("w", "start", "lo", "hi"))
            for row, data, offsets in chunks(batch["text"]):
                for i in range(len(offsets) - 1):
                    raw, mine = data[offsets[i] : offsets[i + 1]], slice(at[row + i], at[row + i + 1])
                    n = len(raw)
                    up, down = powers(n + 1)
                    total = np.zeros(n + 1, np.uint64)
                    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
                    for a in range(mine.start, mine.stop, 20_000):
                        some = slice(a, min(a + 20_000, mine.stop))
                        yield _hashed(raw, total, down, doc[row + i], key[row + i], w[some], start[some].astype(np.int64), lo[some].astype(np.int64), hi[some].astype(np.int64))

    def _hashed(raw, total, down, doc, key, w, start, lo, hi) -> pa.RecordBatch:
        n = len(raw)
        if first:
            sizes = lo[:, None] + np.concatenate(([0], 1 << np.arange(DOUBLINGS)))
        else:
            sizes = np.minimum(lo[:, None] + -(-(hi - lo) // STEPS)[:, None] * np.arange(STEPS + 1), hi[:, None])
        end = start[:, None] + sizes
        inside = end <= n
        h = mixed((total[np.where(inside, end, 0)] - total[start][:, None]) * down[start][:, None])
        use = inside[:, :-1] & (sizes[:, :-1] < hi[:, None])
        r, c = np.nonzero(use)
        s, e = start[r], end[r, c]
        more = inside[r, c + 1]
        columns = [
            pa.array(w[r]),
            pa.array(np.full(len(r), doc)),
            pa.array(np.full(len(r), key)),
            pa.array(s.astype(np.int32)),
            pa.array(sizes[r, c].astype(np.int32)),
            pa.array(h[r, c].view(np.int64)),
            pa.array((c > 0) | first),
            pa.array(np.where(s > 0, raw[s - 1].astype(np.int32), -1).astype(np.int32)),
            pa.array(np.where(e < n, raw[np.minimum(e, n - 1)].astype(np.int32), -1).astype(np.int32)),
            pa.array(np.minimum(sizes[r, c + 1], (1 << 31) - 1).astype(np.int32)),
            pa.array(h[r, c + 1].view(np.int64), mask=~more),
        ]
        return pa.record_batch(columns, names=["w", "doc_id", "key", "start", "a", "h", "fresh", "before", "after", "b", "hb"])

    return run


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) -> the row of the whole text as a repeat."""
    for batch in batches:
        w, h, size = [], [], []
        for _, data, offsets in chunks(batch["text"]):
            for i in range(len(offsets) - 1):
                raw = data[offsets[i] : offsets[i + 1]]
                w.append(_name(raw[:LENGTH].tobytes()))
                h.append(mixed((_BYTE[raw] * powers(len(raw))[0]).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])
                size.append(len(raw))
        yield pa.record_batch([pa.array(w, pa.int64()), pa.array(h, pa.int64()), pa.array(size, pa.int32()), batch["doc_id"], batch["key"], pa.array([0] * len(w), pa.int32())], names=["w", "h", "length", "doc_id", "key", "start"])


def _classed(rungs: DataFrame) -> DataFrame:
    """The rungs in classes that are maximal repeats (found) or split before their next rung (more)."""
    c = rungs.groupBy("w", "a", "h").agg(
        F.count(F.lit(1)).alias("n"),
        *(f(x).alias(f"{x}_{f.__name__}") for x in ("doc_id", "key", "before", "after", "hb") for f in (F.min, F.max)),
        F.min("b").alias("b"),
        F.count("hb").alias("n_hb"),
        F.min("fresh").alias("fresh"),
    )
    differ = lambda x: (F.col(f"{x}_min") < F.col(f"{x}_max")) | (F.col(f"{x}_min") == -1)
    texts = (F.col("doc_id_min") < F.col("doc_id_max")) | (F.col("key_min") < F.col("key_max"))
    split = (F.col("n_hb") < F.col("n")) | (F.col("hb_min") < F.col("hb_max"))
    c = c.where(texts & differ("before")).select("w", "a", "h", (F.col("fresh") & differ("after")).alias("found"), ((F.col("b") - F.col("a") > 1) & split).alias("more")).where("found or more")
    return rungs.join(small_side(c, "repeat-classes"), ["w", "a", "h"]).select("w", "h", "doc_id", "key", "start", "a", "b", "found", "more")


def repeat_groups(docs: DataFrame) -> DataFrame:
    """(repeat, length, doc_id, start): a row an occurrence of every maximal repeat of 50 bytes or more, copies of texts included.

    A maximal repeat is a byte string that at least two different texts hold, and that can be made longer neither to the left nor to
    the right without losing an occurrence (the ends of texts differ from everything); also a whole text that several doc_ids
    have. All its occurrences count, overlapping ones and several in one text too; start is in bytes. repeat is a digest of the bytes, so a
    group of any size is rows and never one value. Rows of one doc_id with different texts count as texts of their own, repeated rows once. Texts in
    which one short string repeats throughout have as many occurrences as the square of that run, if two texts hold it: that is the
    result. Null doc_ids, nulls, texts of less than 50 bytes and empty tables have none. Other columns, of any name, are ignored.
    """
    classes, pieces = _shared_pieces(docs, False)
    classes = classes.select("doc_id", "key", "rep").distinct()
    texts = _keyed(docs).where(F.col("doc_id").isNotNull())  # a repeated row only repeats rows of its classes, which no verdict counts
    state = _streams(pieces).mapInArrow(_diverse, "w long, doc_id long, key long, start int").withColumns({"lo": F.lit(LENGTH), "hi": F.lit((1 << 31) - 1)})
    found, first = None, True
    while True:
        places = state.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("w", "start", "lo", "hi")).alias("places"))
        places = small_side(places, "repeat-places")
        rows = texts.join(places, (F.col("doc_id") == F.col("_doc")) & (F.col("key") == F.col("_key"))).select("doc_id", "key", "text", "places")
        out = written(_classed(written(rows.mapInArrow(_rungs(first), RUNG), "repeat-rungs")), "repeat-found")
        got = out.where("found").select("w", "h", F.col("a").alias("length"), "doc_id", "key", "start")
        found, first = got if found is None else found.unionByName(got), False
        state = out.where("more").select("w", "doc_id", "key", "start", F.col("a").alias("lo"), F.col("b").alias("hi"))
        if state.isEmpty():
            break
    copies = classes.groupBy("rep", "key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("rep").alias("_doc"), F.col("key").alias("_key"))
    whole = texts.join(copies, (F.col("doc_id") == F.col("_doc")) & (F.col("key") == F.col("_key"))).select("doc_id", "key", "text").mapInArrow(_wholes, "w long, h long, length int, doc_id long, key long, start int")
    found = found.unionByName(whole).distinct().withColumnRenamed("doc_id", "rep")
    name = F.concat(*(F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("w", "h")))
    return found.join(classes, ["rep", "key"]).select(name.alias("repeat"), "length", "doc_id", "start")
