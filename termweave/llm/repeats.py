"""Suffix-array dedup: byte strings of 50 or more that recur across documents, all occurrences grouped.

Every 50-byte window belongs to the smallest hash of the 20-byte strings in it, so equal windows meet under one hash wherever
they are; runs of windows with one hash are cut out as pieces of at most 80 bytes. Hashes that one text alone has are dropped
first (tasks report each hash once, so a passage in a third of all documents costs one entry a task). Pieces of a hash come
together in one stream; of equal pieces one is kept with its smallest document. A suffix array of the pieces' windows with common
prefixes is scanned with a stack for the intervals of the common-prefix tree; those whose occurrences differ in the byte to the left
are the maximal repeats, and every occurrence outside the smallest document of a group is covered.

A repeat longer than a piece is covered by several intervals that overlap by 49 bytes; `repeat_groups` puts it together. What is
covered is exact: every 50-byte window lies whole in one piece, equal windows lie in pieces of one hash at places that the suffix
array compares, and two pieces that share a window share an interval. Equal texts are told by two hashes of 124 bits together, of
which one text goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, small_side, written
from .shingle import _BYTE, chunks, mixed, powers

LENGTH = 50
GRAM = 20
RUN = LENGTH - GRAM + 1  # windows of one piece at most; also the grams in a window
WIDE = LENGTH + RUN - 1
RANGES = 64, 1 << 16  # hash ranges that anchors are dealt by: twice the shuffle partitions, within these bounds


def _slide(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def windows(data: np.ndarray) -> np.ndarray:
    """For each 50-byte window of a buffer its smallest gram hash."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    h = mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    return _slide(h, RUN)


def runs_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, one past the last) of maximal runs of equal values, cut to RUN windows."""
    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    last = np.append(first[1:], len(w))
    if (last - first).max(initial=0) <= RUN:
        return first, last
    cut = np.concatenate([np.arange(a, b, RUN) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
    return cut, np.append(cut[1:], len(w)).clip(max=np.repeat(last, -(-(last - first) // RUN)))


def _texts(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, bytes, window hashes) of texts with 50 bytes or more."""
    for row, data, offsets in chunks(column):
        w = windows(data)
        for i in np.flatnonzero(np.diff(offsets) >= LENGTH).tolist():
            a, b = int(offsets[i]), int(offsets[i + 1])
            yield row + i, data[a:b], w[a : b - LENGTH + 1]


def _anchors(ranges: int):
    """Rows a chunk and range: hashes, places in the list of text keys, the list. Hashes that two texts of the chunk share say so."""

    def packed(hashes: list, owners: list, keys: list) -> pa.RecordBatch:
        h, o = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        h, o = h[order], o[order]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        shared = np.repeat(np.diff(np.append(at, len(h))) > 1, np.diff(np.append(at, len(h))))
        lead = np.zeros(len(h), bool)
        lead[at] = True
        cuts = np.searchsorted(h, np.arange(ranges, dtype=np.uint64) << np.uint64(65 - ranges.bit_length()))
        table = np.array(keys, "<i8")
        rows = []
        for r, (a, b) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=True)):
            if b > a:
                x = h[a:b]
                used, place = np.unique(o[a:b], return_inverse=True)
                rows.append((r, (x >> np.uint64(26)).astype("<u4").tobytes(), (x >> np.uint64(10)).astype("<u2").tobytes(), place.astype("<u2").tobytes(), np.packbits(shared[a:b]).tobytes(), np.packbits(lead[a:b]).tobytes(), table[used].tobytes()))
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32()] + [pa.binary()] * 6, strict=True)], names=["range", "high", "low", "owner", "shared", "lead", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, keys, held, seen = [], [], [], 0, set()
        most = min(4_000_000, max(400_000, 16 * ranges))
        for batch in batches:
            names = batch["key"].to_pylist()
            for i, _, w in _texts(batch["text"]):
                key = names[i]
                if key in seen:
                    continue
                seen.add(key)
                u = np.unique(w)
                hashes.append(u)
                owners.append(np.full(len(u), len(keys)))
                keys.append(key)
                held += len(u)
                if held > most or len(keys) > 60_000:
                    yield packed(hashes, owners, keys)
                    hashes, owners, keys, held, seen = [], [], [], 0, set()
        if hashes:
            yield packed(hashes, owners, keys)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, hashes: what a text shares with another, from the rows of whole ranges."""

    def told(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([(np.frombuffer(r["high"], "<u4").astype(np.uint64) << np.uint64(16)) | np.frombuffer(r["low"], "<u2") for r in rows])
        n = [len(r["low"]) // 2 for r in rows]
        tables = [np.frombuffer(r["keys"], "<i8") for r in rows]
        key = np.concatenate([t[np.frombuffer(r["owner"], "<u2")] for t, r in zip(tables, rows, strict=True)])
        shared = np.concatenate([np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=k) for r, k in zip(rows, n, strict=True)]).astype(bool)
        lead = np.concatenate([np.unpackbits(np.frombuffer(r["lead"], np.uint8), count=k) for r, k in zip(rows, n, strict=True)]).astype(bool)
        at = np.flatnonzero(lead)
        order = at[np.lexsort((key[at], h[at]))]
        x, k = h[order], key[order]
        first = np.concatenate(([True], x[1:] != x[:-1]))
        group = np.cumsum(first) - 1
        fresh = first | np.concatenate(([True], k[1:] != k[:-1]))
        many = np.bincount(group, fresh)[group] > 1
        keep = shared
        keep[order[many]] = True
        # the other texts of a chunk that has the hash are marked already
        order = np.lexsort((h[keep], key[keep]))
        x, k = h[keep][order], key[keep][order]
        if len(k):
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            yield pa.record_batch([pa.array(k[at]), pa.array([np.unique(p).astype("<u8").tobytes() for p in np.split(x, at[1:])], pa.binary())], names=["key", "hashes"])

    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["range"] != now:
                yield from told(rows)
                rows = []
            now = r["range"]
            rows.append(r)
    if rows:
        yield from told(rows)


def _cut(batch: pa.RecordBatch, back: int = 0) -> Iterator[tuple[int, tuple[int, int], int, bytes]]:
    """(hash, text, start, piece) of the pieces under shared hashes; a text is (doc_id, key). back: bytes before a piece that go with it."""
    column = batch["hashes"].to_pylist()
    texts = list(zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(), strict=True))
    for i, data, w in _texts(batch["text"]):
        mine = np.sort(np.concatenate([np.frombuffer(x, "<u8") for x in column[i]]))
        low = (w >> np.uint64(10)) & np.uint64((1 << 48) - 1)  # the part of a hash that _anchors keeps
        at = np.searchsorted(mine, low)
        at[at == len(mine)] = 0
        ok = mine[at] == low if len(mine) else np.zeros(len(w), bool)
        first, last = runs_of(w)
        use = ok[first]
        raw, hashes = data.tobytes(), w.view(np.int64)
        for a, b in zip(first[use].tolist(), last[use].tolist(), strict=True):
            yield int(hashes[a]), texts[i], a, raw[max(0, a - back) : b + LENGTH - 1]


def _pieces(collapse: bool = True):
    """Pieces under shared hashes. collapse: of equal pieces in one batch the smallest document's goes on; the others are covered at
    once (kind 1). Else all go on, each with the byte before it unless it starts its text."""
    names = ["kind", "hash", "doc_id", "key", "start", "stop", "piece"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not collapse:
                rows = [(0, h, *text, a, None, piece) for h, text, a, piece in _cut(batch, 1)]
            else:
                spans: list[tuple] = []
                best: dict[bytes, list] = {}
                for h, text, a, piece in _cut(batch):
                    have = best.get(piece)
                    if have is None:
                        best[piece] = [h, [(text, a)]]
                    elif text[0] == have[1][0][0][0]:
                        have[1].append((text, a))
                    elif text[0] < have[1][0][0][0]:
                        spans += [(t, s, s + len(piece)) for t, s in have[1]]
                        have[1] = [(text, a)]
                    else:
                        spans.append((text, a, a + len(piece)))
                rows = [(0, h, *t, s, None, piece) for piece, (h, all_) in best.items() for t, s in all_]
                rows += [(1, 0, *t, s, e, None) for t, s, e in _merged(spans)]
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _merged(spans: list[tuple]) -> list[tuple]:
    out: list[list] = []
    for d, a, b in sorted(spans):
        if out and out[-1][0] == d and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([d, a, b])
    return [tuple(x) for x in out]


def maximal_repeats(pieces: list[bytes], groups: np.ndarray, least: int = LENGTH, lefts: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, piece of each occurrence, place in it) of the maximal repeats of `least` bytes or more within groups of pieces.

    The enhanced suffix array holds the places with `least` bytes before the piece's end. A stack scan over common prefixes yields
    the intervals of the common-prefix tree; one whose occurrences all have the same byte to the left is not maximal and left out.
    lefts: the byte before each piece, negative where none is; without it, bytes before pieces count as different.
    """
    sizes = np.array([len(p) for p in pieces])
    n = np.maximum(sizes - least + 1, 0)
    owner = np.repeat(np.arange(len(pieces)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    wide = int(sizes.max(initial=0) + 7) // 8 * 8
    text = np.zeros((int(sizes.sum()) + wide,), np.uint8)
    text[: int(sizes.sum())] = np.frombuffer(b"".join(pieces), np.uint8)
    base = (np.cumsum(sizes) - sizes)[owner] + place
    left = sizes[owner] - place
    grid = np.lib.stride_tricks.sliding_window_view(text, wide)[base]
    grid = np.where(np.arange(wide) < left[:, None], grid, 0)
    order = np.lexsort([*[grid[:, i : i + 8].copy().view(">u8").ravel().astype(np.uint64) for i in range(wide - 8, -1, -8)], groups[owner]])
    grid, owner, place, left = grid[order], owner[order], place[order], left[order]
    same = grid[1:] == grid[:-1]
    prefix = np.where(same.all(1), wide, np.argmin(same, 1))
    prefix = np.minimum(prefix, np.minimum(left[1:], left[:-1]))
    prefix[groups[owner[1:]] != groups[owner[:-1]]] = 0
    alone = -1 - np.arange(len(owner))
    outer = alone if lefts is None else np.where(lefts[owner] >= 0, lefts[owner], alone)
    before = np.where(place > 0, text[np.maximum((np.cumsum(sizes) - sizes)[owner] + place - 1, 0)].astype(np.int64), outer)
    change = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))  # left bytes differ in [a, b] where this does
    good = np.flatnonzero(prefix >= least)
    if not len(good):
        return
    for part in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1):
        first = int(part[0])
        values = prefix[first : first + len(part)].tolist()
        stack: list[tuple[int, int]] = []
        for k, value in enumerate([*values, 0]):
            low = k
            while stack and stack[-1][0] > value:
                length, low = stack.pop()
                a, b = first + low, first + k
                if change[a] != change[b]:
                    yield length, owner[a : b + 1], place[a : b + 1]
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, low))


def _whole_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (hash, text, start, piece) of some whole hashes at a time, from rows sorted by hash."""
    rows: list[tuple] = []
    for batch in batches:
        rows += [(h, (d, k), s, p) for h, d, k, s, p in zip(*(batch[c].to_pylist() for c in ("hash", "doc_id", "key", "start", "piece")), strict=True)]
        if len(rows) > 20_000 and rows[0][0] != rows[-1][0]:
            cut = next(i for i in range(len(rows) - 1, -1, -1) if rows[i][0] != rows[-1][0]) + 1
            yield rows[:cut]
            rows = rows[cut:]
    if rows:
        yield rows


class _Distinct:
    """The distinct pieces of rows, each with its hash, smallest document and occurrences."""

    def __init__(self, rows: list[tuple]):
        index: dict[bytes, int] = {}
        self.pieces, self.hashes, self.least, self.where = [], [], [], []
        for h, text, start, piece in rows:
            k = index.setdefault(piece, len(self.pieces))
            if k == len(self.pieces):
                self.pieces.append(piece)
                self.hashes.append(h)
                self.least.append(text[0])
                self.where.append([])
            self.least[k] = min(self.least[k], text[0])
            self.where[k].append((text, start))

    def repeats(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """maximal_repeats of the pieces of hashes with several."""
        _, codes, count = np.unique(np.array(self.hashes), return_inverse=True, return_counts=True)
        some = np.flatnonzero(count[codes] > 1)
        if len(some):
            for length, owner, place in maximal_repeats([self.pieces[i] for i in some], codes[some]):
                yield length, some[owner], place


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash -> covered spans (doc_id, key, start, stop)."""
    for rows in _whole_hashes(batches):
        found, spans = _Distinct(rows), []
        for k, all_ in enumerate(found.where):
            if len(all_) > 1:
                spans += [(t, s, s + len(found.pieces[k])) for t, s in all_ if t[0] > found.least[k]]
        low = np.array(found.least)
        for length, owner, place in found.repeats():
            of = low[owner]
            m = of.min()
            for k, p in zip(owner[of > m].tolist(), place[of > m].tolist(), strict=True):
                spans += [(t, s + p, s + p + length) for t, s in found.where[k] if t[0] == found.least[k]]
        if out := [(*t, a, b) for t, a, b in _merged(spans)]:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "key", "start", "stop"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()]
    for batch in batches:
        rows = []
        for doc, text, copy, spans in zip(batch["doc_id"].to_pylist(), batch["text"].fill_null("").cast(pa.binary()).to_pylist(), batch["copy"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            found = [(0, len(text))] if copy else [(a, b) for _, a, b in _merged([(0, x["start"], x["stop"]) for x in spans or []])]
            kept, at = [], 0
            for a, b in found:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rows.append((doc, len(text), sum(b - a for a, b in found), len(found), hashlib.sha256(b"".join(kept)).hexdigest()))
        if rows:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("key"))


def _shared_pieces(docs: DataFrame, collapse: bool) -> tuple[DataFrame, DataFrame]:
    """(classes: doc_id, key, rep of the texts with 50 bytes or more, rep being the smallest doc_id with an equal text; pieces)."""
    spark = docs.sparkSession
    arrow_limits(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = _keyed(docs).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    # of two texts with one key, each counts as the other's copy only if the second hash is equal too
    keyed = written(docs.select("doc_id", "key", F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("low")).distinct(), "text-keys")
    first = written(keyed.groupBy("key", "low").agg(F.min("doc_id").alias("rep")), "text-classes")
    ranges = min(RANGES[1], max(RANGES[0], 1 << (2 * parts - 1).bit_length()))
    anchors = docs.select("key", "text").mapInArrow(_anchors(ranges), "range int, high binary, low binary, owner binary, shared binary, lead binary, keys binary")
    shared = anchors.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_shared, "key long, hashes binary")
    shared = shared.groupBy("key").agg(F.collect_list("hashes").alias("hashes"))
    wanted = small_side(shared.join(first, "key").select(F.col("rep").alias("_rep"), F.col("key").alias("_key"), "hashes"), "shared-hashes")
    rows = docs.join(wanted, (docs["doc_id"] == F.col("_rep")) & (docs["key"] == F.col("_key"))).select("doc_id", "key", "text", "hashes")
    pieces = written(rows.mapInArrow(_pieces(collapse), "kind int, hash long, doc_id long, key long, start int, stop int, piece binary"), "pieces")
    return keyed.join(first, ["key", "low"]).select("doc_id", "key", "rep"), pieces


def _streams(pieces: DataFrame) -> DataFrame:
    parts = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pieces.where("kind = 0").select("hash", "doc_id", "key", "start", "piece").repartition(parts, "hash").sortWithinPartitions("hash")


def repeat_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies: doc_id and key of texts that a smaller doc_id has; spans: doc_id, key, spans[start, stop] of the others)."""
    classes, pieces = _shared_pieces(docs, True)
    later = _streams(pieces).mapInArrow(_covered, "doc_id long, key long, start int, stop int")
    spans = pieces.where("kind = 1").select("doc_id", "key", "start", "stop").union(later)
    spans = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return classes.where("doc_id > rep").select("doc_id", "key").distinct(), spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): bytes in 50-byte strings that also start in a smaller doc_id are removed.

    Null and empty texts, and texts of less than 50 bytes, lose nothing. Equal texts: all but the smallest doc_id's are removed
    whole. Rows of one doc_id take nothing from each other, equal or not; each is judged by its own text against smaller doc_ids. A
    null doc_id neither removes nor loses anything. Texts of any length are judged whole. Empty tables: no rows. Other columns, of any
    name, are ignored.
    """
    copies, spans = repeat_spans(docs)
    gone = copies.withColumn("copy", F.lit(True)).join(spans, ["doc_id", "key"], "full").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "copy", "spans")
    gone = small_side(gone, "spans")
    rows = _keyed(docs)
    rows = rows.join(gone, (rows["doc_id"] == F.col("_id")) & (rows["key"] == F.col("_key")), "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")
    return rows.mapInArrow(_digested, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
