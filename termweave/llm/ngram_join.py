"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

Documents with the same shingle set form a class; only classes are joined. A fixed-size table of shingle frequencies (its size
does not depend on the input) orders shingles from rare to frequent, so that a class is indexed under the rarest fifth of its
shingles. Posting lists are read in shingle order as a stream; a class's label is the smallest class that it shares a list with.

Links are found in two steps. First each class is compared with one other alone, the smallest of a list that passes the filters,
which joins the bulk of a group of near copies, however large, at one comparison a class. Classes joined so have one hub. Then only pairs with different hubs count: classes are
dealt into blocks of bounded size by label, and pairs of blocks in which some such pair passes the length and positional filters
meet. Inside a block pair the prefix join runs again with exact local frequencies, then the suffix filter, then one verification.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, stored_bytes
from .common import arrow_limits, small_side, written
from .components import components
from .shingle import counted_sets, shingle_sets

SLICES, SLICE_BITS = 256, 14  # 2**22 counters
BLOCK = 256  # classes of a block, on average at most
SIGN_BITS, MOST = 8, 255  # a class's shingles by the first bits of their hashes; a full count is taken as any number
_RANGES = np.arange(64, dtype=np.uint64) << np.uint64(58)
SUMS = 8  # tasks that add up counters; the driver adds up theirs
PAIRS = 1 << 20  # candidate pairs that are looked at together
LONG_LIST = 1024  # a posting list with more classes lets its blocks meet without looking at each pair


def _ceil(a: np.ndarray, percent: int) -> np.ndarray:
    return (a * percent + 99) // 100


def _overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets with a and b elements that reaches the similarity."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def graded(table: np.ndarray) -> np.ndarray:
    """Grades of counters, from rare to frequent: 0 within what the rare shingles that share a counter make of it, then two grades for
    each doubling of what is beyond them. That background grows with the input and is taken off first: measured against it, a shingle of
    250 texts would count as rare at 6 GB, and its list of unrelated texts would be compared."""
    usual = table.mean()
    beyond = (table - usual) / (4 * np.sqrt(usual) + 1)
    return np.clip(np.floor(1 + 2 * np.log2(np.maximum(0.5, beyond))), 0, 120).astype(np.int8)


def _profile(k: int, beside: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(SLICES << SLICE_BITS, np.uint32)
        for batch in batches:
            n, keys, signs, size = [], [], [], []
            for n_words, s in counted_sets(batch["text"], k):
                size.append(n_words)
                n.append(len(s))
                signs.append(np.minimum(np.bincount((s >> np.uint64(64 - SIGN_BITS)).astype(np.int64), minlength=1 << SIGN_BITS), MOST).astype("u1").tobytes())
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=8).digest())
                np.add.at(counters, (s >> np.uint64(64 - 8 - SLICE_BITS)).astype(np.int64), np.uint32(1))
            yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(np.frombuffer(b"".join(keys), np.int64)), pa.nulls(len(n), pa.int32()), pa.array(signs, pa.binary()), pa.array(size, pa.int64()), *[batch[c] for c in beside]], names=["doc_id", "n", "key", "slice", "counts", "n_words", *beside])
            types = [batch.schema.field(c).type for c in beside]
        parts = counters.reshape(SLICES, -1)
        used = [i for i in range(SLICES) if parts[i].any()]
        if used:
            z = len(used)
            yield pa.record_batch([pa.nulls(z, pa.int64()), pa.nulls(z, pa.int64()), pa.nulls(z, pa.int64()), pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary()), pa.nulls(z, pa.int64()), *[pa.nulls(z, t) for t in types]], names=["doc_id", "n", "key", "slice", "counts", "n_words", *beside])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64)
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["slice", "counts"])


def _postings(k: int, percent: int, grades):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade = grades.value
        for batch in batches:
            tokens, keys, sizes, places, seen = [], [], [], [], set()
            for s in shingle_sets(batch["text"], k):
                n = len(s)
                if not n or (key := hashlib.blake2b(s.tobytes(), digest_size=8).digest()) in seen:
                    continue
                seen.add(key)
                g = grade[(s >> np.uint64(64 - 8 - SLICE_BITS)).astype(np.int64)]
                m = n - int(_ceil(n, percent)) + 1
                if g.any():
                    s = s[np.argsort(g, kind="stable")]  # s is sorted: frequency first, then hash
                tokens.append(s[:m])
                keys.append(np.full(m, np.frombuffer(key, np.int64)[0]))
                sizes.append(np.full(m, n, np.int32))
                places.append(np.arange(m, dtype=np.int32))
            if tokens:
                yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["token", "key", "n", "place"])

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Rows sorted by token -> runs of whole posting lists of two classes or more, by token, key and n, repeated rows removed, with the
    start of each list."""
    rest: dict[str, np.ndarray] | None = None
    for batch, last in _with_last(batches):
        now = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names} if batch is not None else None
        if rest is not None:
            now = {c: np.concatenate((rest[c], now[c])) for c in rest} if now is not None else rest
        if now is None or not len(now["token"]):
            continue
        t = now["token"]
        end = len(t) if last else int(np.searchsorted(t, t[-1], "left"))
        rest = {c: x[end:] for c, x in now.items()}
        if not end:
            continue
        new = np.concatenate(([True], t[1:end] != t[: end - 1], [True]))
        several = np.flatnonzero(~(new[:-1] & new[1:]))  # most shingles are of one text alone; only the rest are sorted
        if not len(several):
            continue
        now = {c: x[several] for c, x in now.items()}
        order = np.lexsort((now["n"], now["key"], now["token"]))
        now = {c: x[order] for c, x in now.items()}
        keep = np.ones(len(order), bool)
        keep[1:] = (now["token"][1:] != now["token"][:-1]) | (now["key"][1:] != now["key"][:-1]) | (now["n"][1:] != now["n"][:-1])
        now = {c: x[keep] for c, x in now.items()}
        t = now["token"]
        yield now, np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))


def _with_last(items):
    before, any_ = None, False
    for x in items:
        if any_:
            yield before, False
        before, any_ = x, True
    if any_:
        yield before, True


def _shared(percent: int):
    """Postings of lists with two classes or more; low: the smallest class of the list; near: the same, or the class itself where the
    length and positional filters tell it from the smallest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, at in _lists(batches):
            sizes = np.diff(np.append(at, len(now["token"])))
            keep = np.repeat(sizes > 1, sizes)
            if not keep.any():
                continue
            first = np.repeat(at, sizes)[keep]
            n, place = now["n"].astype(np.int64), now["place"].astype(np.int64)
            x, y = n[keep], n[first]
            ok = (np.minimum(x, y) >= _ceil(np.maximum(x, y), percent)) & (np.minimum(x - place[keep], y - place[first]) >= _overlap(x, y, percent))
            out = {c: v[keep] for c, v in now.items()}
            out |= {"low": now["key"][first], "near": np.where(ok, now["key"][first], out["key"])}
            yield pa.record_batch({c: pa.array(v) for c, v in out.items()})

    return run


def _pairs_of(at: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within lists of one size that start at `at`, some lists at a time."""
    i, j = np.triu_indices(size, 1)
    step = max(1, PAIRS // len(i))
    for k in range(0, len(at), step):
        some = at[k : k + step, None]
        yield (some + i).ravel(), (some + j).ravel()


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    keep = np.zeros(len(order), bool)
    keep[:1] = True
    for c in columns:
        keep[1:] |= c[1:] != c[:-1]
    return [c[keep] for c in columns]


def _meetings(percent: int):
    """kind 0: class (key, n) of blocks a and b (a <= b) is in a pair across hubs that passes the filters; kind 1: it is in a long
    list; kind 2: blocks a and b are in one long list, and one of them has a class that is not of the list's largest hub."""
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())

    def told(kept: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = _distinct(*[np.concatenate([k[i] for k in kept]).astype(np.int64) for i in range(5)])
        return pa.record_batch([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names=["kind", "a", "b", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for now, at in _lists(batches):
            key, n, place, block, hub = now["key"], now["n"].astype(np.int64), now["place"].astype(np.int64), now["block"], now["hub"]
            sizes = np.diff(np.append(at, len(key)))
            mixed_ = np.minimum.reduceat(hub, at) != np.maximum.reduceat(hub, at)
            at, sizes = at[mixed_], sizes[mixed_]
            for z in np.unique(sizes[sizes <= LONG_LIST]).tolist():
                for i, j in _pairs_of(at[sizes == z], z):
                    ok = (hub[i] != hub[j]) & (np.minimum(n[i], n[j]) >= _ceil(np.maximum(n[i], n[j]), percent))
                    i, j = i[ok], j[ok]
                    ok = np.minimum(n[i] - place[i], n[j] - place[j]) >= _overlap(n[i], n[j], percent)
                    i, j = i[ok], j[ok]
                    p, q = np.minimum(block[i], block[j]), np.maximum(block[i], block[j])
                    zero = np.zeros(2 * len(i), np.int64)
                    kept.append([zero, np.append(p, p), np.append(q, q), np.append(key[i], key[j]), np.append(n[i], n[j])])
                    if sum(len(x[0]) for x in kept) > PAIRS:
                        yield told(kept)
                        kept = []
            for a, z in zip(at[sizes > LONG_LIST].tolist(), sizes[sizes > LONG_LIST].tolist(), strict=True):
                x = slice(a, a + z)
                hubs, which, count = np.unique(hub[x], return_inverse=True, return_counts=True)
                one, zero = np.ones(z, np.int64), np.zeros(z, np.int64)
                kept.append([one, zero, zero, key[x], n[x]])
                blocks = np.unique(block[x])
                for other in np.unique(block[x][which != count.argmax()]):
                    zero = np.zeros(len(blocks), np.int64)
                    kept.append([zero + 2, np.minimum(blocks, other), np.maximum(blocks, other), zero, zero])
            if sum(len(k[0]) for k in kept) > PAIRS:
                yield told(kept)
                kept = []
        if kept:
            yield told(kept)

    return run


def _plausible_star(percent: int):
    """Suffix filter of classes against one: rows sorted by task and side, one row of side 0 a task -> the plausible rows of side 1
    and that one. The sum of the smaller counts by hash range bounds an intersection from above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if head is None else pa.concat_tables([head, rows])
            task, side, who, n = (rows[c].to_numpy() for c in ("task", "side", "class_id", "n"))
            bins = np.frombuffer(b"".join(rows["sign"].to_pylist()), "u1").reshape(len(task), -1).astype(np.int32)
            bins[bins == MOST] = 1 << 20
            lead = np.maximum.accumulate(np.where(side == 0, np.arange(len(side)), 0))
            head = rows.slice(int(lead[-1]), 1)
            i = np.flatnonzero((side == 1) & (task[lead] == task) & (side[lead] == 0))
            j = lead[i]
            n = n.astype(np.int64)
            ok = np.minimum(bins[i], bins[j]).sum(1) >= _overlap(n[i], n[j], percent)
            i, j = i[ok], np.unique(j[ok])
            if len(i):
                x = np.concatenate((i, j))
                yield pa.record_batch([pa.array(task[x]), pa.array(side[x]), pa.array(who[x])], names=["task", "side", "class_id"])

    return run


def _plausible(percent: int):
    """Suffix filter: rows sorted by task -> those with a partner of another hub in the task (across its sides, if it has two) whose
    sizes, and whose counts by hash range, allow the similarity."""

    def kept(rows: list[tuple]) -> list[int]:
        n = np.array([r[3] for r in rows], np.int64)
        side = np.array([r[1] for r in rows], np.int8)
        hub = np.array([r[5] for r in rows], np.int64)
        bins = np.stack([np.frombuffer(r[4], "u1") for r in rows]).astype(np.int32)
        bins[bins == MOST] = 1 << 20
        out = np.zeros(len(rows), bool)
        order = np.argsort(n, kind="stable")
        for at, i in enumerate(order[:-1].tolist()):
            j = order[at + 1 :]
            j = j[: np.searchsorted(n[j], n[i] * 100 // percent, "right")]
            j = j[hub[j] != hub[i]]
            if side.any():
                j = j[side[j] != side[i]]
            if len(j):
                ok = np.minimum(bins[i], bins[j]).sum(1) >= _overlap(n[i], n[j], percent)
                if ok.any():
                    out[i] = True
                    out[j[ok]] = True
        return np.flatnonzero(out).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[tuple] = []
        for batch, last in _with_last(batches):
            out: list[tuple] = []
            for r in zip(*(batch[c].to_pylist() for c in ("task", "side", "class_id", "n", "sign", "hub")), strict=True):
                if now and r[0] != now[-1][0]:
                    out += [now[i][:3] for i in kept(now)]
                    now = []
                now.append(r)
            if last and now:
                out += [now[i][:3] for i in kept(now)]
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["task", "side", "class_id"])

    return run


def linked(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs of sets (sorted, distinct hashes) whose Jaccard similarity reaches percent; exact. side: only pairs across."""
    z = len(sets)
    side = np.zeros(z, np.int8) if side is None else side
    across = bool(side.any())
    n = np.array([len(s) for s in sets])
    if z <= 8:  # a few sets: length and suffix filters, then the intersection
        out = []
        for i in range(z):
            for j in range(i + 1, z):
                x, y = int(n[i]), int(n[j])
                if across and side[i] == side[j] or 100 * min(x, y) < percent * max(x, y) or not x:
                    continue
                need = (percent * (x + y) + 99 + percent) // (100 + percent)
                a, b = sets[i], sets[j]
                if int(np.minimum(np.diff(np.searchsorted(a, _RANGES), append=x), np.diff(np.searchsorted(b, _RANGES), append=y)).sum()) < need:
                    continue
                at = np.searchsorted(a, b)
                at[at == x] = 0
                if int((a[at] == b).sum()) >= need:
                    out.append((i, j))
        return out
    owner = np.repeat(np.arange(z), n)
    _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((word, count[word], owner))  # rare first in each set
    word = word[order]
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    first = (place <= n[owner] - _ceil(n[owner], percent)) & (count[word] > 1)
    w, d, p = word[first], owner[first], place[first]
    order = np.lexsort((side[d], w))
    w, d, p = w[order], d[order], p[order]
    at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, int)
    found = [np.zeros(0, np.int64)]
    for a, b in zip(at.tolist(), np.append(at[1:], len(w)).tolist(), strict=False):
        if b - a > 1:
            if across:
                c = a + int(np.searchsorted(side[d[a:b]], 1))
                i, j = np.repeat(np.arange(a, c), b - c), np.tile(np.arange(c, b), c - a)
            else:
                i, j = np.triu_indices(b - a, 1)
                i, j = i + a, j + a
            x, y = n[d[i]], n[d[j]]
            ok = (np.minimum(x, y) >= _ceil(np.maximum(x, y), percent)) & (np.minimum(x - p[i], y - p[j]) >= _overlap(x, y, percent))
            found.append(d[i[ok]] * z + d[j[ok]])
            if len(found) > 64:
                found = [np.unique(np.concatenate(found))]
    pairs = np.unique(np.concatenate(found))
    # suffix filter: both sets fall into the same 64 ranges of hashes; the sum of the smaller counts bounds the intersection
    bins = np.zeros((z, 64), np.int32)
    np.add.at(bins, (np.repeat(np.arange(z), n), (np.concatenate(sets) >> np.uint64(58)).astype(np.int64)), 1)
    common = count > 1
    column = np.cumsum(common) - 1
    width = int(common.sum()) // 64 + 1
    bits = np.zeros((z, width), np.uint64)
    shown = common[word]
    c = column[word[shown]]
    np.bitwise_or.at(bits, (owner[shown], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
    out = []
    step = max(1, (4 << 20) // (8 * width + 256))
    for k in range(0, len(pairs), step):
        i, j = pairs[k : k + step] // z, pairs[k : k + step] % z
        need = _overlap(n[i], n[j], percent)
        ok = np.minimum(bins[i], bins[j]).sum(1) >= need
        i, j, need = i[ok], j[ok], need[ok]
        same = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
        out += zip(i[same >= need].tolist(), j[same >= need].tolist(), strict=True)
    return out


def _verified(k: int, percent: int, star: bool = False):
    """Rows sorted by task -> a spanning forest of the links of each task; star: each link, as (class of side 0, class of side 1)."""

    def forest(keys, sets, sides):
        parent = list(range(len(sets)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in linked(sets, percent, np.array(sides, np.int8)):
            if star:
                yield (keys[a], keys[b]) if sides[b] else (keys[b], keys[a])
                continue
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield keys[a], keys[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets, sides = None, [], [], []
        for batch in batches:
            out = []
            for t, side, key, found in zip(*(batch[c].to_pylist() for c in ("task", "side", "doc_id")), shingle_sets(batch["text"], k), strict=True):
                if t != now:
                    out += forest(keys, sets, sides) if len(keys) > 1 else []
                    now, keys, sets, sides = t, [], [], []
                keys.append(key)
                sets.append(found)
                sides.append(side)
            if out:
                yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["u", "v"])
        if len(keys) > 1 and (out := list(forest(keys, sets, sides))):
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["u", "v"])

    return run


def _links(docs: DataFrame, signs: DataFrame, tasks: DataFrame, k: int, percent: int, star: bool) -> DataFrame:
    """(u, v): links of class_ids found in tasks (task, side, class_id, n, hub); texts go only to tasks that pass the suffix filter."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tasks = tasks.join(signs, "class_id").select("task", "side", "class_id", "n", "sign", "hub").repartition(parts, "task").sortWithinPartitions("task", "side")
    tasks = tasks.mapInArrow((_plausible_star if star else _plausible)(percent), "task long, side int, class_id long")
    wanted = tasks.groupBy("class_id").agg(F.collect_set(F.struct("task", "side")).alias("tasks"))
    texts = docs.join(small_side(wanted, "wanted"), docs["doc_id"] == F.col("class_id")).select(F.inline("tasks"), "doc_id", "text")
    links = texts.repartition(parts, "task").sortWithinPartitions("task", "side", "doc_id").mapInArrow(_verified(k, percent, star), "u long, v long")
    return written(links, "links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, beside: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each row of docs (doc_id, text; other columns, of any name, are ignored).
    beside: columns of docs that stay in the result, together with n_words, so that texts need not be read again.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of distinct k-word shingles (A-Z lower-cased;
    fewer than k words: the whole sequence). component_id: the smallest doc_id reachable; class_id: the smallest with the same set.
    Null and empty texts have an empty set and link with nothing. A null doc_id stays as a row and links with nothing. A long text is
    one set like any other; ties do not arise, all links count. Repeated rows are kept; rows of one doc_id with
    different texts each follow their own text. An empty table gives an empty result. Shingles are compared by 64-bit hashes, sets by a 64-bit hash and size.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    beside = list(beside)
    carried = ["n_words", *beside] if beside else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *beside)
    shape = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in beside)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    profile = written(docs.mapInArrow(_profile(k, beside), "doc_id long, n long, key long, slice int, counts binary, n_words long" + shape), "profile")
    docs = docs.select("doc_id", "text")
    rows = profile.where("slice is null").select("doc_id", "n", "key", *carried)
    counts = profile.where("slice is not null").select("slice", "counts").coalesce(SUMS).mapInArrow(_summed, "slice int, counts binary")
    table = np.zeros((SLICES, 1 << SLICE_BITS), np.int64)
    for r in counts.collect():  # SUMS times 33.5 MB before they are compressed, whatever the input: the counters are of a fixed number
        table[r["slice"]] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    grades = spark.sparkContext.broadcast(graded(table.ravel()))

    classes = written(rows.where("n > 0 and doc_id is not null").groupBy("key", "n").agg(F.min("doc_id").alias("class_id")), "classes")
    listed = "token long, key long, n int, place int"
    postings = docs.where("doc_id is not null").mapInArrow(_postings(k, percent, grades), listed)
    shared = written(postings.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(_shared(percent), listed + ", low long, near long"), "postings")
    label = written(shared.groupBy("key", "n").agg(F.min("low").alias("label"), F.min("near").alias("near")), "labels")
    cuts = label.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("cuts"))
    block = label.join(cuts, "label").join(classes, ["key", "n"]).select("key", "n", "class_id", "near", F.xxhash64("label", F.pmod(F.xxhash64("key", "n"), "cuts")).alias("block"))
    block = written(block, "blocks")
    signs = profile.where("slice is null").select(F.col("doc_id").alias("class_id"), "key", "n", F.col("counts").alias("sign"))
    signs = signs.groupBy("class_id", "key", "n").agg(F.first("sign").alias("sign")).join(block.select("class_id", "key", "n"), ["class_id", "key", "n"], "left_semi")
    signs = written(signs.select("class_id", "sign"), "signs")

    rep = classes.select(F.col("key").alias("near"), F.col("n").alias("rep_n"), F.col("class_id").alias("rep"))
    star = block.where("key <> near").join(rep, "near").where(f"100 * least(n, rep_n) >= {percent} * greatest(n, rep_n)")
    star = written(star.select("near", "class_id", "n", "rep", "rep_n"), "stars")
    parted = star.groupBy("near").agg(F.ceil(F.count("*") / BLOCK).alias("cuts"))
    star = star.join(parted, "near").withColumn("task", F.xxhash64("near", F.pmod(F.xxhash64("class_id"), "cuts")))
    tasks = star.select("task", F.lit(1).alias("side"), "class_id", "n", F.col("class_id").alias("hub"))
    tasks = tasks.unionByName(star.select("task", F.lit(0).alias("side"), F.col("rep").alias("class_id"), F.col("rep_n").alias("n"), F.col("rep").alias("hub")).distinct())
    first = _links(docs, signs, tasks, k, percent, True)
    hubs = first.groupBy(F.col("v").alias("class_id")).agg(F.min("u").alias("hub"))
    few = stored_bytes(spark, first._termweave_path) <= BROADCAST_BYTES
    for _ in range(2):  # a hub's own hub, and that one's
        up = hubs.select(F.col("class_id").alias("_c"), F.col("hub").alias("_h"))
        hubs = hubs.join(F.broadcast(up) if few else up, F.col("hub") == F.col("_c"), "left").select("class_id", F.coalesce("_h", "hub").alias("hub"))
    block = block.join(written(hubs, "hubs"), "class_id", "left").select("key", "n", "class_id", "block", F.coalesce("hub", "class_id").alias("hub"))
    block = written(block, "hubbed")

    met = shared.join(block.select("key", "n", "block", "hub"), ["key", "n"]).repartition(parts, "token").sortWithinPartitions("token")
    met = written(met.select("token", "key", "n", "place", "block", "hub").mapInArrow(_meetings(percent), "kind int, a long, b long, key long, n int"), "meetings")
    some = met.where("kind = 0").select("a", "b", "key", "n").distinct().join(block, ["key", "n"]).select("a", "b", "class_id", "n", "hub", (F.col("block") != F.col("a")).cast("int").alias("side"))
    whole = met.where("kind = 2").select("a", "b").distinct().select("a", "b", F.posexplode(F.array_distinct(F.array("a", "b"))).alias("side", "block"))
    whole = whole.join(block.join(met.where("kind = 1").select("key", "n").distinct(), ["key", "n"]), "block").select("a", "b", "class_id", "n", "hub", "side")
    tasks = some.union(whole).distinct().select(F.xxhash64("a", "b").alias("task"), "side", "class_id", "n", "hub")
    second = _links(docs, signs, small_side(tasks, "tasks"), k, percent, False)

    roots = components(first.union(second)).select(F.col("node").alias("class_id"), F.col("root").alias("component_id"))
    classes = classes.join(roots, "class_id", "left").select("key", "n", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    out = rows.join(classes, ["key", "n"], "left")
    return out.select("doc_id", *carried, F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
