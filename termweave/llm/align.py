"""Cross-tokenizer alignment: where two tokenizers cut a text alike, and how often their ids overlap over the corpus."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, spread, written

#: Segments of at most so many characters are kept from text to text, and about so many of them (250 bytes each), in each worker.
LONG_SEGMENT, SEGMENTS = 64, 500_000
#: Segments that are worked on at once, which bounds what a worker holds besides: a long text is taken in such pieces.
AT_ONCE = 50_000
#: Pairs that are broadcast at most, 17 bytes each: the most frequent ones.
HOT_PAIRS = 1 << 20
#: Labels of a byte: an A token ends here, a B token does, both do.
A_END, B_END, BOTH = b"a"[0], b"b"[0], b"c"[0]
_SPAN = re.compile(rb"[^c]*c")
#: No token of either tokenizer lies across these places: before a space or line break that follows other than white space, and
#: between a Latin letter and an ASCII digit or sign. A segment ends at the first such place; most are a word or signs.
_LETTERS, _SIGNS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]", "[!-@\\[-`{-~]"
_SEGMENT = re.compile(
    rf"[ \n]?(?:{_LETTERS}++(?=[ \n]|{_SIGNS}|\Z)|{_SIGNS}++(?=[ \n]|\Z))"
    rf"|.+?(?:(?<=\S)(?=[ \n])|(?<={_LETTERS})(?={_SIGNS})|\Z)",
    re.DOTALL,
)
#: The byte-level alphabet: printable bytes stand for themselves, the others, in order, for the characters from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARS = {chr(b): b for b in _SELF} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_SELF)))}
_open: dict[tuple[str, str], Aligner] = {}


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Token groups of texts under a byte-level tokenizer A and a piece tokenizer B, each distinct segment aligned once."""

    def __init__(self, a_path: str, b_path: str, segments: int = SEGMENTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        vocabulary = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(map(_CHARS.__getitem__, vocabulary.get(i, ""))) for i in range(max(vocabulary) + 1)]
        self.b = SentencePieceProcessor(model_file=b_path)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.vocab_size())]
        self.guard = self.b.encode("\n")
        self.cut = self._cut_is_safe(a_path)
        self.most, self.kept, self.older, self.long = segments // 2, {}, {}, []

    def _cut_is_safe(self, a_path: str) -> bool:
        """A's words are runs of one class after white space at most; no piece of B holds a line break, a space after something else,
        or a sign after a letter."""
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        words = spec.get("pre_tokenizer") or {}
        plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and spec.get("normalizer") is None
        odd = re.compile(f"\n|[^▁]▁|{_LETTERS}{_SIGNS}")
        own = (self.b.id_to_piece(i) for i in range(self.b.vocab_size()) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i))
        return plain and len(self.guard) == 2 and not any(map(odd.search, own))

    @classmethod
    def get(cls, a_path: str, b_path: str) -> Aligner:
        """One for each worker process, kept from task to task."""
        if (a_path, b_path) not in _open:
            _open[a_path, b_path] = cls(a_path, b_path)
        return _open[a_path, b_path]

    def _b_ids(self, segments: list[str]) -> list[list[int]]:
        """B begins every text with a space of its own: it stands for a segment's first one, or goes before a line break that is put in
        front, which nothing is joined to."""
        found = self.b.encode([s[1:] if s[0] == " " else f"\n{s}" for s in segments], num_threads=1)
        out = []
        for s, ids in zip(segments, found, strict=True):
            if s[0] != " ":
                if ids[:2] != self.guard:
                    raise ValueError("the piece tokenizer joins a line break to something")
                ids = ids[2:]
            out.append(self.guard[:1] if s == " " else ids)
        return out

    def _groups(self, data: bytes, a_ids: list[int], b_ids: list[int]) -> tuple | None:
        """(n_a, text of the groups, linked pairs) of a segment; None if a side does not give its bytes back."""
        a, b = list(map(self.a_bytes.__getitem__, a_ids)), list(map(self.b_bytes.__getitem__, b_ids))
        if b"".join(a) != data or b"".join(b) != data:
            return None
        labels, at = bytearray(b"." * len(data)), -1
        for n in map(len, a):
            at += n
            labels[at] = A_END
        at = -1
        for n in map(len, b):
            at += n
            labels[at] = BOTH if labels[at] == A_END else B_END
        i, j, groups, pairs = 0, 0, [], []
        for s in _SPAN.findall(labels.translate(None, b".")):
            m, n = i + s.count(b"a") + 1, j + s.count(b"b") + 1
            groups.append(f"{','.join(map(str, a_ids[i:m]))}|{','.join(map(str, b_ids[j:n]))}" if len(s) > 1 else f"{a_ids[i]}|{b_ids[j]}")
            for mark in s:  # a token meets the other side's next one when one of them ends
                pairs.append(a_ids[i] << 32 | b_ids[j])
                i += mark != B_END
                j += mark != A_END
        return len(a), ";".join(groups).encode(), array("q", pairs).tobytes()

    def _look(self, segments: Iterable[str]) -> dict:
        """What _groups gives, by segment. Kept segments age in two halves: what the newer half asks of the older one moves over; long
        ones stay until the next call."""
        for s in self.long:
            self.kept.pop(s, None)
        if len(self.kept) > self.most:
            self.older, self.kept = self.kept, {}
        known, older, missing = self.kept, self.older, []
        for s in set(segments).difference(known):
            if s in older:
                known[s] = older[s]
            else:
                missing.append(s)
        if missing:
            a_ids = [e.ids for e in self.a.encode_batch_fast(missing, add_special_tokens=False)]
            for s, x, y in zip(missing, a_ids, self._b_ids(missing), strict=True):
                known[s] = self._groups(s.encode(), x, y)
        self.long = [s for s in missing if len(s) > LONG_SEGMENT]
        return known

    def align(self, texts: list[str], with_groups: bool = False) -> list[tuple | None]:
        """For each text, which is not empty: n_a, n_b, n_groups, n_links, digest of the groups, linked pairs (an array, repeats
        included), and the groups if asked for. None where a byte is lost."""
        cut = [_SEGMENT.findall(f" {t}") if self.cut else [f" {t}"] for t in texts]
        out, i = [], 0
        while i < len(cut):
            j, size = i + 1, len(cut[i])
            while j < len(cut) and size + len(cut[j]) <= AT_ONCE:
                size += len(cut[j])
                j += 1
            look = self._look(chain.from_iterable(cut[i:j])) if size <= AT_ONCE else None
            for segments in cut[i:j]:
                out.append(self._summed(segments, look, with_groups))
            i = j
        return out

    def _summed(self, segments: list[str], look: dict | None, with_groups: bool) -> tuple | None:
        n_a, n_groups, digest, pairs, groups = 0, 0, hashlib.sha256(), [], []
        for at in range(0, len(segments), AT_ONCE):
            piece = segments[at : at + AT_ONCE]
            got = list(map((look or self._look(piece)).__getitem__, piece))
            if None in got:
                return None
            counts, texts, links = zip(*got, strict=True)
            text = b";".join(texts)
            n_a, n_groups = n_a + sum(counts), n_groups + text.count(b"|")
            digest.update(b";" + text if at else text)
            pairs.append(np.frombuffer(b"".join(links), np.int64))
            if with_groups:
                groups.append(text)
        links = np.concatenate(pairs)
        # in a group each end of a token but the last makes one link more
        return n_a, len(links) + n_groups - n_a, n_groups, len(links), digest.hexdigest(), links, b";".join(groups).decode()


_SHAPE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False) -> DataFrame:
    """A row a document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, its linked pairs (A id * 2^32 + B id, distinct) and how
    often it has each; with_groups adds the groups themselves as text, `a1,a2|b1;a3|b2,b3`.

    Text by text: each byte is labelled with the tokens that end there, and a pattern over the labels takes spans up to each byte where
    both end. Texts are cut where neither tokenizer can join anything, and a distinct segment is encoded and labelled once; a worker
    keeps about SEGMENTS short ones. A null or empty text, or one whose bytes a tokenizer does not give back, has no tokens: zeros,
    no pairs, ''. Texts of any length are read whole. Other columns are ignored, repeated rows get equal rows, an empty table none.
    """
    arrow_limits(docs.sparkSession)
    default = None if a_path and b_path else default_tokenizers()
    paths = a_path or default[0], b_path or default[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner.get(*paths)
            texts = batch["text"].to_pylist()
            at = [i for i, t in enumerate(texts) if t]
            found = dict(zip(at, aligner.align([texts[i] for i in at], with_groups), strict=True))
            rows = []
            for i in range(len(texts)):
                *counts, digest, pairs, groups = found.get(i) or (0, 0, 0, 0, "", np.zeros(0, np.int64), "")
                pairs, times = np.unique(pairs, return_counts=True)
                rows.append((*counts, digest, pairs, times.astype(np.int32), groups))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            data = [batch["doc_id"].cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols[:7], kinds, strict=True)]]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
            yield pa.record_batch(data + ([pa.array(cols[7], pa.string())] if with_groups else []), names=names + (["groups"] if with_groups else []))

    return spread(docs).select("doc_id", "text").mapInArrow(run, _SHAPE + (", groups string" if with_groups else ""))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): how many of the documents of links() hold a linked pair, and whether no pair of its A id is in more."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    return counts.withColumn("a", F.shiftright("pair", 32)).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document; see links for odd rows.

    Texts are read once; what is written of them are the distinct pairs of each document. Pairs are counted by partial sums. The
    hot_pairs most frequent ones, all in most corpora, go to every task, so that no frequent pair is a hot key and a document's sums
    are made where its pairs are; rarer ones are joined by shuffle. Each row of docs counts as a document, repeated ones too.
    """
    rows = written(links(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(rows), "counts")
    n = counts.count()
    least = 0
    if n > hot_pairs:
        least = counts.agg(F.percentile_approx("n", 1 - hot_pairs / n, 10000)).first()[0]
        while counts.where(F.col("n") > least).count() > hot_pairs:
            least *= 2
    each = rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    met = each.join(F.broadcast(counts.where(F.col("n") > least)), "pair", "left")  # at most hot_pairs rows
    if least:
        rare = met.where("n is null").select("row", "pair", "times").join(counts.where(F.col("n") <= least), "pair")
        met = met.where("n is not null").unionByName(rare)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
