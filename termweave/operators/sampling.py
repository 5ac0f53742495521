"""Training pairs: capped positives, blacklist-aware negatives, interleaving, seeded draws."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded_order
from ..runtime import BROADCAST_BYTES, small_side, stored_bytes, written
from .mapping import named_pairs
from .ranges import numbered, parts, running


def positives(targets: DataFrame, names: DataFrame, bridge: DataFrame, most: int = 10, label: int = 1, seed: int | None = None) -> DataFrame:
    """At most `most` names a target: the first by name_id, or a seeded draw. Names or targets that are missing are skipped."""
    rows = named_pairs(bridge.select("concept_id", "name_id").distinct(), targets.select("concept_id", F.col("concept_name").alias("sentence1")), names.select("name_id", F.col("name").alias("sentence2")))
    order = [F.col("name_id")] if seed is None else [seeded_order(seed, "concept_id", "name_id"), F.col("name_id")]
    w = Window.partitionBy("concept_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("sentence1", "sentence2", "concept_id", "name_id", F.lit(label).alias("label"), "rank")


def _prime(n: int) -> int:
    """The smallest prime that is n or more."""
    n = max(n, 2)
    while any(n % q == 0 for q in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def _strides() -> list[int]:
    """Sixteen primes above any number of candidates: each is coprime to every number that it strides over."""
    out = [1 << 33]
    while len(out) <= 16:
        out.append(_prime(out[-1] + 1))
    return out[1:]


STRIDES = _strides()


def _drawn(seed: int, key: str, what: str, below: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(what))), 1, 12), 16, 10).cast("long"), below)


def numbered_positives(targets: DataFrame, names: DataFrame, bridge: DataFrame) -> DataFrame:
    """All positives with pos_idx, 1..n by concept and name; written.

    Concepts are put in order, not pairs: a pair's number is its rank in its concept after all pairs of the concepts before, so sentences
    are never sorted by range."""
    rows = written(positives(targets, names, bridge, most=1 << 30), "positives")
    n = parts(bridge.sparkSession, rows.count())
    starts = running(rows.groupBy("concept_id").agg(F.count("*").alias("_own")), ["concept_id"], _upto="_own")
    rows = rows.repartition(n, "concept_id").join(starts.select("concept_id", (F.col("_upto") - F.col("_own")).alias("_start")), "concept_id")
    return written(rows.withColumn("pos_idx", F.col("_start") + F.col("rank")).drop("_start"), "numbered")


#: Blacklisted candidates of a concept, at most, that go with its keys as an array.
LISTED = 1 << 10


def free_draws(wanted: DataFrame, key: str, candidates: DataFrame, blacklist: DataFrame, most: int, seed: int = 42, beside: Sequence[str] = ()) -> DataFrame:
    """(key, concept_id, candidate_id, sentence2, seq): for each row of wanted (key, concept_id) `most` candidates off the blacklist,
    or all there are if fewer. beside: further columns of wanted that go with its draws.

    The f candidates that a concept's blacklist leaves are numbered 0..f-1 without being listed, and a key takes the numbers that it
    meets from a drawn start by a drawn stride, modulo f, which visits each once. So a key makes exactly the rows that it keeps, however
    dense its blacklist is. Number j is place j + t, where t counts the blacklisted places b, the i-th of their concept, with
    b - i <= j. Up to LISTED of these gaps go with a concept's keys as an ordered array in which t is searched by halves, so draws are
    neither written nor shuffled for it. The gaps of a concept with more, and the numbers asked for, are sorted together by range, and t
    is a running sum: no concept is a hot key there, whatever it blacklists or how many keys it has; equal numbers of a concept are asked
    for once. Keys and numbers are dealt over partitions of RANGE_ROWS rows on average at most before they are joined.
    """
    spark = wanted.sparkSession
    places = small_side(numbered(candidates.select("candidate_id", "sentence2").distinct(), ["candidate_id"], "_n").select((F.col("_n") - 1).alias("_spot"), "candidate_id", "sentence2"), "places")
    n = places.count()
    black = blacklist.where("concept_id is not null").select("concept_id", "candidate_id").distinct()
    barred = written(black.join(places.select("candidate_id", "_spot"), "candidate_id").select("concept_id", "_spot"), "barred")
    barred = barred.repartition(parts(spark, barred.count()), "concept_id")
    taken = written(barred.groupBy("concept_id").agg(F.count("*").alias("_taken")), "taken")
    few = F.col("_taken") <= LISTED
    lists = barred.join(taken.where(few), "concept_id").groupBy("concept_id").agg(F.sort_array(F.collect_list("_spot")).alias("_b"))
    lists = lists.select("concept_id", F.transform("_b", lambda b, i: b - i).alias("_gaps"))

    def drawn(keys: DataFrame) -> DataFrame:
        keys = keys.withColumn("_free", n - F.coalesce("_taken", F.lit(0))).where("_free > 0")
        stride = F.element_at(F.array(*map(F.lit, STRIDES)), (_drawn(seed, key, "step", F.lit(len(STRIDES))) + 1).cast("int"))
        keys = keys.withColumns({"_a": _drawn(seed, key, "start", F.col("_free")), "_b": stride}).withColumn("seq", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(most), F.col("_free")))))
        return keys.withColumn("_j", F.pmod(F.col("_a") + (F.col("seq") - 1) * F.col("_b"), F.col("_free"))).drop("_a", "_b", "_free", "_taken")

    rows = wanted.select(key, "concept_id", *beside)
    many = taken.where(~few)
    hot = not many.isEmpty()
    n_keys = rows.count()
    listed = (rows.join(many.select("concept_id"), "concept_id", "left_anti") if hot else rows).repartition(parts(spark, n_keys), "concept_id").join(lists, "concept_id", "left")
    before = F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(LISTED.bit_length()))]), F.lit(0), lambda t, step: F.when(F.get("_gaps", t + step - 1) <= F.col("_j"), t + step).otherwise(t))
    out = drawn(listed.withColumn("_taken", F.when(F.col("_gaps").isNotNull(), F.size("_gaps")))).withColumn("_spot", F.col("_j") + F.when(F.col("_gaps").isNull(), 0).otherwise(before))
    columns = [key, "concept_id", *beside, "seq", "_spot"]
    out = out.select(columns)
    if hot:
        ordered = numbered(barred.join(many, "concept_id").select("concept_id", "_spot"), ["concept_id", "_spot"], "_n")
        first = ordered.groupBy("concept_id").agg(F.count("*").alias("_taken"), F.min("_n").alias("_first"))
        gaps = ordered.join(first.drop("_taken"), "concept_id").select("concept_id", (F.col("_spot") - (F.col("_n") - F.col("_first"))).alias("_j"), F.lit(None).cast("long").alias("_first"), F.lit(1).alias("_gap"))
        draws = written(drawn(rows.join(first, "concept_id")), "draws")
        draws = draws.repartition(parts(spark, draws.count()), "concept_id", "_j")
        asked = draws.select("concept_id", "_j", "_first").distinct().withColumn("_gap", F.lit(0))
        found = running(gaps.unionByName(asked), ["concept_id", "_j", F.desc("_gap")], _before="_gap").where("_gap = 0")
        found = found.select("concept_id", "_j", (F.col("_j") + F.col("_before") - (F.col("_first") - 1)).alias("_spot"))
        out = out.unionByName(draws.join(found, ["concept_id", "_j"]).select(columns))
    if stored_bytes(spark, places._termweave_path) > BROADCAST_BYTES:
        out = out.repartition(parts(spark, most * n_keys), "_spot")
    return out.join(places, "_spot").select(key, "concept_id", *beside, "candidate_id", "sentence2", "seq")


def negatives(targets: DataFrame, names: DataFrame, blacklist: DataFrame, most: int = 10, seed: int = 42) -> DataFrame:
    """At most `most` names a target, drawn by seed, none of them blacklisted; fewer only if there are no more."""
    candidates = names.select(F.col("name_id").alias("candidate_id"), F.col("name").alias("sentence2"))
    black = blacklist.select("concept_id", F.col("name_id").alias("candidate_id"))
    named = targets.select("concept_id", F.col("concept_name").alias("sentence1"))
    rows = free_draws(named.select("concept_id", F.col("concept_id").alias("_key")), "_key", candidates, black, most, seed)
    return rows.join(named, "concept_id").select("sentence1", "sentence2", "concept_id", F.col("candidate_id").alias("name_id"), F.lit(0).alias("label"), F.col("seq").alias("rank"))


def blacklist_pairs(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(from_id, to_id): known pairs and every id with itself."""
    return pairs.select("from_id", "to_id").unionByName(ids.select(F.col("concept_id").alias("from_id"), F.col("concept_id").alias("to_id"))).distinct()


def interleaved(positive: DataFrame, candidates: DataFrame, blacklist: DataFrame, false_positive: DataFrame, n_neg: int = 4, n_fp: int | None = None, seed: int = 42) -> DataFrame:
    """For each positive itself, n_neg negatives, then its concept's false positives once, after the concept's first positive.

    positive: pos_idx, concept_id, sentence1, sentence2; candidates: candidate_id, sentence2; blacklist: concept_id, candidate_id;
    false_positive: concept_id, fp_id, sentence2, seq. Returns pos_idx, kind (0, 1, 2), seq, from, label, concept_id, sentence1,
    sentence2; consumers order by (pos_idx, kind, seq). The negatives of a positive are a
    seeded draw over all candidates, see free_draws.
    """
    p = positive.select("pos_idx", "concept_id", "sentence1", "sentence2")
    cols = ["pos_idx", "kind", "seq", "from", "label", "concept_id", "sentence1", "sentence2"]
    own = p.withColumns({"kind": F.lit(0), "seq": F.lit(1), "from": F.lit("positive"), "label": F.lit(1)}).select(cols)
    neg = free_draws(p, "pos_idx", candidates, blacklist, n_neg, seed, ["sentence1"])
    neg = neg.withColumns({"kind": F.lit(1), "from": F.lit("negative"), "label": F.lit(0)}).select(cols)
    first = p.groupBy("concept_id").agg(F.min_by(F.struct("pos_idx", "sentence1"), "pos_idx").alias("f")).select("concept_id", "f.*")
    fps = false_positive if n_fp is None else false_positive.where(F.col("seq") <= n_fp)
    fp = fps.select("concept_id", "sentence2", "seq").join(first, "concept_id").withColumns({"kind": F.lit(2), "from": F.lit("false_positive"), "label": F.lit(0)}).select(cols)
    return own.unionByName(neg).unionByName(fp)


def trainer_rows(rows: DataFrame) -> DataFrame:
    return rows.select("sentence1", "sentence2", "label")


def interleaved_length(positive: DataFrame, n_candidates: int, blacklist: DataFrame, false_positive: DataFrame, n_neg: int) -> DataFrame:
    """The number of rows that interleaved gives: per positive 1 + min(n_neg, candidates left), and each concept's false positives."""
    black = blacklist.select("concept_id", "candidate_id").distinct().groupBy("concept_id").agg(F.count("*").alias("b"))
    rows = positive.join(black, "concept_id", "left")
    per = 1 + F.least(F.lit(n_neg), F.greatest(F.lit(0), F.lit(n_candidates) - F.coalesce("b", F.lit(0))))
    fps = false_positive.join(positive.select("concept_id").distinct(), "concept_id", "left_semi").agg(F.count("*").alias("f"))
    return rows.agg(F.coalesce(F.sum(per), F.lit(0)).alias("p")).crossJoin(fps).select((F.col("p") + F.col("f")).cast("long").alias("length"))


def exploded_pairs(nested: DataFrame, arrays: Sequence[str], id_column: str) -> DataFrame:
    """Parallel arrays to distinct rows; rows with empty arrays go."""
    rows = nested.where(F.size(F.col(arrays[0])) > 0)
    return rows.select(id_column, F.inline(F.arrays_zip(*arrays))).distinct()


def without_reserved(df: DataFrame, ids: str, others: Sequence[str], reserved: Sequence[int]) -> DataFrame:
    """Removes the places of reserved ids from parallel arrays; all removed gives empty arrays."""
    kept = F.filter(F.arrays_zip(ids, *others), lambda x: ~x[ids].isin(*reserved) if reserved else F.lit(True))
    return df.withColumn("_k", kept).withColumns({c: F.col("_k")[c] for c in (ids, *others)}).drop("_k")


def sampled(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """A seeded draw of n rows: top-n by hash, no full sort."""
    return df.orderBy(seeded_order(seed, *keys), *keys).limit(n)
