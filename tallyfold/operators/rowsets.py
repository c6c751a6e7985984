"""Row sets: splits, top-ups and disjoint allotments, kept as columns or id tables keyed by row id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.functions.hashing import row_hash
from tallyfold.operators.labels import class_counts
from tallyfold.operators.ranking import (
    at_or_before_rank,
    constant,
    cutoff_row,
    first_n,
    hash_bucket,
    rank_cutoffs,
    sample_n,
    small_side,
)

FINAL = "final"
# most leading hash bits by which the ends of learners are looked up
MAX_BITS = 24


def keep_ids(df: DataFrame, row_id: str, ids: DataFrame) -> DataFrame:
    """Rows named in ``ids``; repeated ids collapse before the shuffle, so a hot one costs nothing."""
    return df.join(ids.select(row_id).distinct(), row_id, "left_semi")


def drop_ids(df: DataFrame, row_id: str, ids: DataFrame) -> DataFrame:
    """Rows not named in ``ids``."""
    return df.join(ids.select(row_id).distinct(), row_id, "left_anti")


def id_difference(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Distinct ids of ``left`` that are not in ``right``."""
    return left.select(row_id).subtract(right.select(row_id))


def zip_scores(df: DataFrame, scores: DataFrame, row_id: str) -> DataFrame:
    """Rows with scores held in another table, joined by id rather than by position."""
    return df.join(scores, row_id)


def widen_scores(long: DataFrame, row_id: str, learner: str, score: str, learners: list) -> DataFrame:
    """One column per learner from a long ``(id, learner, score)`` table."""
    return long.groupBy(row_id).pivot(learner, learners).agg(F.max(score))


def cap_train_size(df: DataFrame, row_id: str, train_size: int = -1, seed: int = 42, hash: str = "md5") -> DataFrame:
    """At most ``train_size`` random rows; -1 keeps all."""
    return df if train_size == -1 else sample_n(df, row_id, train_size, seed, hash)


def split_train_val(
    df: DataFrame, row_id: str, train_share: float = 0.8, seed: int = 42, hash: str = "md5", name: str = "split"
) -> DataFrame:
    """Add ``train`` / ``val``: exactly ``int(train_share * rows)`` rows train."""
    is_train = at_or_before_rank(
        df, row_id, lambda total: (total.cast("double") * F.lit(train_share)).cast("bigint"), seed, hash
    )
    return df.withColumn(name, F.when(is_train, "train").otherwise("val"))


def positives_wanted(neg: int, pos: int, target_ratio: float) -> int:
    """Positives to add so that neg / pos comes down to ``target_ratio``; 0 when no top-up is due."""
    if pos == 0:
        raise ValueError("no positive rows, so neg / pos is undefined")
    if not 0 < target_ratio < neg / pos:
        return 0
    return math.floor(neg / target_ratio - pos)


def select_training_rows(
    df: DataFrame,
    row_id: str,
    label: str,
    train_size: int = -1,
    add_positives: int = 0,
    train_share: float = 0.8,
    seed: int = 42,
    hash: str = "md5",
    name: str = "split",
) -> DataFrame:
    """Cap, positive top-up and train / validation split in one row-wise pass.

    The top-up draws ``add_positives`` of the positives of ``df``; those beyond the cap are added.
    Each choice is a comparison with a cutoff row, so whole rows, texts included, never move.  Without a
    top-up one search finds both cutoffs: the cap takes the first rows of the seeded order, and the
    training rows are the first of those.
    """

    def size(total: Column) -> Column:
        return total if train_size == -1 else F.least(F.lit(train_size), total)

    if add_positives and train_size != -1:
        chosen = at_or_before_rank(df, row_id, lambda n: size(n).cast("bigint"), seed, hash)
        positive = df.where(F.col(label) == 1)
        drawn = at_or_before_rank(positive, row_id, lambda n: F.lit(add_positives).cast("bigint"), seed + 1, hash)
        selected = df.where(chosen | ((F.col(label) == 1) & drawn))
        return split_train_val(selected, row_id, train_share, seed + 2, hash, name)

    def both_ends(total: Column) -> Column:
        n_train = (size(total).cast("double") * F.lit(train_share)).cast("bigint")
        return F.array(n_train, size(total).cast("bigint"))

    hashed = df.select(row_hash(row_id, seed, hash).alias("_h"), F.col(row_id).alias("_id"))
    ends = rank_cutoffs(hashed, ["_h", "_id"], both_ends, n_cuts=2)
    ends = ends.agg(F.array_sort(F.collect_list(F.struct("_h", "_id")))).scalar()
    place = F.struct(row_hash(row_id, seed, hash).alias("_h"), F.col(row_id).alias("_id"))
    # a single end means that no row trains
    in_train = (F.size("_ends") == 2) & (F.col("_place") <= F.get("_ends", F.lit(0)))
    return (
        df.withColumn("_ends", ends)
        .withColumn("_place", place)
        .where(F.coalesce(F.col("_place") <= F.get("_ends", F.size("_ends") - 1), F.lit(False)))
        .withColumn(name, F.when(in_train, "train").otherwise("val"))
        .drop("_ends", "_place")
    )


def top_up_positives(
    working: DataFrame,
    candidates: DataFrame,
    row_id: str,
    label: str,
    target_ratio: float,
    neg: int | None = None,
    pos: int | None = None,
    seed: int = 43,
    hash: str = "md5",
    debug_rows: int | None = None,
) -> DataFrame:
    """``working`` plus positives sampled from ``candidates``, to bring neg / pos to the target.

    ``neg`` and ``pos`` are the counts the ratio is based on; by default those of ``candidates``.
    The sample is drawn from all positive candidates and then loses rows already in ``working``, so
    it may add fewer than asked for; asking for more than exist is an error.  ``seed`` must not be the
    one that drew ``working``: the same order would draw the same rows again.  ``debug_rows`` keeps
    the first so many of the added rows by id.
    """
    if neg is None or pos is None:
        base = class_counts(candidates, label).first()
        neg, pos = base.neg, base.pos
    n = positives_wanted(neg, pos, target_ratio)
    if n == 0:
        return working
    positive = candidates.where(F.col(label) == 1)
    added = drop_ids(sample_n(positive, row_id, n, seed, hash, strict=True), row_id, working)
    if debug_rows is not None:
        added = first_n(added, row_id, debug_rows)
    return working.unionByName(added.select(*working.columns))


def allot_learners(
    df: DataFrame,
    row_id: str,
    weak_size: int,
    final_size: int = -1,
    order: str | None = None,
    seed: int = 42,
    hash: str = "md5",
    name: str = "learner",
) -> DataFrame:
    """Deal disjoint sets of ``weak_size`` rows to weak learners ``"0", "1", …``; the rest is ``final``.

    The pool is every row but the last ``final_size`` along ``order`` (default: the id), or the whole
    table for -1.  Pool rows that do not fill another learner go to ``final`` as well.
    """
    order = order or row_id
    pool, in_pool = df, F.lit(True)
    if final_size != -1:
        keys = list(dict.fromkeys([order, row_id]))
        found = cutoff_row(df, keys, df.count() - final_size)
        if found is None or found[0] is None:
            in_pool = F.lit(False)
        else:
            in_pool = F.struct(*keys) <= constant(df, keys, found[0])
        pool = df.where(in_pool)
    learners = pool.count() // weak_size
    if not learners:
        return df.withColumn(name, F.lit(FINAL))
    hashed = pool.select(row_hash(row_id, seed, hash).alias("_h"), F.col(row_id).alias("_id"))
    cuts = rank_cutoffs(hashed, ["_h", "_id"], n_cuts=learners, every=weak_size)
    # ends of learners by leading hash bits: about one per bucket, and how many lie in buckets before
    bits = min(MAX_BITS, max(1, learners.bit_length()))
    ends = cuts.groupBy(hash_bucket("_h", bits).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_h", "_id"))).alias("_ends"))
    every = df.sparkSession.range(2**bits).select(F.col("id").alias("_b")).join(ends, "_b", "left")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.size("_ends"), F.lit(0))
    every = every.select("_b", "_ends", F.coalesce(F.sum(F.greatest(here, F.lit(0))).over(before), F.lit(0)).alias("_before"))
    place = F.struct(row_hash(row_id, seed, hash).alias("_h"), F.col(row_id).alias("_id"))
    dealt = df.withColumn("_place", place).withColumn("_b", hash_bucket(F.col("_place._h"), bits))
    dealt = dealt.join(small_side(every, 2**bits), "_b", "left")
    passed = F.coalesce(F.size(F.filter("_ends", lambda end: end < F.col("_place"))), F.lit(0))
    number = F.col("_before") + F.greatest(passed, F.lit(0))
    learner = F.when(in_pool & (number < learners), number.cast("string")).otherwise(F.lit(FINAL))
    return dealt.withColumn(name, learner).select(*df.columns, name)
