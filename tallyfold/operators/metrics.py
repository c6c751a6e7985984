"""Exact evaluation of scored rows.

Scores are first grouped by value, so ties and hot scores collapse map-side; the running counts then
go through the distributed prefix sum.  Nothing is down-binned, so results do not depend on a bin
count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.functions.scalars import above
from tallyfold.operators.ranking import running_totals, settled

METRICS = ["roc_auc", "average_precision", "accuracy"]


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score; rows without a 0/1 label or a score are left out.

    ``times`` names a column of how many rows each row stands for.
    """
    known = df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    n = F.col(times).cast("bigint") if times else F.lit(1).cast("bigint")
    of = lambda y: F.sum(F.when(F.col(label) == y, n).otherwise(F.lit(0).cast("bigint")))
    return known.groupBy(*by, F.col(score).cast("double").alias("score")).agg(of(1).alias("pos"), of(0).alias("neg"))


def accuracy(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Share of labelled rows on the right side of the threshold."""
    hit = above(F.col(score), threshold).cast("int") == F.col(label)
    return df.where(F.col(label).isNotNull()).agg(F.avg(hit.cast("double")).alias("accuracy"))


def binary_metrics(
    df: DataFrame,
    score: str,
    label: str,
    by: Sequence[str] = (),
    threshold: float = 0.5,
    key_bits: int = 10,
    times: str | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """``*by, roc_auc, average_precision, accuracy, n_pos, n_neg``.

    Without labelled rows the metrics are null; AUC and AP are null when a class is missing.  ``times`` names a column of
    how many rows each row stands for.  For a stored ``df``, ``bucket`` is a number that never falls as ``score`` rises and
    that spreads the scores; it takes the place of sampled bounds, and nothing is written in between.
    """
    by = list(by)
    counts = score_counts(df, score, label, by, times)
    if bucket is None:
        # stored, so that rows are scored once although the counts are read more than once
        counts = settled(counts, "scores")
    curve = running_totals(
        counts,
        ["score"],
        {"tp": F.col("pos"), "fp": F.col("neg")},
        by=by,
        descending=True,
        key_bits=key_bits,
        bucket=bucket,
    )
    big = "decimal(38,0)"
    pairs2 = F.col("neg").cast("decimal(20,0)") * (2 * F.col("tp") - F.col("pos")).cast("decimal(18,0)")
    sums = curve.groupBy(*by).agg(
        F.sum(pairs2.cast(big)).cast("double").alias("pairs2"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.when(above(F.col("score"), threshold), F.col("pos")).otherwise(F.col("neg"))).alias("hits"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    n_pos, n_neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return sums.select(
        *by,
        F.when(both, F.col("pairs2") / (2 * n_pos * n_neg)).alias("roc_auc"),
        F.when(both, F.col("ap") / n_pos).alias("average_precision"),
        (F.col("hits") / (n_pos + n_neg)).alias("accuracy"),
        F.coalesce("n_pos", F.lit(0)).cast("bigint").alias("n_pos"),
        F.coalesce("n_neg", F.lit(0)).cast("bigint").alias("n_neg"),
    )


def round_curve(staged: DataFrame, round_col: str, split: str, score: str, label: str) -> DataFrame:
    """Metric curve of a staged-score table ``(round, split, score, label)``: one row per round and split."""
    return binary_metrics(staged, score, label, by=[round_col, split])


def early_stop(curve: DataFrame, round_col: str, metric: str, patience: int) -> DataFrame:
    """One row ``best_round, stop_round, kept_rounds``.

    Training stops at the first round that lies ``patience`` rounds past the best one so far; only a
    strict improvement counts and the first best wins.  Without such a round all rounds are kept.
    ``curve`` has one row per boosting round, so its window is tiny.
    """
    so_far = Window.partitionBy(F.lit(1)).orderBy(round_col)
    best_before = F.max(metric).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    better = F.col(metric).isNotNull() & (best_before.isNull() | (F.col(metric) > best_before))
    marked = (
        curve.withColumn("_gain", better)
        .withColumn("_best", F.last(F.when(F.col("_gain"), F.col(round_col)), ignorenulls=True).over(so_far))
        .withColumn("_first", F.min(round_col).over(Window.partitionBy(F.lit(1))))
        .withColumn("_since", F.col(round_col) - F.coalesce("_best", "_first"))
    )
    stop = F.min(F.when(F.col("_since") >= patience, F.col(round_col)))
    ended = marked.withColumn("_stop", stop.over(Window.partitionBy(F.lit(1)))).withColumn(
        "_stop", F.coalesce("_stop", F.max(round_col).over(Window.partitionBy(F.lit(1))))
    )
    return (
        ended.where(F.col(round_col) <= F.col("_stop"))
        .agg(
            F.max_by("_best", round_col).alias("best_round"),
            F.max("_stop").alias("stop_round"),
            F.count(F.lit(1)).alias("kept_rounds"),
        )
    )
