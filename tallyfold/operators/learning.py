"""Boosted trees: features in, scores out, with stopping by rounds and two-level stacking."""

from __future__ import annotations

import importlib.util
import json
import math
import warnings
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.boosting import BitTreeModel, Boosting, Growth, model_inputs
from tallyfold.operators.fingerprints import assemble
from tallyfold.operators.metrics import METRICS, binary_metrics, early_stop, round_curve
from tallyfold.operators.ranking import settled
from tallyfold.session import shared_dir


@dataclass(frozen=True)
class BoostParams:
    """Settings of one boosted-tree model, under their usual names."""

    max_depth: int = 10
    num_boost_round: int = 100
    eta: float = 0.05
    subsample: float = 0.6
    colsample_bytree: float = 0.6
    alpha: float = 0.0
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    early_stopping_rounds: int | None = 5
    eval_metric: str = "average_precision"
    scale_pos_weight: float | None = None
    max_bins: int = 32
    seed: int = 42
    partitions: int | None = None
    others: dict = field(default_factory=dict)


    def __post_init__(self):
        stopping_metric(self.eval_metric)


# Names under which a stopping metric may be asked for: fixed values.  Larger is better for all of them.
STOPPING_METRICS = {
    "average_precision": "average_precision",
    "map": "average_precision",
    "aucpr": "average_precision",
    "roc_auc": "roc_auc",
    "auc": "roc_auc",
    "accuracy": "accuracy",
    "error": "accuracy",
}


def stopping_metric(name: str) -> str:
    if name not in STOPPING_METRICS:
        raise ValueError(f"eval_metric {name!r} is not supported; choose one of {sorted(STOPPING_METRICS)}")
    return STOPPING_METRICS[name]


ROWS_PER_PARTITION = 250_000


def arrange(df: DataFrame, row_id: str, partitions: int | None = None) -> DataFrame:
    """Fixed placement and order of rows, so that a refit sees the same partitions and grows the same trees."""
    n = partitions
    if n is None:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n = max(least, math.ceil(df.count() / ROWS_PER_PARTITION))
    return df.repartition(n, row_id).sortWithinPartitions(row_id)


def fit_trees(df: DataFrame, label: str, params: BoostParams, row_id: str, weight: str | None = None) -> GBTClassificationModel:
    """Fit on columns ``features`` and ``label`` with the first-order boosted trees of Spark ML."""
    if params.alpha:
        warnings.warn("an L1 penalty (alpha) has no counterpart in Spark's boosted trees and is ignored", stacklevel=2)
    columns = [F.col(row_id), F.col("features"), F.col(label).cast("double").alias("label")]
    if weight:
        columns.append(F.col(weight).alias("weight"))
    learner = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        lossType="logistic",
        maxDepth=params.max_depth,
        maxIter=params.num_boost_round,
        stepSize=params.eta,
        subsamplingRate=params.subsample,
        featureSubsetStrategy="all" if params.colsample_bytree >= 1 else str(params.colsample_bytree),
        maxBins=params.max_bins,
        seed=params.seed,
    )
    if weight:
        learner = learner.setWeightCol("weight")
    shared_dir(df.sparkSession)  # the lineage of many rounds is cut by checkpoints there
    return learner.fit(arrange(df.select(*columns), row_id, params.partitions).drop(row_id))


EXTERNAL_METRICS = {"average_precision": "aucpr", "roc_auc": "auc", "accuracy": "error"}


def fit_external_trees(df: DataFrame, label: str, params: BoostParams, weight: str | None = None, split: str | None = None):
    """Fit with the distributed trainer of the ``xgboost`` package, where it is installed on the cluster.

    With ``split`` its ``val`` rows watch the training and stop it after the patience.
    """
    if importlib.util.find_spec("xgboost") is None:
        raise ImportError("the xgboost package is not installed")
    from xgboost.spark import SparkXGBClassifier

    columns = [F.col("features"), F.col(label).cast("double").alias("label")]
    if weight:
        columns.append(F.col(weight).alias("weight"))
    watched = {}
    if split:
        columns.append((F.col(split) == "val").alias("watch"))
        watched = {"validation_indicator_col": "watch", "eval_metric": EXTERNAL_METRICS[stopping_metric(params.eval_metric)]}
        if params.early_stopping_rounds is not None:
            watched["early_stopping_rounds"] = params.early_stopping_rounds
    learner = SparkXGBClassifier(
        features_col="features",
        label_col="label",
        weight_col="weight" if weight else None,
        num_workers=params.partitions or df.sparkSession.sparkContext.defaultParallelism,
        max_depth=params.max_depth,
        n_estimators=params.num_boost_round,
        learning_rate=params.eta,
        subsample=params.subsample,
        colsample_bytree=params.colsample_bytree,
        reg_alpha=params.alpha,
        reg_lambda=params.reg_lambda,
        min_child_weight=params.min_child_weight,
        random_state=params.seed,
        **watched,
        **params.others,
    )
    return learner.fit(df.select(*columns))


# ----------------------------------------------------------------------------------------- scoring


def probability(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def _tree_outputs(model: GBTClassificationModel, df: DataFrame, rounds: int) -> DataFrame:
    for i, tree in enumerate(model.trees[:rounds]):
        df = tree.setFeaturesCol("features").setPredictionCol(f"_t{i}").transform(df)
    return df


def _weighted(model: GBTClassificationModel, i: int) -> Column:
    return F.col(f"_t{i}") * F.lit(float(model.treeWeights[i]))


def staged_margins(model: GBTClassificationModel, df: DataFrame, rounds: int, name: str = "margins") -> DataFrame:
    """Add the running margin after each of the first ``rounds`` trees, as an array."""
    df = _tree_outputs(model, df, rounds)
    outputs = F.array(*[_weighted(model, i) for i in range(rounds)])
    running = F.aggregate(
        outputs,
        F.array().cast("array<double>"),
        lambda done, x: F.array_append(done, F.coalesce(F.get(done, F.size(done) - 1), F.lit(0.0)) + x),
    )
    return df.withColumn(name, running).drop(*[f"_t{i}" for i in range(rounds)])


def score_rows(model, df: DataFrame, rounds: int | None = None, name: str = "score") -> DataFrame:
    """Add the probability of class 1, by all trees or by the first ``rounds``."""
    n_trees = model.getNumTrees if isinstance(model, GBTClassificationModel) else None
    if rounds is None or rounds == n_trees:
        scored = model.transform(df)
        added = [c for c in scored.columns if c not in df.columns]
        return scored.withColumn(name, vector_to_array("probability")[1]).drop(*[c for c in added if c != name])
    if not 0 < rounds < n_trees:
        raise ValueError(f"the model has {n_trees} rounds, not {rounds}")
    df = _tree_outputs(model, df, rounds)
    margin = sum((_weighted(model, i) for i in range(rounds)), F.lit(0.0))
    return df.withColumn(name, probability(margin)).drop(*[f"_t{i}" for i in range(rounds)])


def staged_scores(model: GBTClassificationModel, df: DataFrame, label: str, split: str) -> DataFrame:
    """Long table ``round, split, score, label``: the score of every row after every round."""
    staged = staged_margins(model, df, model.getNumTrees)
    return staged.select(split, label, F.posexplode("margins").alias("round", "_margin")).select(
        "round", split, probability(F.col("_margin")).alias("score"), label
    )


# ------------------------------------------------------------------------------- model with stopping


@dataclass
class BoostedModel:
    """A fitted model and the number of rounds that count; earlier rounds stay available by number."""

    model: object
    kept_rounds: int | None
    best_round: int | None = None

    def score(self, df: DataFrame, rounds: int | None = None, name: str = "score") -> DataFrame:
        if isinstance(self.model, BitTreeModel):
            return self.model.score(df, rounds or self.kept_rounds, name)
        return score_rows(self.model, df, rounds or self.kept_rounds, name)

    def save(self, path: str) -> None:
        """Model folder, with the round numbers beside it as one line of JSON."""
        spark = SparkSession.active()
        if isinstance(self.model, BitTreeModel):
            kind = "boosted_trees"
            self.model.save(f"{path}/model")
        else:
            kind = "ml_boosted_trees" if isinstance(self.model, GBTClassificationModel) else "external_boosted_trees"
            self.model.write().overwrite().save(f"{path}/model")
        notes = json.dumps({"kept_rounds": self.kept_rounds, "best_round": self.best_round, "kind": kind})
        spark.createDataFrame([(notes,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/rounds")

    @classmethod
    def load(cls, path: str) -> BoostedModel:
        spark = SparkSession.active()
        notes = json.loads(spark.read.text(f"{path}/rounds").first().value)
        if notes.get("kind") == "external_boosted_trees":
            from xgboost.spark import SparkXGBClassifierModel

            model = SparkXGBClassifierModel.load(f"{path}/model")
        elif notes.get("kind") == "ml_boosted_trees":
            model = GBTClassificationModel.load(f"{path}/model")
        else:
            model = BitTreeModel.load(f"{path}/model")
        return cls(model, notes["kept_rounds"], notes["best_round"])


CURVE = "round int, split string, roc_auc double, average_precision double, accuracy double, n_pos bigint, n_neg bigint"
#: Scores are dealt to this many even ranges of probability for a round's metrics.
SCORE_RANGES = 4096


def train_rounds(
    df: DataFrame,
    label: str,
    params: BoostParams,
    row_id: str,
    split: str = "split",
    weight: str | None = None,
    train_curve: bool = False,
    snapshots: str | None = None,
    resume: str | None = None,
) -> tuple[BoostedModel, DataFrame]:
    """Grow second-order trees round by round on the ``train`` rows and stop as soon as patience is used up.

    After each round its ``eval_metric`` is measured on the ``val`` rows, from the stored margins of that round, and
    compared with the best so far as :func:`early_stop` does; no round is grown beyond the one where training stops.
    With ``snapshots`` each round's tree is stored in that folder before the next one is grown; such a folder is a model
    of the rounds so far, and ``resume`` goes on from one: its rounds are scored again, not grown again.

    ``df`` has the inputs of :func:`model_inputs`.  Returns the model and the curve: one row per round of the ``val`` rows,
    with ``train_curve`` of both splits.
    """
    growth = Growth(params.max_depth, params.eta, params.alpha, params.reg_lambda, params.min_child_weight, params.subsample, params.colsample_bytree, params.seed)
    begun = BitTreeModel.load(resume) if resume else None
    run = Boosting(df, row_id, label, split, growth, weight, params.max_bins, model=begun)
    if snapshots and snapshots != resume:
        run.model.save(snapshots)
    metric, patience = stopping_metric(params.eval_metric), params.early_stopping_rounds
    watched = df if train_curve else df.where(F.col(split) == "val")
    curve, best, best_value = [], None, None

    def counts(rows: list) -> bool:
        """Take in a round's metrics; whether training ends with it."""
        nonlocal best, best_value
        curve.extend(rows)
        val = next((r for r in rows if r["split"] == "val"), None)
        value, now = (val[metric] if val else None), rows[0]["round"] if rows else len(curve)
        if value is not None and (best_value is None or value > best_value):
            best, best_value = now, value
        return patience is not None and now - (best or 0) >= patience

    def measured(state: DataFrame, round_no: int) -> list[dict]:
        rows = state if train_curve else state.where("split = 'val'")
        rows = rows.select("split", "y", (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))).alias("score"))
        found = binary_metrics(rows, "score", "y", by=["split"], bucket=F.floor(F.col("score") * SCORE_RANGES))
        return [{"round": round_no, **r.asDict()} for r in found.collect()]

    ended = False
    if begun and begun.n_rounds:
        earlier = curve_of_rounds(begun, watched, label, split).orderBy("round", "split").collect()
        for i in range(begun.n_rounds):
            ended = counts([r.asDict() for r in earlier if r["round"] == i])
    with ThreadPoolExecutor(1) as aside:
        while not ended and run.model.n_rounds < params.num_boost_round:
            tree = run.step()
            if snapshots:
                run.model.add_saved(snapshots, tree)
            # the next tree's nodes are searched while this round is measured; it joins the model only if training goes on
            waiting = aside.submit(measured, run.state, run.model.n_rounds - 1)
            if run.model.n_rounds < params.num_boost_round:
                run.look_ahead()
            ended = counts(waiting.result())
    run.close()
    spark = df.sparkSession
    names = ["round", "split", *METRICS, "n_pos", "n_neg"]
    frame = spark.createDataFrame([tuple(r[c] for c in names) for r in curve], CURVE).withColumnRenamed("split", split)
    return BoostedModel(run.model, run.model.n_rounds, best), frame


def curve_of_rounds(model: BitTreeModel, df: DataFrame, label: str, split: str) -> DataFrame:
    """Metrics after every round and split, as :func:`round_curve` has them.

    Rows that reach the same leaf of every tree are one row with a count before rounds are unfolded, so the unfolded
    table has at most as many rows as there are leaf patterns, times the rounds.
    """
    patterns = leaf_patterns(model, df, label, split)
    each = patterns.select(split, label, "n", F.posexplode(model.pattern_margins("pattern")).alias("round", "_margin"))
    scored = each.select("round", split, label, "n", (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_margin")))).alias("score"))
    return binary_metrics(scored, "score", label, by=["round", split], times="n")


def leaf_patterns(model: BitTreeModel, df: DataFrame, label: str, split: str) -> DataFrame:
    """(split, label, pattern, n): labelled rows counted by the leaves they reach, a stored table."""
    rows = df.where(F.col(label).isin(0, 1)).select(split, label, model.leaf_pattern().alias("pattern"))
    return settled(rows.groupBy(split, label, "pattern").agg(F.count(F.lit(1)).alias("n")), "patterns")


def train(
    df: DataFrame,
    label: str,
    params: BoostParams,
    row_id: str,
    split: str = "split",
    weight: str | None = None,
    train_curve: bool = False,
) -> tuple[BoostedModel, DataFrame]:
    """Fit Spark ML's trees on the ``train`` rows and pick the stopping round by ``eval_metric`` on the ``val`` rows.

    Returns the model and the metric curve of the ``val`` rows; with ``train_curve`` of both splits, which scores the
    training rows once per round as well.  All rounds are grown first: Spark's own validation stop has other rules (it
    follows the loss and has no patience).  The model stays whole; scoring uses the rounds that count.
    """
    model = fit_trees(df.where(F.col(split) == "train"), label, params, row_id, weight)
    watched = df if train_curve else df.where(F.col(split) == "val")
    curve = settled(round_curve(staged_scores(model, watched, label, split), "round", split, "score", label), "curve")
    n = model.getNumTrees
    if params.early_stopping_rounds is None:
        return BoostedModel(model, n), curve
    metric = stopping_metric(params.eval_metric)
    val = curve.where(F.col(split) == "val").select("round", metric)
    stop = early_stop(val, "round", metric, params.early_stopping_rounds).first()
    return BoostedModel(model, stop.kept_rounds or n, stop.best_round), curve


def train_external(
    df: DataFrame, label: str, params: BoostParams, row_id: str, split: str = "split", weight: str | None = None
) -> tuple[BoostedModel, None]:
    """The same step with the external trainer, which stops by itself and keeps no per-round curve."""
    return BoostedModel(fit_external_trees(df, label, params, weight, split), None), None


TRAINERS: dict[str, Callable] = {"boosted_trees": train_rounds, "ml_boosted_trees": train, "external_boosted_trees": train_external}


def takes_vectors(name: str) -> bool:
    """Whether a trainer reads one ``features`` vector instead of bits and numbers."""
    return name != "boosted_trees"


def trainer(name: str) -> Callable:
    if name not in TRAINERS:
        raise ValueError(f"model type {name!r} is not supported; choose one of {sorted(TRAINERS)}")
    return TRAINERS[name]


# ---------------------------------------------------------------------------------------- stacking


def weak_scores(models: Sequence[BoostedModel], df: DataFrame, prefix: str = "weak_") -> DataFrame:
    """One score column per weak learner, all from the inputs of the row."""
    for i, m in enumerate(models):
        df = m.score(df, name=f"{prefix}{i}")
    return df


def stacked_features(models: Sequence[BoostedModel], df: DataFrame, prefix: str = "weak_") -> DataFrame:
    """Put the weak learners' scores in the place of the model's inputs: numbers, or one vector for vector models."""
    scored = weak_scores(models, df, prefix)
    if all(isinstance(m.model, BitTreeModel) for m in models):
        return model_inputs(scored, None, [f"{prefix}{i}" for i in range(len(models))])
    scored = scored.drop("features")
    return assemble(scored, [f"{prefix}{i}" for i in range(len(models))], "features")
