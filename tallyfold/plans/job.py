"""End-to-end job: select rows, fingerprint once, train, validate, score the test table.

Every hand-over between steps is a table under ``out_dir`` (a folder all executors reach), so a lost
executor costs a re-read, never a recomputation from the start.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.scalars import add_code
from tallyfold.operators import fingerprints as fp
from tallyfold.operators.labels import (
    class_counts,
    dictionary_frame,
    grow_dictionary,
    learner_count,
    with_class_weight,
)
from tallyfold.operators.boosting import model_inputs
from tallyfold.operators.learning import BoostedModel, takes_vectors, trainer, weak_scores
from tallyfold.operators.metrics import METRICS, binary_metrics
from tallyfold.operators.ranking import debug_subset, settled
from tallyfold.operators.rowsets import (
    FINAL,
    allot_learners,
    cap_train_size,
    keep_ids,
    positives_wanted,
    select_training_rows,
    split_train_val,
    top_up_positives,
)
from tallyfold.operators.structure import STRUCTURE_KEYS
from tallyfold.plans.params import ENSEMBLE, Columns, FeatureParams, JobParams
from tallyfold.session import path_exists
from tallyfold.sources import tables

LEARNERS_AT_ONCE = 4
#: Fingerprints of texts that must be line notation.
READ_AS_NOTATION = ("graph_circular", "structure_keys")
ID, TEXT, LABEL, CATEGORY = "row_id", "text", "label", "category"


def normalise(df: DataFrame, columns: Columns, labelled: bool) -> DataFrame:
    """``row_id, text[, label][, category]`` under fixed names; only these columns are ever read."""
    need = [columns.text, *([columns.label] if labelled else []), *([columns.category] if columns.category else [])]
    row_id = columns.row_id if labelled else columns.test_id or columns.row_id
    tables.require_columns(df, [*need, *([row_id] if row_id else [])])
    if row_id is None:
        df, row_id = tables.with_row_index(df, "_position"), "_position"
    picked = [F.col(row_id).alias(ID), F.col(columns.text).alias(TEXT)]
    if columns.label in df.columns:
        picked.append(F.col(columns.label).cast("int").alias(LABEL))
    if columns.category:
        picked.append(F.col(columns.category).alias(CATEGORY))
    return df.select(*picked)


@dataclass
class Selection:
    """Chosen rows with their ``split``, and what the class weight depends on."""

    rows: DataFrame
    neg: int
    pos: int
    base_rows: int
    topped_up: bool

    def weight(self, params: JobParams, n_selected: int) -> float:
        """neg / pos after the top-up; without one, the configured weight comes first."""
        if self.topped_up:
            return self.neg / (self.pos + n_selected - self.base_rows)
        return params.model.scale_pos_weight or self.neg / self.pos


def select_rows(rows: DataFrame, whole: DataFrame, params: JobParams) -> Selection:
    """Cap, top-up and split of one model's rows.

    ``rows`` are the model's own, ``whole`` the table that class counts fall back to when positives may
    come from anywhere.
    """
    own = params.top_up_from == "own"
    counts = class_counts(rows if own else whole, LABEL).first()
    wanted = positives_wanted(counts.neg, counts.pos, params.target_scale_pos_weight)
    n_rows = min(rows.count(), params.debug_rows) if params.debug else rows.count()
    base_rows = n_rows if params.train_size == -1 else min(n_rows, params.train_size)
    if not params.debug and (own or not wanted):
        if wanted > counts.pos:
            raise ValueError(f"cannot draw {wanted} of {counts.pos} positive rows without replacement")
        picked = select_training_rows(
            rows, ID, LABEL, params.train_size, wanted, params.train_share, params.seed + 1, params.hash
        )
        return Selection(picked, counts.neg, counts.pos, base_rows, wanted > 0)
    working = debug_subset(rows, ID, params.debug_rows, params.seed, params.hash) if params.debug else rows
    working = cap_train_size(working, ID, params.train_size, params.seed + 1, params.hash)
    working = top_up_positives(
        working,
        rows if own else whole,
        ID,
        LABEL,
        params.target_scale_pos_weight,
        counts.neg,
        counts.pos,
        params.seed + 2,
        params.hash,
        debug_rows=params.debug_added if params.debug else None,
    )
    picked = split_train_val(working, ID, params.train_share, params.seed + 3, params.hash)
    return Selection(picked, counts.neg, counts.pos, base_rows, wanted > 0)


def build_features(df: DataFrame, features: FeatureParams, dictionary: DataFrame | None, keep: list[str]) -> DataFrame:
    """``row_id, …, bits[, code]``."""
    code = [] if dictionary is None else ["code"]
    if dictionary is not None:
        # looked up first, so that a lookup in parts computes no row's bits twice
        df = fp.with_category_code(df, CATEGORY, dictionary, *code, n_codes=dictionary.count())
    made = fp.featurizer(features.name)(df, TEXT, radius=features.radius, length=features.length, hash=features.hash)
    return made.select(ID, *keep, "bits", *code)


def vectorise(df: DataFrame, n_bits: int, code_mode: str, vectors: bool = False) -> DataFrame:
    """Model-side inputs out of bits and code: bits and numbers, or one ``features`` vector."""
    if not vectors:
        if "code" not in df.columns:
            return model_inputs(df, "bits")
        if code_mode == "add":
            return model_inputs(df, None).withColumn("in_numbers", add_code(F.col("bits"), F.col("code"), n_bits))
        return model_inputs(df, "bits", ["code"])
    if "code" not in df.columns:
        return fp.bits_to_vector(df, "bits", n_bits)
    if code_mode == "add":
        return df.withColumn("features", array_to_vector(add_code(F.col("bits"), F.col("code"), n_bits)))
    return fp.assemble(fp.bits_to_vector(df, "bits", n_bits, "_bits"), ["_bits", "code"]).drop("_bits")


def score_inputs(df: DataFrame, k: int, trainer_name: str) -> DataFrame:
    """Inputs of the final model of an ensemble: the scores of its ``k`` weak learners."""
    names = [f"weak_{i}" for i in range(k)]
    return fp.assemble(df, names) if takes_vectors(trainer_name) else model_inputs(df, None, names)


def bit_length(features: FeatureParams) -> int:
    if features.name == "structure_keys":
        return len(STRUCTURE_KEYS)
    return max(k.key for k in fp.NOTATION_KEYS) + 1 if features.name == "pattern_keys" else features.length


@dataclass
class JobResult:
    model: BoostedModel
    weak: list[BoostedModel]
    metrics: dict
    out_dir: str


def _rewrite(df: DataFrame, path: str, **options) -> DataFrame:
    tables.write_table(df, path, mode="overwrite", **options)
    return df.sparkSession.read.parquet(path)


def _all_readable(made: DataFrame, features: FeatureParams, what: str) -> DataFrame:
    """A fingerprint that is null stands for a text that cannot be read; the job stops rather than lose it."""
    bad = made.where(F.col("bits").isNull()).count() if features.name in READ_AS_NOTATION else 0
    if bad:
        raise ValueError(f"{bad} rows of the {what} table are not line notation")
    return made


def _train_one(
    stored: DataFrame,
    vectors: Callable[[DataFrame], DataFrame],
    chosen: Selection,
    params: JobParams,
    out_dir: str,
    input_name: str,
    resume: bool,
) -> tuple[BoostedModel, dict]:
    """Train and validate on the stored rows of one model; ``resume`` goes on from the rounds of an ended run."""
    spark = stored.sparkSession
    tables.write_membership(stored, f"{out_dir}/membership", ID, [LABEL, "split"], mode="overwrite")
    weight = chosen.weight(params, stored.count())
    rows = with_class_weight(vectors(stored), LABEL, weight)
    rounds = f"{out_dir}/snapshots"
    how = {} if takes_vectors(params.trainer) else {"snapshots": rounds, "resume": rounds if resume and path_exists(spark, rounds) else None}
    model, curve = trainer(params.trainer)(rows, LABEL, params.model, ID, "split", "weight", **how)
    model.save(out_dir)
    if curve is not None:
        tables.write_csv(curve.orderBy("round", "split"), f"{out_dir}/rounds.csv", mode="overwrite")
    val = model.score(rows.where(F.col("split") == "val")).select(ID, LABEL, "score")
    metrics = binary_metrics(_rewrite(val, f"{out_dir}/val_scores"), "score", LABEL).select(*METRICS)
    metrics = metrics.first().asDict()
    table = spark.createDataFrame([metrics], ", ".join(f"{m} double" for m in METRICS))
    tables.write_csv(table, tables.metrics_path(out_dir, input_name), mode="overwrite")
    return model, metrics


def _submit(scores: DataFrame, out_dir: str, answer_name: str) -> None:
    """Write one score per test row (``row_id, score``), in ``test_scores`` and sorted in ``submission.csv``."""
    # stored before it is sorted, as a sort reads its input twice
    answer = tables.submission(_rewrite(scores, f"{out_dir}/test_scores"), ID, "score", answer_name, order=ID)
    tables.write_csv(answer, f"{out_dir}/submission.csv", mode="overwrite")


def run_job(
    spark: SparkSession,
    train_df: DataFrame,
    test_df: DataFrame,
    params: JobParams,
    columns: Columns,
    out_dir: str,
    codes: Mapping[str, int] | None = None,
    input_name: str = "train.parquet",
    resume: bool = False,
) -> JobResult:
    """Run the whole pipeline.

    Writes ``config``, ``membership``, ``snapshots`` (the trees, round by round), ``model``, ``rounds.csv``,
    ``{input}_metrics.csv`` and ``submission.csv`` under ``out_dir``, and the same under ``weak_learner_{i}`` for every weak
    learner.  With ``resume`` the models of an earlier run in ``out_dir``, with the same data and settings, go on from
    their last stored round.
    """
    out_dir = out_dir.rstrip("/")
    notes = json.dumps(params.to_dict())
    spark.createDataFrame([(notes,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/config")
    spark.createDataFrame([(json.dumps(asdict(columns)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/columns")
    whole = normalise(train_df, columns, labelled=True)
    test = normalise(test_df, columns, labelled=False)
    dictionary = None
    if columns.category:
        known = dictionary_frame(spark, codes or {})
        grown = _rewrite(grow_dictionary(whole, CATEGORY, ID, known, len(codes or {})), f"{out_dir}/codes_train")
        grown = _rewrite(grow_dictionary(test, CATEGORY, ID, grown, grown.count()), f"{out_dir}/codes")
        dictionary = grown

    base = params.weak if params.kind == ENSEMBLE else params

    def vectors(df: DataFrame) -> DataFrame:
        return vectorise(df, bit_length(base.features), base.code_mode, takes_vectors(base.trainer))

    # texts are read to make bits, once per table, and never again
    made = _rewrite(build_features(test, base.features, dictionary, []), f"{out_dir}/features_test")
    test_rows = vectors(_all_readable(made, base.features, "test"))

    if params.kind != ENSEMBLE:
        chosen = select_rows(whole, whole, params)
        made = build_features(chosen.rows, base.features, dictionary, [LABEL, "split"])
        stored = _all_readable(_rewrite(made, f"{out_dir}/features_train", partition_by=["split"]), base.features, "training")
        model, metrics = _train_one(stored, vectors, chosen, params, out_dir, input_name, resume)
        _submit(model.score(test_rows).select(ID, "score"), out_dir, columns.label)
        return JobResult(model, [], metrics, out_dir)

    k = learner_count(whole.count(), params.train_size, params.weak.train_size)
    dealt = allot_learners(whole, ID, params.weak.train_size, params.train_size, ID, params.seed, params.hash)
    made = build_features(dealt, base.features, dictionary, [LABEL, "learner"])
    # one folder per learner; rebalancing keeps files few for small learners and splits the large final set
    dealt = _rewrite(made.hint("rebalance", "learner"), f"{out_dir}/features_train", partition_by=["learner"])
    dealt = _all_readable(dealt, base.features, "training").withColumn("learner", F.col("learner").cast("string"))
    def train_weak(i: int) -> BoostedModel:
        where = f"{out_dir}/weak_learner_{i}"
        chosen = select_rows(dealt.where(F.col("learner") == str(i)), dealt, params.weak)
        stored = _rewrite(chosen.rows, f"{where}/features_train", partition_by=["split"])
        return _train_one(stored, vectors, chosen, params.weak, where, input_name, resume)[0]

    # learners have rows of their own; a few are trained side by side, as one seldom fills a cluster
    with ThreadPoolExecutor(LEARNERS_AT_ONCE) as pool:
        weak = list(pool.map(train_weak, range(k)))

    def weak_score_vectors(df: DataFrame) -> DataFrame:
        return score_inputs(df, k, params.trainer)

    chosen = select_rows(dealt.where(F.col("learner") == FINAL), dealt, params)
    scored = weak_scores(weak, vectors(chosen.rows)).drop("features", "in_bits", "in_numbers")
    stored = _rewrite(scored, f"{out_dir}/weak_scores_train", partition_by=["split"])
    # row by row, as test ids may be null and may repeat; each weak learner scores the test table once
    scored = weak_scores(weak, test_rows).select(ID, *[f"weak_{i}" for i in range(k)])
    scored_test = _rewrite(scored, f"{out_dir}/weak_scores_test")
    for i in range(k):
        _submit(scored_test.select(ID, F.col(f"weak_{i}").alias("score")), f"{out_dir}/weak_learner_{i}", columns.label)
    # class counts of the whole table, as the final model stands for all of it
    totals = class_counts(dealt, LABEL).first()
    if not chosen.topped_up:
        chosen.neg, chosen.pos = totals.neg, totals.pos
    model, metrics = _train_one(stored, weak_score_vectors, chosen, params, out_dir, input_name, resume)
    _submit(model.score(weak_score_vectors(scored_test)).select(ID, "score"), out_dir, columns.label)
    return JobResult(model, weak, metrics, out_dir)


@dataclass
class SavedRun:
    """A finished run, read back from its folder, to score and evaluate other tables."""

    params: JobParams
    columns: Columns
    dictionary: DataFrame | None
    model: BoostedModel
    weak: list[BoostedModel]

    def _scored(self, df: DataFrame, labelled: bool) -> DataFrame:
        base = self.params.weak if self.params.kind == ENSEMBLE else self.params
        rows = normalise(df, self.columns, labelled)
        keep = [LABEL] if LABEL in rows.columns else []
        # stored, as the rows are counted for unreadable texts before they are scored
        made = settled(build_features(rows, base.features, self.dictionary, keep), "features")
        made = _all_readable(made, base.features, "given")
        rows = vectorise(made, bit_length(base.features), base.code_mode, takes_vectors(base.trainer))
        if self.weak:
            scored = weak_scores(self.weak, rows).drop("features", "in_bits", "in_numbers")
            rows = score_inputs(scored, len(self.weak), self.params.trainer)
        return self.model.score(rows).select(ID, *keep, "score")

    def score(self, df: DataFrame, labelled: bool = False) -> DataFrame:
        """``row_id, score`` of every row; ``labelled`` says which of the two id columns the table has."""
        return self._scored(df, labelled).select(ID, "score")

    def evaluate(self, df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """One row of metrics over the labelled rows, or over those named in ``ids`` (column ``row_id``)."""
        scored = self._scored(df, labelled=True)
        return binary_metrics(scored if ids is None else keep_ids(scored, ID, ids), "score", LABEL)


def load_run(spark: SparkSession, out_dir: str) -> SavedRun:
    """Read a run of :func:`run_job` back: settings, columns, category codes, model and weak learners."""
    out_dir = out_dir.rstrip("/")
    params = JobParams.from_saved(json.loads(spark.read.text(f"{out_dir}/config").first().value))
    columns = Columns(**json.loads(spark.read.text(f"{out_dir}/columns").first().value))
    dictionary = None
    if columns.category:
        codes = spark.read.parquet(f"{out_dir}/codes")
        dictionary = codes
    weak = []
    if params.kind == ENSEMBLE:
        size = len(spark.read.parquet(f"{out_dir}/weak_scores_test").columns) - 1
        weak = [BoostedModel.load(f"{out_dir}/weak_learner_{i}") for i in range(size)]
    return SavedRun(params, columns, dictionary, BoostedModel.load(out_dir), weak)
