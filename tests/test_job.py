import json
import os

import pytest
from pyspark.sql import functions as F

from tallyfold.operators.learning import BoostedModel
from tallyfold.plans.job import load_run, run_job
from tallyfold.plans.params import Columns, JobParams
from tallyfold.streaming.micro import run_available
from tallyfold.operators.fingerprints import register_featurizer, token_chain_bits, user_kernel_bits

# 2,289 rows: 1,500 negatives and 789 positives
FRAGMENTS = ["C", "N", "O", "CC(=O)N", "c1ccccc1", "C(F)(F)", "S", "C(Cl)"]
MODEL = {
    "name": "xgboost", "eta": 0.05, "max_depth": 3, "objective": "binary:logistic", "eval_metric": "map",
    "verbosity": 2, "nthread": 50, "tree_method": "hist", "grow_policy": "depthwise", "subsample": 0.6,
    "colsample_bytree": 0.6, "num_boost_round": 3, "alpha": 0.0, "device": "cpu",
}
CIRCULAR = {"name": "circular_fingerprint", "radius": 2, "length": 256}
SINGLE = {"model": MODEL, "train": {"early_stopping_rounds": 2, "train_size": 2000}, "featurizer": CIRCULAR}
KEYS = {**SINGLE, "featurizer": {"name": "maccs_fingerprint"}}
STACKED = {
    "model": {**MODEL, "name": "xgboost_ensemble", "weak_learner_config": {**SINGLE, "train": {"early_stopping_rounds": 2, "train_size": 700}}},
    "train": {"early_stopping_rounds": 2, "train_size": 600},
    "featurizer": {"name": "ensemble_predictions"},
}
# the same with shorter trees, for what does not depend on them
SHORT = {**MODEL, "max_depth": 1, "num_boost_round": 2}
QUICK = {**SINGLE, "model": SHORT}
QUICK_STACKED = {
    **STACKED,
    "model": {**SHORT, "name": "xgboost_ensemble", "weak_learner_config": {**QUICK, "train": {"early_stopping_rounds": 2, "train_size": 700}}},
}
COLUMNS = Columns(text="notation", label="active", category="site", test_id="id")


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("in"))
    frag = F.array(*[F.lit(f) for f in FRAGMENTS])
    pick = lambda d: F.get(frag, F.pmod(F.floor(F.col("id") / d), F.lit(8)).cast("int"))
    mol = F.concat(pick(1), pick(8), pick(64), pick(512))
    rows = spark.range(2289).select(
        mol.alias("notation"), F.element_at(F.array(F.lit("north"), F.lit("east"), F.lit("south")), (F.col("id") % 3 + 1).cast("int")).alias("site"),
        (F.col("id") < 789).cast("int").alias("active"),
    )
    rows.coalesce(1).write.option("parquet.block.row.count.limit", 500).parquet(f"{base}/train")
    spark.range(5000, 5100).select("id", F.lit("CCO").alias("notation"), F.lit("NEW").alias("site")).coalesce(1).write.parquet(f"{base}/test")
    return spark.read.parquet(f"{base}/train"), spark.read.parquet(f"{base}/test")


CODES = {"north": 0, "east": 1, "south": 2}
FILES = ["membership", "model", "rounds", "rounds.csv", "train_metrics.csv", "submission.csv"]


@pytest.mark.parametrize("config", [SINGLE, KEYS, STACKED], ids=["circular", "keys", "stacked"])
def test_end_to_end(spark, inputs, tmp_path, config):
    out = str(tmp_path / "out")
    params = JobParams.from_dict(config)
    result = run_job(spark, *inputs, params, COLUMNS, out, CODES)
    for f in FILES:
        assert os.path.exists(f"{out}/{f}"), f
    members = spark.read.parquet(f"{out}/membership")
    size = {r["split"]: r["count"] for r in members.groupBy("split").count().collect()}
    n = 600 if params.weak else 2000
    # the final model also gets the pool's left-over rows and is cut back to its size
    assert size == {"train": int(0.8 * n), "val": n - int(0.8 * n)}
    assert members.select("row_id").distinct().count() == n
    sub = spark.read.option("header", True).csv(f"{out}/submission.csv")
    assert sub.columns == ["id", "active"]
    assert [int(r.id) for r in sub.collect()] == list(range(5000, 5100))
    assert 0.0 <= result.metrics["roc_auc"] <= 1.0
    assert result.metrics["roc_auc"] > 0.6
    saved = json.loads(spark.read.text(f"{out}/config").first().value)
    assert JobParams.from_saved(saved) == params
    codes = {r.value: r.code for r in spark.read.parquet(f"{out}/codes").collect()}
    assert codes == {**CODES, "NEW": 3}
    if params.weak:
        assert len(result.weak) == 2
        for i in range(2):
            for f in FILES:
                assert os.path.exists(f"{out}/weak_learner_{i}/{f}"), f
        weak_ids = [set(r.row_id for r in spark.read.parquet(f"{out}/weak_learner_{i}/membership").collect()) for i in range(2)]
        final_ids = {r.row_id for r in members.collect()}
        assert all(len(w) == 700 for w in weak_ids)
        assert not (weak_ids[0] & weak_ids[1]) and not (final_ids & (weak_ids[0] | weak_ids[1]))
    assert BoostedModel.load(out).kept_rounds == result.model.kept_rounds


def test_top_up_brings_the_ratio_down(spark, inputs, tmp_path):
    config = {**QUICK, "train": {"early_stopping_rounds": 2, "train_size": 1000, "target_scale_pos_weight": 1.5}}
    run_job(spark, *inputs, JobParams.from_dict(config), COLUMNS, str(tmp_path / "o"), CODES)
    members = spark.read.parquet(str(tmp_path / "o/membership"))
    # 1500 / 1.5 - 789 = 211 positives are drawn; those already among the 1000 rows are not added twice
    assert 1000 < members.count() <= 1211
    assert members.select("row_id").distinct().count() == members.count()


def test_own_fingerprint_in_a_job(spark, inputs, tmp_path):
    def length_bits(df, text, length=64, **_):
        return user_kernel_bits(df, text, lambda t: [min(len(t), length - 1)])

    register_featurizer("length", length_bits)
    config = {**QUICK, "featurizer": {"name": "length", "length": 64}}
    result = run_job(spark, *inputs, JobParams.from_dict(config), COLUMNS, str(tmp_path / "o"), CODES)
    assert result.model.model.n_bits <= 64 and result.model.model.n_numbers == 1


def test_debug_needs_enough_rows(spark, inputs, tmp_path):
    with pytest.raises(ValueError):
        run_job(spark, *inputs, JobParams.from_dict(SINGLE, debug=True), COLUMNS, str(tmp_path / "o"), CODES)


def test_bad_names_are_errors():
    with pytest.raises(ValueError):
        JobParams.from_dict({**SINGLE, "model": {**MODEL, "name": "forest"}})
    with pytest.raises(ValueError):
        JobParams.from_dict({**SINGLE, "featurizer": {"name": "none"}})
    with pytest.raises(TypeError):
        JobParams.from_dict({**SINGLE, "model": {**MODEL, "unknown": 1}})


def test_config_values(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(json.dumps(STACKED))
    p = JobParams.from_yaml(str(path))
    assert (p.model.eta, p.model.max_depth, p.model.subsample, p.train_size) == (0.05, 3, 0.6, 600)
    assert (p.weak.features.radius, p.weak.features.length, p.weak.train_size) == (2, 256, 700)
    assert p.model.eval_metric == "map" and p.ignored["device"] == "cpu"


def test_run_available_reads_each_file_once(spark, tmp_path):
    src = str(tmp_path / "in")
    doc = lambda i: spark.createDataFrame([(i, f"word{i} again")], "id int, text string").coalesce(1)
    run = lambda: run_available(
        spark, src, "id int, text string", lambda d: token_chain_bits(d, "text", 1, 64), str(tmp_path / "out"), str(tmp_path / "ck")
    )
    doc(1).write.parquet(src)
    run()
    doc(2).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in got.collect()) == [1, 2]
    batch = token_chain_bits(doc(2), "text", 1, 64).first().bits
    assert got.where("id = 2").first().bits == batch


@pytest.mark.parametrize("config", [QUICK, QUICK_STACKED], ids=["single", "stacked"])
def test_saved_run_with_string_ids_scores_and_evaluates_again(spark, inputs, tmp_path, config):
    out = str(tmp_path / "out")
    train, test = inputs
    train = train.withColumn("key", F.concat(F.lit("t"), F.monotonically_increasing_id().cast("string")))
    test = test.withColumn("id", F.concat(F.lit("x"), F.col("id").cast("string")))
    columns = Columns(text="notation", label="active", row_id="key", category="site", test_id="id")
    result = run_job(spark, train, test, JobParams.from_dict(config), columns, out, CODES)
    run = load_run(spark, out)
    assert len(run.weak) == len(result.weak) and run.params == JobParams.from_dict(config)
    sent = {r["id"]: float(r.active) for r in spark.read.option("header", True).csv(f"{out}/submission.csv").collect()}
    again = {r.row_id: r.score for r in run.score(test).collect()}
    assert again.keys() == sent.keys() and all(abs(again[k] - sent[k]) < 1e-9 for k in sent)
    val = spark.read.parquet(f"{out}/membership").where("split = 'val'")
    found = run.evaluate(train, val).first()
    assert all(abs(found[m] - result.metrics[m]) < 1e-9 for m in result.metrics)
    assert run.evaluate(train).first().n_pos == 789


def test_job_stops_at_texts_it_cannot_read(spark, inputs, tmp_path):
    train, test = inputs
    broken = train.withColumn("notation", F.when(F.rand(1) < 0.01, "CC??O").otherwise(F.col("notation")))
    n = broken.where("notation = 'CC??O'").count()
    everything = {**QUICK, "train": {"early_stopping_rounds": 2, "train_size": -1}}
    with pytest.raises(ValueError, match=f"{n} rows of the training table"):
        run_job(spark, broken, test, JobParams.from_dict(everything), COLUMNS, str(tmp_path / "bad"), CODES)


def test_ensemble_keeps_test_rows_with_repeated_and_null_ids(spark, inputs, tmp_path):
    train, test = inputs
    # a third of the rows under one id, some without one, texts that differ under the same id
    which = F.col("id") % 3
    odd_id = F.when(which == 0, F.lit(7).cast("bigint")).when(F.col("id") % 10 == 1, F.lit(None).cast("bigint")).otherwise(F.col("id"))
    notation = F.element_at(F.array(*[F.lit(f) for f in FRAGMENTS]), (F.col("id") % len(FRAGMENTS) + 1).cast("int"))
    test = test.withColumn("notation", notation).withColumn("id", odd_id)
    out = str(tmp_path / "out")
    run_job(spark, train, test, JobParams.from_dict(QUICK_STACKED), COLUMNS, out, CODES)
    rows = lambda df: sorted(((r[0], round(float(r[1]), 9)) for r in df.collect()), key=str)
    want = rows(load_run(spark, out).score(test))
    assert len(want) == 100
    assert rows(spark.read.parquet(f"{out}/test_scores")) == want
    for where in (out, f"{out}/weak_learner_0", f"{out}/weak_learner_1"):
        assert spark.read.option("header", True).csv(f"{where}/submission.csv").count() == 100


def test_job_goes_on_from_its_snapshots(spark, inputs, tmp_path):
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    config = lambda rounds: JobParams.from_dict({**QUICK, "model": {**SHORT, "num_boost_round": rounds}})
    want = run_job(spark, *inputs, config(3), COLUMNS, whole, CODES)
    run_job(spark, *inputs, config(1), COLUMNS, cut, CODES)  # as if it had ended after one round
    got = run_job(spark, *inputs, config(3), COLUMNS, cut, CODES, resume=True)
    assert got.model.model.trees == want.model.model.trees and got.metrics == want.metrics
    assert spark.read.option("header", True).csv(f"{cut}/rounds.csv").count() == 3
