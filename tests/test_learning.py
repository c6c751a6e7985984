import pytest
from pyspark.sql import functions as F

from tallyfold.operators import fingerprints as fp
from tallyfold.operators import learning as ln
from tallyfold.operators.metrics import binary_metrics
from tallyfold.operators.rowsets import split_train_val

PARAMS = ln.BoostParams(max_depth=3, num_boost_round=3, eta=0.3, subsample=1.0, colsample_bytree=1.0, early_stopping_rounds=2, partitions=4)


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(400).select(
        "id",
        F.array_compact(F.array(*[F.when(F.pmod(F.hash("id", F.lit(b)), F.lit(3)) == 0, F.lit(b)) for b in range(16)])).alias("bits"),
    )
    y = (F.array_contains("bits", 3) | F.array_contains("bits", 5)).cast("int")
    df = fp.bits_to_vector(df.withColumn("y", y), "bits", 16)
    df = split_train_val(df, "id")
    path = __import__("tallyfold.session", fromlist=["x"]).scratch_path(spark, "learn")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def fitted(data):
    return ln.train(data, "y", PARAMS, "id", train_curve=True)


def test_learns_the_rule(data, fitted):
    model, curve = fitted
    val = data.where("split = 'val'")
    m = binary_metrics(model.score(val), "score", "y").first()
    assert m.roc_auc > 0.9 and m.accuracy > 0.8
    assert {(r.round, r.split) for r in curve.collect()} == {(i, s) for i in range(3) for s in ("train", "val")}


def test_all_rounds_equal_the_model(data, fitted):
    model = fitted[0].model
    staged = ln.staged_margins(model, data, 3).withColumn("p", ln.probability(F.get("margins", F.lit(2))))
    whole = ln.score_rows(model, staged)
    assert whole.where("abs(p - score) > 1e-12").count() == 0
    early = ln.score_rows(model, whole, rounds=2, name="p2").withColumn("m2", ln.probability(F.get("margins", F.lit(1))))
    assert early.where("abs(p2 - m2) > 1e-12").count() == 0
    with pytest.raises(ValueError):
        ln.score_rows(model, data, rounds=9)


def test_refit_does_not_depend_on_partitioning(data, fitted):
    again = ln.fit_trees(data.where("split = 'train'").repartition(11), "y", PARAMS, "id")
    assert again.toDebugString.split("\n")[1:] == fitted[0].model.toDebugString.split("\n")[1:]


def test_stopping_keeps_only_the_rounds_that_count(data):
    params = ln.BoostParams(max_depth=2, num_boost_round=8, eta=0.3, subsample=1.0, colsample_bytree=1.0, early_stopping_rounds=1, partitions=4)
    model, curve = ln.train(data, "y", params, "id")
    assert curve.where("split = 'val'").count() == 8
    assert {r.split for r in curve.collect()} == {"val"}
    assert 1 <= model.kept_rounds <= model.model.getNumTrees == 8
    assert model.score(data).where("score between 0 and 1").count() == 400


def test_save_and_load(spark, data, fitted, tmp_path):
    fitted[0].save(str(tmp_path / "m"))
    back = ln.BoostedModel.load(str(tmp_path / "m"))
    assert (back.kept_rounds, back.best_round) == (fitted[0].kept_rounds, fitted[0].best_round)
    both = back.score(fitted[0].score(data), name="again")
    assert both.where("score <> again").count() == 0


def test_stacking_uses_one_column_per_learner(data, fitted):
    stacked = ln.stacked_features([fitted[0], fitted[0]], data)
    assert stacked.where("weak_0 = weak_1").count() == 400
    assert len(stacked.first().features) == 2


def test_alpha_warns_and_unknown_trainer_fails(data):
    with pytest.warns(UserWarning, match="alpha"):
        ln.fit_trees(data, "y", ln.BoostParams(max_depth=1, num_boost_round=1, alpha=0.1, partitions=2), "id")
    with pytest.raises(ValueError):
        ln.trainer("forest")
    assert ln.takes_vectors("ml_boosted_trees") and not ln.takes_vectors("boosted_trees")


@pytest.mark.parametrize("name, column", [("auc", "roc_auc"), ("error", "accuracy")])
def test_stopping_follows_the_metric_asked_for(data, name, column):
    params = ln.BoostParams(max_depth=2, num_boost_round=6, eta=0.3, early_stopping_rounds=2, eval_metric=name, partitions=4)
    model, curve = ln.train(data, "y", params, "id")
    by_round = {r["round"]: r[column] for r in curve.collect()}
    best = since = None
    for i in range(6):
        if best is None or by_round[i] > by_round[best]:
            best = i
        since = i
        if i - best >= 2:
            break
    assert (model.best_round, model.kept_rounds) == (best, since + 1)
    with pytest.raises(ValueError, match="eval_metric"):
        ln.BoostParams(eval_metric="rmse")


def test_external_trainer_is_gated(data):
    with pytest.raises(ImportError):
        ln.fit_external_trees(data, "y", PARAMS)


def test_external_trainer_watches_validation_rows(data, monkeypatch):
    """The package is not here: a stub takes its place and shows what it is given."""
    import sys
    import types

    given = {}

    class SparkXGBClassifier:
        def __init__(self, **settings):
            given.update(settings)

        def fit(self, df):
            given["columns"], given["rows"] = df.columns, df.count()
            return self

    stub, part = types.ModuleType("xgboost"), types.ModuleType("xgboost.spark")
    stub.__spec__, part.SparkXGBClassifier = types.SimpleNamespace(name="xgboost"), SparkXGBClassifier
    monkeypatch.setitem(sys.modules, "xgboost", stub)
    monkeypatch.setitem(sys.modules, "xgboost.spark", part)
    ln.train_external(data, "y", PARAMS, "id")
    assert given["validation_indicator_col"] == "watch" and given["early_stopping_rounds"] == 2 and given["eval_metric"] == "aucpr"
    assert given["rows"] == 400 and "watch" in given["columns"]
