import math
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import boosting as bo
from tallyfold.operators import learning as ln
from tallyfold.operators.metrics import binary_metrics
from tallyfold.session import path_exists, scratch_path

N_BITS = 12


def plain_rows(n=300, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bits = sorted(rng.sample(range(N_BITS), rng.randrange(0, 7)))
        number = round(rng.gauss(0, 2), 2)
        y = int((3 in bits) ^ (number > 0.7) or rng.random() < 0.1)
        rows.append((i, bits, [number, float(i % 4)], y, "train" if i % 5 else "val", 2.0 if y else 1.0))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    schema = "id long, in_bits array<int>, in_numbers array<double>, y int, split string, w double"
    path = scratch_path(spark, "boost")
    spark.createDataFrame(plain_rows(), schema).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def plain_tree(rows, margins, cuts, growth):
    """The same tree by loops over whole numbers: heap index -> (feature, threshold) or leaf value."""
    state = []
    for r, m in zip(rows, margins):
        if r[4] == "train":
            p = 1 / (1 + math.exp(-m))
            state.append((r, round(r[5] * (p - r[3]) * bo.FIXED), round(r[5] * p * (1 - p) * bo.FIXED)))
    soft = lambda g: math.copysign(max(abs(g) - growth.alpha, 0), g)
    quality = lambda g, h: soft(g / bo.FIXED) ** 2 / (h / bo.FIXED + growth.reg_lambda)
    tests = [(f, None) for f in range(N_BITS)] + [(N_BITS + j, c) for j, cs in enumerate(cuts) for c in cs]
    right = lambda r, t: t[0] in r[1] if t[1] is None else r[2][t[0] - N_BITS] > t[1]
    nodes = {}

    def grow(node, part, depth):
        g, h = sum(x[1] for x in part), sum(x[2] for x in part)
        best = None
        for t in tests if depth < growth.max_depth else []:
            gr, hr = (sum(x[k] for x in part if right(x[0], t)) for k in (1, 2))
            if min(hr, h - hr) / bo.FIXED < growth.min_child_weight:
                continue
            gain = quality(gr, hr) + quality(g - gr, h - hr) - quality(g, h)
            if gain > bo.LEAST_GAIN and (best is None or gain > best[0]):
                best = (gain, t)
        if best is None:
            nodes[node] = -growth.eta * soft(g / bo.FIXED) / (h / bo.FIXED + growth.reg_lambda)
            return
        nodes[node] = best[1]
        grow(2 * node + 1, [x for x in part if not right(x[0], best[1])], depth + 1)
        grow(2 * node + 2, [x for x in part if right(x[0], best[1])], depth + 1)

    grow(0, state, 0)

    def value(r):
        node = 0
        while isinstance(nodes[node], tuple):
            node = 2 * node + 1 + right(r, nodes[node])
        return nodes[node]

    return nodes, [m + value(r) for r, m in zip(rows, margins)]


@pytest.mark.parametrize("growth", [bo.Growth(max_depth=3), bo.Growth(max_depth=2, alpha=3.0, reg_lambda=0.5, eta=0.1, min_child_weight=4)], ids=["l2", "l1"])
def test_trees_equal_a_plain_grower(data, growth):
    run = bo.Boosting(data, "id", "y", "split", growth, "w", n_bits=N_BITS)
    rows, margins = plain_rows(), [0.0] * 300
    for _ in range(3):
        tree = run.step()
        nodes, margins = plain_tree(rows, margins, run.cuts, growth)
        for node, want in nodes.items():
            if isinstance(want, tuple):
                assert tree.feature[node] == want[0]
                assert want[1] is None or tree.threshold[node] == want[1]
            else:
                assert tree.feature[node] == -1 and tree.value[node] == pytest.approx(want, abs=1e-12)
    got = {r.row_id: r.margin for r in run.state.collect()}
    assert [got[i] for i in range(300)] == pytest.approx(margins, abs=1e-12)
    # the scoring pass walks the same trees
    scored = {r.id: r for r in run.model.score(data).withColumn("m", run.model.margins()).collect()}
    assert all(scored[i].m[-1] == pytest.approx(margins[i], abs=1e-12) for i in range(300))
    assert all(scored[i].score == pytest.approx(1 / (1 + math.exp(-margins[i])), abs=1e-12) for i in range(300))
    early = {r.id: r.score for r in run.model.score(data, rounds=2).collect()}
    assert all(early[i] == pytest.approx(1 / (1 + math.exp(-scored[i].m[1])), abs=1e-12) for i in range(300))
    run.close()
    assert not path_exists(data.sparkSession, run.path)


def test_l1_penalty_shrinks_leaves(data):
    size = lambda alpha: sum(abs(v) for v in bo.Boosting(data, "id", "y", "split", bo.Growth(max_depth=2, alpha=alpha)).step().value)
    assert size(0.0) > size(5.0) > size(1000.0) == 0.0


PARAMS = ln.BoostParams(max_depth=2, num_boost_round=12, eta=0.5, subsample=0.8, colsample_bytree=0.7, early_stopping_rounds=2, eval_metric="auc")


def curve_rows(df):
    return {(r["round"], r["split"]): tuple(round(r[m], 9) for m in ("roc_auc", "average_precision", "accuracy")) for r in df.collect()}


def test_stops_while_growing_and_goes_on_from_a_snapshot(spark, data, tmp_path):
    whole, curve = ln.train_rounds(data, "y", PARAMS, "id", weight="w", train_curve=True, snapshots=str(tmp_path / "a"))
    val = {r: v[0] for (r, s), v in curve_rows(curve).items() if s == "val"}
    best = 0
    for r in sorted(val):
        best = r if val[r] > val[best] else best
        assert (r - best >= 2) == (r == max(val))  # the last round grown is the one where patience ran out
    assert whole.model.n_rounds == whole.kept_rounds == max(val) + 1 < 12 and whole.best_round == best
    assert curve_rows(ln.curve_of_rounds(whole.model, data, "y", "split")) == curve_rows(curve)
    saved = bo.BitTreeModel.load(str(tmp_path / "a"))
    assert saved.trees == whole.model.trees
    saved.trees = saved.trees[:1]  # as if the run had ended after its first round
    saved.save(str(tmp_path / "b"))
    again, second = ln.train_rounds(data, "y", PARAMS, "id", weight="w", train_curve=True, snapshots=str(tmp_path / "b"), resume=str(tmp_path / "b"))
    assert again.model.trees == whole.model.trees and curve_rows(second) == curve_rows(curve)
    assert bo.BitTreeModel.load(str(tmp_path / "b")).trees == whole.model.trees
    # neither partitions nor the order of rows matter
    other, _ = ln.train_rounds(data.repartition(7).orderBy(F.desc("id")), "y", PARAMS, "id", weight="w")
    assert [(t.feature, t.value) for t in other.model.trees] == [(t.feature, t.value) for t in whole.model.trees]


def test_rows_collapse_to_leaf_patterns_before_rounds_unfold(data):
    model, _ = ln.train_rounds(data, "y", ln.BoostParams(max_depth=1, num_boost_round=4, early_stopping_rounds=None), "id")
    patterns = ln.leaf_patterns(model.model, data, "y", "split")
    assert patterns.agg(F.sum("n")).first()[0] == 300
    assert patterns.count() <= 2**4 * 4 < 300  # leaves of four stumps, two labels, two splits


def test_odd_inputs(spark, data):
    odd = data.withColumn("y", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("y"))).withColumn("in_bits", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("in_bits")))
    odd = odd.withColumn("in_numbers", F.transform("in_numbers", lambda x: F.when(F.col("id") % 7 > 0, x)))
    model, curve = ln.train_rounds(odd, "y", ln.BoostParams(max_depth=2, num_boost_round=2), "id")
    assert model.score(odd).where("score between 0 and 1").count() == 300
    assert model.score(odd.where("id < 0")).count() == 0
    assert curve.count() == 2
    one_class = data.withColumn("y", F.lit(1))
    model, curve = ln.train_rounds(one_class, "y", ln.BoostParams(max_depth=2, num_boost_round=2), "id")
    assert model.score(data).select("score").distinct().count() == 1 and curve.first().roc_auc is None
    with pytest.raises(ValueError):
        model.score(data, rounds=99)
    with pytest.raises(ValueError):
        bo.Boosting(data, "id", "y", "split", bo.Growth(), max_bins=300)


def test_learns_and_saves(spark, data, tmp_path):
    model, _ = ln.train_rounds(data, "y", ln.BoostParams(max_depth=4, num_boost_round=6, eta=0.5, subsample=1.0, colsample_bytree=1.0), "id")
    assert binary_metrics(model.score(data), "score", "y").first().roc_auc > 0.9
    model.save(str(tmp_path / "m"))
    back = ln.BoostedModel.load(str(tmp_path / "m"))
    assert back == model
    stacked = ln.stacked_features([model, back], data)
    assert stacked.where("in_numbers[0] = in_numbers[1] and size(in_bits) = 0").count() == 300


def test_weighted_counts_equal_repeated_rows(spark):
    rows = [(0.1 * (i % 7), i % 2, i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "score double, y int, n int")
    many = df.withColumn("_i", F.explode(F.expr("if(n > 0, sequence(1, n), array())")))
    assert binary_metrics(df, "score", "y", times="n").first() == binary_metrics(many, "score", "y").first()
    assert binary_metrics(many, "score", "y", bucket=F.floor(F.col("score") * 4)).first() == binary_metrics(many, "score", "y").first()
