import math
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import scalars
from tallyfold.operators import fingerprints as fp
from tallyfold.operators import labels, metrics, rowsets
from tallyfold.operators.ranking import settled


def brute_metrics(pairs):
    """AUC by counting pairs, AP by walking the distinct scores down."""
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap = seen = 0.0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        tp = sum(p >= s for p in pos)
        fp_ = sum(n >= s for n in neg)
        ap += (tp / len(pos) - seen) * tp / (tp + fp_)
        seen = tp / len(pos)
    acc = sum((s > 0.5) == (y == 1) for s, y in pairs) / len(pairs)
    return auc, ap, acc


@pytest.mark.parametrize("levels", [1, 2, 7, 1000])
def test_metrics_match_brute_force(rows, levels):
    rng = random.Random(levels)
    pairs = [(rng.randrange(levels) / levels, rng.randrange(2)) for _ in range(150)] + [(0.5, 0), (0.5, 1)]
    got = metrics.binary_metrics(rows(pairs, "s double, y int"), "s", "y", key_bits=3).first()
    for have, want in zip((got.roc_auc, got.average_precision, got.accuracy), brute_metrics(pairs)):
        assert have == pytest.approx(want, abs=1e-12)
    one = metrics.accuracy(rows(pairs, "s double, y int"), "s", "y").first().accuracy
    assert one == pytest.approx(brute_metrics(pairs)[2], abs=1e-12)


def test_metrics_by_group_and_partitioning(rows):
    rng = random.Random(3)
    data = [(g, rng.random() ** 8, rng.randrange(2)) for g in ("a", "b") for _ in range(90)]
    got = metrics.binary_metrics(rows(data, "g string, s double, y int", 7), "s", "y", by=["g"]).collect()
    assert len(got) == 2
    for r in got:
        want = brute_metrics([(s, y) for g, s, y in data if g == r.g])
        assert (r.roc_auc, r.average_precision, r.accuracy) == pytest.approx(want, abs=1e-12)


def test_metrics_edge_cases(rows):
    schema = "s double, y int"
    none = metrics.binary_metrics(rows([(0.3, None)], schema), "s", "y").first()
    assert (none.roc_auc, none.average_precision, none.accuracy, none.n_pos) == (None, None, None, 0)
    empty = metrics.binary_metrics(rows([], schema), "s", "y").first()
    assert empty.roc_auc is None and empty.n_neg == 0
    single = metrics.binary_metrics(rows([(0.3, 1), (0.9, 1)], schema), "s", "y").first()
    assert (single.roc_auc, single.average_precision, single.accuracy) == (None, None, 0.5)
    some = metrics.binary_metrics(rows([(0.3, 0), (0.9, 1), (0.1, None)], schema), "s", "y").first()
    assert (some.roc_auc, some.accuracy) == (1.0, 1.0)


@pytest.mark.parametrize(
    "curve, patience, want",
    [
        ([0.1, 0.2, 0.3], 2, (2, 2, 3)),
        ([0.3, 0.2, 0.3, 0.9], 2, (0, 2, 3)),
        ([0.1, 0.4, 0.2, 0.3, 0.5], 2, (1, 3, 4)),
        ([0.1, 0.4, 0.2, 0.5, 0.1], 2, (3, 4, 5)),
        ([0.5, 0.5, 0.5], 5, (0, 2, 3)),
    ],
)
def test_early_stop(rows, curve, patience, want):
    got = metrics.early_stop(rows(list(enumerate(curve)), "round int, ap double"), "round", "ap", patience).first()
    assert tuple(got) == want


# ------------------------------------------------------------------------------------------ labels


def test_class_counts_leave_out_null_and_other_labels(rows):
    df = rows([(0,), (1,), (1,), (None,), (-1,)], "y int")
    assert tuple(labels.class_counts(df, "y").first()) == (1, 2)
    assert tuple(labels.class_counts(rows([], "y int"), "y").first()) == (0, 0)


def test_imbalance_without_positives_is_an_error(rows):
    assert labels.imbalance(rows([(0,), (0,), (1,)], "y int"), "y").first().scale_pos_weight == 2.0
    with pytest.raises(Exception, match="neg / pos is undefined"):
        labels.imbalance(rows([(0,)], "y int"), "y").collect()


def test_class_weight(rows):
    got = labels.with_class_weight(rows([(0,), (0,), (1,), (None,)], "y int"), "y").collect()
    assert {(r.y, r.weight) for r in got} == {(0, 1.0), (1, 2.0), (None, 1.0)}
    fixed = labels.with_class_weight(rows([(1,)], "y int"), "y", 7).first()
    assert fixed.weight == 7.0


@pytest.mark.parametrize(
    "values, want",
    [
        ([0.0, 0.05, 0.1, 0.95, 1.0, None], [2, 1, 0, 0, 0, 0, 0, 0, 0, 2]),
        ([3.0, 3.0], [0, 0, 0, 0, 0, 2, 0, 0, 0, 0]),
        ([], [0] * 10),
        ([float(i) for i in range(11)], [1] * 9 + [2]),
        ([i / 10 for i in range(11)], None),
    ],
)
def test_histogram(rows, values, want):
    np = pytest.importorskip("numpy")
    got = [r.n for r in labels.histogram(rows([(v,) for v in values], "v double"), "v").orderBy("bin").collect()]
    clean = [v for v in values if v is not None]
    assert got == np.histogram(clean, bins=10)[0].tolist()
    assert want is None or got == want


def test_dictionary_growth_is_global(rows):
    data = [(i, ("a", "b", "zz", "y", "x")[i % 5]) for i in range(100)] + [(100, None)]
    df = rows(data, "id int, c string", 9)
    known = labels.dictionary_frame(df.sparkSession, {"a": 0, "b": 1})
    got = {r.value: r.code for r in labels.grow_dictionary(df, "c", "id", known, 2).collect()}
    assert got == {"a": 0, "b": 1, "zz": 2, "y": 3, "x": 4}
    coded = labels.encode_category(df, "c", known).where("code is null").count()
    assert coded == 61


def test_learner_count(rows):
    assert labels.learner_count(2289, 600, 700) == 2
    assert labels.learner_count(2289, -1, 700) == 3
    df = rows([(i,) for i in range(20)], "i int")
    assert tuple(labels.learner_count_table(df, 5, 4).first()) == (20, 15, 3)
    for final, weak in ((20, 1), (5, 16)):
        with pytest.raises(ValueError):
            labels.learner_count(20, final, weak)
        with pytest.raises(Exception, match="weak learner"):
            labels.learner_count_table(df, final, weak).collect()


def test_table_profile(rows):
    got = labels.table_profile(rows([(1, None), (2, "x")], "a int, `b c` string")).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(0, "a", "int", 2), (1, "b c", "string", 1)]


def test_default_label_and_unlabelled_groups(rows):
    df = rows([("a", 1), ("a", None), ("b", None), ("b", None)], "g string, y int")
    assert [tuple(r) for r in labels.unlabelled_groups(df, "g", "y").collect()] == [("b", 2, 0)]
    assert labels.with_label(df, "y").columns == ["g", "y"]
    assert {r.z for r in labels.with_label(df, "z").collect()} == {-1}


# ---------------------------------------------------------------------------------------- row sets


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(0, 1000, 1, 6).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))


@pytest.mark.parametrize("n", [0, 1, 4, 5, 999])
def test_split_is_an_exact_partition(labelled, n):
    got = rowsets.split_train_val(labelled.where(F.col("id") < n), "id").collect()
    assert len(got) == n
    assert sum(r.split == "train" for r in got) == int(0.8 * n)
    assert {r.split for r in got} <= {"train", "val"}


def test_split_does_not_depend_on_partitioning(labelled):
    sets = [{r.id for r in rowsets.split_train_val(labelled.repartition(p), "id").where("split = 'val'").collect()} for p in (1, 7)]
    assert sets[0] == sets[1]


@pytest.mark.parametrize("rows_in, size", [(1000, 300), (1000, -1), (1000, 5000), (1, -1), (0, 10), (7, 3)])
def test_cap_and_split_in_one_search(labelled, rows_in, size):
    df = labelled.where(F.col("id") < rows_in)
    got = rowsets.select_training_rows(df, "id", "y", size).collect()
    n = rows_in if size == -1 else min(rows_in, size)
    assert len({r.id for r in got}) == len(got) == n
    assert sum(r.split == "train" for r in got) == int(0.8 * n)
    capped = {r.id for r in rowsets.cap_train_size(df, "id", size).collect()}
    assert {r.id for r in got} == capped


def test_cap_top_up_and_split_in_one_pass(labelled):
    got = rowsets.select_training_rows(labelled, "id", "y", 300, add_positives=50).collect()
    capped = {r.id for r in rowsets.cap_train_size(labelled, "id", 300).collect()}
    drawn = {r.id for r in rowsets.cap_train_size(labelled.where("y = 1"), "id", 50, 43).collect()}
    assert {r.id for r in got} == capped | drawn and len(got) == len(capped | drawn)
    assert sum(r.split == "train" for r in got) == int(0.8 * len(got))


def test_top_up(labelled):
    working = rowsets.cap_train_size(labelled, "id", 300)
    got = rowsets.top_up_positives(working, labelled, "id", "y", 2.5, neg=240, pos=60)
    ids = [r.id for r in got.collect()]
    assert len(ids) == len(set(ids))
    before = {r.id for r in working.collect()}
    added = set(ids) - before
    # 240 / 2.5 - 60 = 36 drawn from all positives; the ones already in are dropped
    assert 0 < len(added) <= 36 and all(i % 5 == 0 for i in added)
    capped = rowsets.top_up_positives(working, labelled, "id", "y", 2.5, neg=240, pos=60, debug_rows=3)
    assert {r.id for r in capped.collect()} - before == set(sorted(added)[:3])


def test_top_up_is_skipped_or_refused(labelled):
    working = rowsets.cap_train_size(labelled, "id", 300)
    assert rowsets.top_up_positives(working, labelled, "id", "y", -1) is working
    assert rowsets.top_up_positives(working, labelled, "id", "y", 9.0) is working
    with pytest.raises(ValueError):
        rowsets.top_up_positives(working, labelled, "id", "y", 0.1)
    with pytest.raises(ValueError):
        rowsets.positives_wanted(5, 0, 1.0)


@pytest.mark.parametrize("final, weak", [(-1, 300), (250, 200), (999, 1), (0, 1000)])
def test_allotment_is_disjoint_and_sized(labelled, final, weak):
    got = rowsets.allot_learners(labelled.repartition(5), "id", weak, final).collect()
    assert len(got) == 1000
    pool = 1000 if final == -1 else 1000 - final
    k = pool // weak
    sizes = {}
    for r in got:
        sizes[r.learner] = sizes.get(r.learner, 0) + 1
        if r.id >= pool:
            assert r.learner == "final"
    assert {i: sizes.get(str(i)) for i in range(k)} == {i: weak for i in range(k)}
    assert sizes.get("final", 0) == 1000 - k * weak
    assert set(sizes) <= {str(i) for i in range(k)} | {"final"}


def test_filter_on_an_allotted_learner(labelled):
    dealt = rowsets.allot_learners(labelled, "id", 100, 250)
    want = {r.id for r in dealt.collect() if r.learner == "3"}
    assert {r.id for r in dealt.where(F.col("learner") == "3").collect()} == want and len(want) == 100


def test_more_than_ten_thousand_learners(rows):
    df = rows([(i,) for i in range(25_000)], "id int").select(F.concat(F.lit("r"), F.col("id")).alias("id"))
    sizes = {r.learner: r["count"] for r in rowsets.allot_learners(df, "id", 2, 999).groupBy("learner").count().collect()}
    assert sizes.pop("final") == 1000 - 1 + 1
    assert sizes == {str(i): 2 for i in range(12_000)}


def test_string_ids_are_dealt_and_coded(rows):
    df = rows([(f"r{i:04d}", f"c{i % 7}") for i in range(3000)], "id string, c string")
    got = rowsets.allot_learners(df, "id", 400, 500).collect()
    assert {r.learner for r in got if r.id >= "r2500"} == {"final"}
    assert sorted({r.learner for r in got}) == ["0", "1", "2", "3", "4", "5", "final"]
    known = labels.dictionary_frame(df.sparkSession, {"c3": 0})
    codes = {r.value: r.code for r in labels.grow_dictionary(df, "c", "id", known, 1).collect()}
    assert codes == {"c3": 0, "c0": 1, "c1": 2, "c2": 3, "c4": 4, "c5": 5, "c6": 6}


def test_id_sets(labelled):
    some = labelled.where("id < 10")
    assert rowsets.keep_ids(labelled, "id", some).count() == 10
    assert rowsets.drop_ids(labelled, "id", some).count() == 990
    assert rowsets.id_difference(labelled, some, "id").count() == 990


# ------------------------------------------------------------------------------------ fingerprints


def brute_chain(text, radius, n_bits):
    import hashlib

    words = text.split()
    bits = set()
    for i in range(len(words)):
        for k in range(radius + 1):
            s = f"{k}:" + " ".join(words[max(0, i - k) : i + k + 1])
            bits.add(int(hashlib.md5(s.encode()).hexdigest()[:15], 16) % n_bits)
    return sorted(bits)


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_token_chain(rows, radius):
    texts = ["one", "a b  c\nd a b", "", None, "x " * 50]
    got = fp.token_chain_bits(rows([(t,) for t in texts], "t string"), "t", radius, 512).collect()
    for r in got:
        assert r.bits == brute_chain(r.t or "", radius, 512)


def test_token_chain_filter_does_not_redo_work_per_word(rows):
    long = " ".join(f"w{i}" for i in range(20000))
    df = fp.token_chain_bits(rows([(long,)], "t string", 1), "t", 2, 1 << 30, hash="xx")
    assert df.where(F.size("bits") > 59000).count() == 1


def test_pattern_keys(rows):
    keys = [fp.PatternKey(5, "a", 2), fp.PatternKey(1, "b"), fp.PatternKey(9, "z")]
    got = {r.t: r.bits for r in fp.pattern_key_bits(rows([("aab",), ("ab",), ("",), (None,)], "t string"), "t", keys).collect()}
    assert got == {"aab": [1, 5], "ab": [1], "": [], None: []}


def test_bits_to_vector_keeps_positions(rows):
    got = fp.bits_to_vector(rows([([0, 3, 11],), ([],)], "bits array<int>"), "bits", 12).collect()
    for r in got:
        assert r.features.size == 12 and r.features.indices.tolist() == r.bits
        assert all(v == 1.0 for v in r.features.values)


def test_codes_join_the_feature_row(rows):
    df = rows([([0, 2], 7)], "bits array<int>, code int")
    both = df.select(
        scalars.append_code(F.col("bits"), F.col("code"), 4).alias("a"), scalars.add_code(F.col("bits"), F.col("code"), 4).alias("b")
    ).first()
    assert [tuple(x) for x in both.a] == [(0, 1.0), (2, 1.0), (4, 7.0)]
    assert both.b == [8.0, 7.0, 8.0, 7.0]


def test_dispatch():
    assert fp.featurizer("pattern_keys")
    with pytest.raises(NotImplementedError):
        fp.featurizer("unknown")


def test_user_kernel(rows):
    got = fp.user_kernel_bits(rows([("abca",), (None,)], "t string"), "t", lambda s: [ord(c) - 97 for c in s]).collect()
    assert {r.t: r.bits for r in got} == {"abca": [0, 1, 2], None: None}


def test_scalars(rows):
    df = rows([("/a/b/train.v1.parquet",)], "p string")
    assert df.select(scalars.file_stem(F.col("p"))).first()[0] == "train"
    assert not df.select(scalars.above(F.lit(0.5))).first()[0]
    assert math.isclose(df.select(scalars.let(F.lit(2), lambda v: v * v)).first()[0], 4)


def test_shards_are_exact_in_64_bits(rows):
    from tallyfold.functions.scalars import offset_in_shard, shard_of

    values = [0, 1, -1, -1000, -1001, 9007199254740993, 1152921504606846975, 2**63 - 1, -(2**63) + 1000]
    for size in (1, 3, 1000):
        got = {r.v: (r.s, r.o) for r in rows([(v,) for v in values], "v bigint").select("v", shard_of(F.col("v"), size).alias("s"), offset_in_shard(F.col("v"), size).alias("o")).collect()}
        assert got == {v: (v // size, v % size) for v in values}


def test_lookup_in_a_dictionary_too_large_to_broadcast(spark):
    n = 240_000
    value = F.when(F.col("id") % 3 == 0, F.lit("v7")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("id")))
    path = settled(spark.range(0, n, 1, 6).withColumn("c", value), "rows")
    codes = settled(spark.range(0, 200_000, 1, 6).select(F.concat(F.lit("v"), F.col("id")).alias("value"), F.col("id").cast("int").alias("code")), "codes")
    got = labels.encode_category(path, "c", codes, "code", n_codes=200_000)
    assert got.columns == ["id", "c", "code"] and "_hot" not in got.columns
    bad = F.when(F.col("c").isNull(), F.col("code").isNotNull()).otherwise(
        ~F.col("code").eqNullSafe(F.when(F.substring("c", 2, 9).cast("int") < 200_000, F.substring("c", 2, 9).cast("int")))
    )
    row = got.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(bad).alias("bad")).first()
    assert (row.n, row.ids, row.bad) == (n, n, 0)
    # the value that a third of the rows have is met in every task that reads them, and in none alone
    held = [r["count"] for r in got.where("c = 'v7'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 1 and max(held) < n / 6
    # a hot value that the dictionary does not have
    assert labels.encode_category(path, "c", codes.where("value <> 'v7'"), "code", n_codes=200_000).where("c = 'v7' and code is null").count() == n / 3 + 1
    assert labels.encode_category(path.where("id < 0"), "c", codes, "code", n_codes=200_000).count() == 0
