import hashlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyfold.functions.hashing import row_hash
from tallyfold.operators import ranking


def h60(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def seeded_order(ids, seed=42):
    return sorted(ids, key=lambda i: (h60(f"{seed}:{i}"), i))


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(0, 3000, 1, 7).select((F.col("id") * 3).alias("id"), (F.col("id") % 4).alias("g"))


IDS = [i * 3 for i in range(3000)]


@pytest.mark.parametrize("n", [0, 1, 17, 2999, 3000, 5000])
@pytest.mark.parametrize("levels", [1, 2])
def test_sample_n_is_exact_and_reproducible(numbers, n, levels):
    got = {r.id for r in ranking.sample_n(numbers, "id", n, levels=levels).collect()}
    assert got == set(seeded_order(IDS)[:n])


def test_sample_n_does_not_depend_on_partitioning(numbers):
    picks = [
        {r.id for r in ranking.sample_n(numbers.repartition(p), "id", 100, seed=7).collect()} for p in (1, 7)
    ]
    assert picks[0] == picks[1] == set(seeded_order(IDS, 7)[:100])


def test_sample_n_keeps_all_columns_and_does_not_shuffle_them(numbers):
    sample = ranking.sample_n(numbers, "id", 10)
    assert sample.columns == ["id", "g"]


def test_strict_sampling_raises_when_rows_run_out(numbers):
    with pytest.raises(ValueError):
        ranking.sample_n(numbers, "id", 3001, strict=True)
    with pytest.raises(ValueError):
        ranking.debug_subset(numbers, "id")
    assert ranking.debug_subset(numbers, "id", 1000).count() == 1000


def test_sampling_an_empty_table(numbers):
    assert ranking.sample_n(numbers.where("id < 0"), "id", 5).count() == 0


def test_stratified_sample(numbers):
    got = ranking.stratified_sample(numbers, "id", "g", {0: 10, 2: 5000, 3: 0, 9: 4}).collect()
    want = set()
    for g, n in ((0, 10), (2, 5000)):
        want |= set(seeded_order([i for i in IDS if i // 3 % 4 == g])[:n])
    assert {r.id for r in got} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("n", [1, 5, 700])
def test_per_group_sample(numbers, n):
    df = numbers.withColumn("g", F.when(F.col("g") != 3, F.col("g")))
    got = ranking.per_group_sample(df, "id", ["g"], n).collect()
    want = set()
    for g in range(4):
        want |= set(seeded_order([i for i in IDS if i // 3 % 4 == g])[:n])
    assert {r.id for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("n", [2, 500, 501])
def test_per_group_sample_is_exact_when_ids_repeat(rows, n):
    df = rows([(i % 7, i % 2, i % 3) for i in range(6000)], "id int, g int, v int")
    got = ranking.per_group_sample(df, "id", ["g"], n).collect()
    assert sorted(r.g for r in got) == [0] * n + [1] * n


@pytest.mark.parametrize("key_bits", [1, 10])
def test_global_ordinal(numbers, key_bits):
    got = {r.id: r.ordinal for r in ranking.global_ordinal(numbers, "id", key_bits=key_bits).collect()}
    assert got == {i: p for p, i in enumerate(IDS)}


def test_global_ordinal_on_a_skewed_key(rows):
    keys = list(range(1000)) + [10**12 + i for i in range(50)]
    got = {r.k: r.ordinal for r in ranking.global_ordinal(rows([(k,) for k in keys], "k bigint"), "k").collect()}
    assert got == {k: p for p, k in enumerate(keys)}


def test_shuffle_rank_is_a_permutation(numbers):
    got = {r.id: r.shuffle_rank for r in ranking.shuffle_rank(numbers, "id").collect()}
    assert got == {i: p + 1 for p, i in enumerate(seeded_order(IDS))}


def test_global_ordinal_of_several_columns_of_any_type(rows):
    data = [(None if i % 5 == 0 else f"k{i % 3}", i) for i in range(4000)]
    got = ranking.global_ordinal(rows(data, "k string, i int"), ["k", "i"], key_bits=4).collect()
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.ordinal)] == want


def test_cutoff_row(numbers, rows):
    assert ranking.cutoff_row(numbers, ["id"], 2900) == (Row(id=IDS[2899]), 1, 1)
    assert ranking.cutoff_row(numbers, ["id"], 3001) is None
    hot = rows([("a",)] * 50 + [("b",)] * 9000 + [(None,)] * 3, "k string")
    assert ranking.cutoff_row(hot, ["k"], 100) == (Row(k="b"), 47, 9000)
    assert ranking.cutoff_row(hot, ["k"], 3) == (Row(k=None), 3, 3)


def test_cutoffs_at_every_multiple(numbers):
    hashed = numbers.select(row_hash("id", 42, "md5").alias("_h"), F.col("id").alias("_id"))
    got = {r["rank"]: r["_id"] for r in ranking.rank_cutoffs(hashed, ["_h", "_id"], every=700).collect()}
    assert got == {r: seeded_order(IDS)[r - 1] for r in (700, 1400, 2100, 2800)}


def test_an_end_between_equal_ids_is_an_error(rows):
    df = rows([(i % 10,) for i in range(3000)], "id int")
    assert ranking.sample_n(df, "id", 600).count() == 600
    with pytest.raises(Exception, match="not unique"):
        ranking.sample_n(df, "id", 5).collect()


def test_running_totals_by_group_with_null_group(rows):
    data = [(g, i, 1 + i % 3) for i in range(200) for g in ("a", None)]
    df = rows(data, "g string, i int, v int")
    got = ranking.running_totals(df, ["i"], {"run": F.col("v")}, by=["g"], descending=True).collect()
    assert len(got) == 400
    for r in got:
        assert r.run == sum(1 + j % 3 for j in range(r.i, 200))


def test_xx_hash_gives_exact_sizes(numbers):
    assert ranking.sample_n(numbers, "id", 123, hash="xx").count() == 123
    with pytest.raises(ValueError):
        ranking.sample_n(numbers, "id", 1, hash="sha")


@pytest.mark.parametrize("n", [0, 11, 5000])
def test_first_n(numbers, n):
    assert sorted(r.id for r in ranking.first_n(numbers, "id", n).collect()) == IDS[:n]


@pytest.mark.parametrize("n", [1, 5, 2500, 9000])
def test_first_n_of_repeated_string_and_null_ids(rows, n):
    data = [(None if i % 50 == 0 else f"id{i % 9}", i % 4) for i in range(8000)]
    got = ranking.first_n(rows(data, "id string, v int"), "id", n).collect()
    want = sorted((r[0] for r in data), key=lambda k: (k is not None, k or ""))[:n]
    assert sorted((r.id for r in got), key=lambda k: (k is not None, k or "")) == want


@pytest.mark.parametrize("n", [20_000, 60_000])
def test_buckets_of_a_running_total_grow_in_number_and_not_in_size(spark, monkeypatch, n):
    monkeypatch.setattr(ranking, "SPLIT_ROWS", 200)
    # a third of the rows share one first key, some have none
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.md5(F.col("id").cast("string")))
    rows = spark.range(0, n, 1, 6).withColumn("k", key)
    path = ranking.settled(rows, "rows")
    tagged, bound = ranking.with_growing_buckets(path, ["k", "id"], "b", bits=3)
    sizes = [r["count"] for r in tagged.groupBy("b").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 3 * 200 and n / 400 < len(sizes) <= bound
    got = ranking.global_ordinal(path, ["k", "id"], key_bits=3).collect()
    want = sorted(((r.k is not None, r.k or "", r.id) for r in path.collect()))
    place = {w[2]: i for i, w in enumerate(want)}
    assert len(got) == n and all(r.ordinal == place[r.id] for r in got)


def test_growing_buckets_with_groups_and_descending_order(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SPLIT_ROWS", 50)
    rows = ranking.settled(spark.range(0, 6000, 1, 5).select((F.col("id") * 7919 % 6000).alias("s"), (F.col("id") % 3).alias("g")), "rows")
    got = ranking.running_totals(rows, ["s"], {"t": F.lit(1).cast("bigint")}, by=["g"], descending=True, key_bits=2).collect()
    for g in range(3):
        mine = sorted((r.s for r in got if r.g == g), reverse=True)
        assert {r.s: r.t for r in got if r.g == g} == {s: i + 1 for i, s in enumerate(mine)}
