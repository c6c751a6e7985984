import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyfold.session import scratch_path, shared_dir, spread
from tallyfold.sources import tables


def test_row_groups_of_fixed_size(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(2289).coalesce(1), path, rows_per_group=500)
    got = tables.row_group_profile(spark, path).orderBy("row_group").collect()
    assert [r.n_rows for r in got] == [500, 500, 500, 500, 289]
    assert all(r.n_bytes > 0 for r in got)
    file = got[0].file.removeprefix("file:").replace("///", "/")
    assert pq.ParquetFile(file).metadata.num_row_groups == 5


def test_rows_per_file(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(100).coalesce(1), path, rows_per_file=30)
    assert sorted(r.n_rows for r in tables.storage_profile(spark.read.parquet(path)).collect()) == [10, 30, 30, 30]


def test_row_index_over_several_ragged_files(spark, tmp_path):
    for i, n in enumerate((7, 1, 30)):
        spark.range(n).select((F.col("id") + 100 * i).alias("v")).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    df = tables.read_table(spark, [str(tmp_path / f"p{i}") for i in range(3)])
    got = {r.v: r.row_index for r in tables.with_row_index(df).collect()}
    want = [100 * i + j for i, n in enumerate((7, 1, 30)) for j in range(n)]
    assert got == {v: p for p, v in enumerate(want)}
    picked = tables.read_shards(df, [0, 3], 10).collect()
    assert sorted(r.row_index for r in picked) == [*range(10), *range(30, 38)]


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    tables.write_csv(spark.createDataFrame([(1, "a,b", 0.1), (2, 'q"q', 1e-9)], "id bigint, s string, x double"), path)
    typed = tables.read_csv(spark, path, "id bigint, s string, x double")
    assert sorted(tuple(r) for r in typed.collect()) == [(1, "a,b", 0.1), (2, 'q"q', 1e-9)]
    assert dict(tables.read_csv(spark, path).dtypes)["x"] == "double"


def test_dictionary(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"north": 0,\n "east": 1, "south": 2}')
    got = {r.value: r.code for r in tables.read_dictionary(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"north": 0, "east": 1, "south": 2}


def test_membership_is_pruned_by_set(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.range(50).select("id", F.when(F.col("id") < 40, "train").otherwise("val").alias("split"))
    tables.write_membership(df, path, "id", ["split"])
    val = tables.read_membership(spark, path, split="val")
    assert {r.id for r in val.collect()} == set(range(40, 50))
    assert "PartitionFilters: [isnotnull(split" in val._jdf.queryExecution().executedPlan().toString()


def test_submission_keeps_input_order(spark, tmp_path):
    scored = spark.range(500).select("id", (F.col("id") / 500).alias("score"), (500 - F.col("id")).alias("pos")).repartition(5)
    path = str(tmp_path / "s")
    tables.write_csv(tables.submission(scored, "id", "score", "active", order="pos").coalesce(1), path)
    got = spark.read.option("header", True).csv(path).collect()
    assert [int(r.id) for r in got] == list(range(499, -1, -1))
    assert tables.metrics_path("/o/", "/x/train.parquet") == "/o/train_metrics.csv"


def test_missing_columns_fail_before_any_job(spark):
    with pytest.raises(ValueError, match="missing columns"):
        tables.require_columns(spark.range(1), ["id", "y"])


def test_scratch_paths_are_new_each_time(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))


def test_spread_leaves_wide_scans_alone(spark, tmp_path):
    spark.range(100).repartition(16).write.parquet(str(tmp_path / "w"))
    wide = spark.read.parquet(str(tmp_path / "w"))
    assert spread(wide) is wide
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "n"))
    narrow = spread(spark.read.parquet(str(tmp_path / "n")))
    assert narrow.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_scratch_is_dropped_on_request(rows):
    from pyspark.sql import SparkSession

    from tallyfold.session import drop_scratch, scratch_path

    # a session of its own folder would be needed to drop it here; a name under it is enough to see where it lies
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "x")
    rows([(1,)], "i int").write.parquet(path)
    assert f"scratch-{spark.sparkContext.applicationId}/x-" in path
    assert spark.read.parquet(path).count() == 1 and callable(drop_scratch)


def test_split_profile_covers_every_row_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000).select("id", F.repeat(F.lit("x"), 50).alias("s")).repartition(2).write.option("parquet.block.row.count.limit", 1000).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = tables.split_profile(spark.read.parquet(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by_file = {}
    for r in found:
        assert r.n_rows == r.last_row - r.first_row + 1
        by_file.setdefault(r.file, []).append((r.first_row, r.last_row))
    assert len(by_file) == 2 and len(found) > 4
    for runs in by_file.values():
        runs.sort()
        assert runs[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(runs, runs[1:]))
    assert sum(r.n_rows for r in found) == 20_000


def test_only_files_that_hold_the_shards_are_read(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "sharded")
    spark.range(0, 40_000, numPartitions=3).withColumn("s", F.repeat(F.lit("x"), 20)).write.parquet(src)
    tables.write_sharded(spark.read.parquet(src), path, 500, files=20)
    whole = len(spark.read.parquet(path).inputFiles())
    for shards in ([3], [0, 79], [5, 6, 7], [900], []):
        got = tables.read_sharded(spark, path, shards)
        want = tables.read_shards(spark.read.parquet(src), shards, 500) if shards else got
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert whole == 20 and len(got.inputFiles()) <= (3 * len(shards) if shards not in ([900], []) else 20)
    assert len(tables.read_sharded(spark, path, [3]).inputFiles()) <= 2
