"""The plans keep their shape: pruned scans, pushed filters, and no shuffle where none is needed."""

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import fingerprints as fp
from tallyfold.operators import graphs, ranking, rowsets


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def outside_subqueries(df):
    """Plan lines of the main query only."""
    lines, skip = [], None
    for line in plan_of(df).splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if skip is not None and depth > skip:
            continue
        skip = depth if line.lstrip(" :+-").startswith("Subquery") else None
        if skip is None:
            lines.append(line)
    return "\n".join(lines)


def test_filter_and_columns_reach_the_scan(table):
    p = plan_of(table("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_quantity"))
    assert "EqualTo(l_returnflag,R)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in p


def test_samples_and_splits_do_not_move_rows(table):
    docs = table("documents")
    for df in (
        ranking.sample_n(docs, "doc_id", 50),
        rowsets.split_train_val(docs, "doc_id"),
        rowsets.select_training_rows(docs.withColumn("y", F.lit(1)), "doc_id", "y", 50, 10),
    ):
        main = outside_subqueries(df)
        assert "FileScan" in main and "Exchange" not in main


def test_cutoff_search_reads_ids_only(table):
    p = plan_of(ranking.sample_n(table("documents"), "doc_id", 50))
    scans = [line for line in p.splitlines() if "FileScan" in line]
    assert len(scans) >= 3
    assert sum("text" in line.split("Batched")[0] for line in scans) == 1


def test_fingerprints_are_projections(table):
    docs = table("documents")
    strings = table("part").select("p_partkey", F.lit("CCO").alias("s"))
    for df in (
        fp.token_chain_bits(docs, "text", 2, 256),
        fp.pattern_key_bits(docs, "text", fp.PROSE_KEYS),
        fp.bits_to_vector(fp.token_chain_bits(docs, "text", 1, 64), "bits", 64).select("doc_id", "features"),
        graphs.notation_bits(strings, "s", 2, 256),
    ):
        assert "Exchange" not in plan_of(df)


@pytest.mark.parametrize("n", [101, 500])
def test_group_samples_and_allotments_do_not_move_rows(table, n):
    dealt = (ranking.per_group_sample(table("events"), "event_id", ["event_type"], n), rowsets.allot_learners(table("documents"), "doc_id", 20, 50))
    for df, payload in zip(dealt, ("props#", "text#")):
        main = outside_subqueries(df)
        # the table's own rows meet the cutoffs in a broadcast join, which comes first in the plan
        assert main.index("BroadcastHashJoin") < (main + "SortMergeJoin").index("SortMergeJoin")
        moved = main.split("Exchange")
        assert all(payload not in part.split("FileScan")[0] for part in moved[1:])


def test_bounds_are_constants(table):
    lines = table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = plan_of(ranking.global_ordinal(lines, ["l_orderkey", "l_linenumber", "l_partkey"]))
    assert "percentile" not in p
    assert "ExistingRDD" in p or "LocalTableScan" in p


def test_only_small_sides_are_broadcast(rows, monkeypatch):
    side = rows([(1,)], "id int")
    assert "broadcast" in ranking.small_side(side, 10)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in ranking.small_side(side, ranking.BROADCAST_ROWS + 1)._jdf.queryExecution().logical().toString()
    assert ranking.small_side(side, None) is side


@pytest.mark.parametrize("name", ["allot_learners", "split_train_val"])
def test_no_python_in_row_selection(table, name):
    df = getattr(rowsets, name)(table("orders"), "o_orderkey", *([100] if name == "allot_learners" else []))
    assert "Python" not in plan_of(df) and "Pandas" not in plan_of(df)


def test_small_group_samples_are_cut_before_the_exchange(spark, table):
    groups = spark.range(400_000).select("id", (F.col("id") % 200_000).alias("g"))
    found = ranking.per_group_sample(groups, "id", ["g"], 1)
    assert found.count() == found.select("g").distinct().count() == 200_000
    plan = ranking.per_group_sample(table("events"), "event_id", ["event_type"], 2)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    limits = [i for i, line in enumerate(lines) if "WindowGroupLimit" in line]
    exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert any(i > exchange for i in limits)  # below the exchange: in the tasks that read the rows
    # what leaves the tasks is at most n rows per group and task
    hot = spark.range(0, 60_000, numPartitions=6).select("id", (F.col("id") % 3).alias("g"))
    sent = ranking.per_group_sample(hot, "id", ["g"], 5)
    assert sent.count() == 15
