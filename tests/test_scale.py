"""Queries do their whole job, and their costly steps are spread over the cores and read no more than they need."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tallyfold.functions.hashing import fold_distinct, md5_60
from tallyfold.operators import fingerprints as fp
from tallyfold.operators import structure as st


@pytest.fixture
def tables_of(spark, tmp_path):
    """Write small tables, one file each, and return their folder."""

    def make(**named):
        for name, df in named.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def test_stacked_scores_return_every_final_row(spark, tables_of):
    docs = [(i, f"word{i % 7} word{i % 3} common text {'good' if i % 2 else 'bad'}") for i in range(60)]
    d = tables_of(documents=spark.createDataFrame(docs, "doc_id long, text string"), labels=spark.createDataFrame([(i, i % 2) for i in range(48)], "doc_id long, quality int"))
    got = queries()["l5_f8_stacked_scores"](spark, d).collect()
    # 48 // 4 rows are kept for the final model, 48 // 3 go to each of the 2 weak learners, the rest of the pool to the final one
    assert len(got) == len({r.doc_id for r in got}) == 16
    assert all(r.in_unit and r.n_weak == 2 and r.n_rows == 16 for r in got)
    assert "doc_id" in oracle_sql()["l5_f8_stacked_scores"].rpartition("select doc_id, 2")[1]


@pytest.mark.parametrize("name", ["f9_bits_to_vector", "f5_f6_unreadable_notation", "f4_structure_key_fingerprint"])
def test_one_file_of_strings_is_spread_over_the_cores(spark, tables_of, name):
    d = tables_of(part=spark.range(1, 40).select(F.col("id").alias("p_partkey"), (F.col("id") % 10).cast("int").alias("p_size")))
    assert queries()[name](spark, d).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_placing_reads_the_bonds_of_one_atom():
    for p in st.PATTERNS:
        text = st._count_near(p, "atoms", "near")
        assert "e.src" not in text and "o.src" not in text
        assert text.count("get(near, m[") >= len(p.bonds)


@pytest.mark.parametrize("n_bits", [2, 64, 100, 256, 1 << 30])
def test_positions_from_the_last_digits_are_those_of_the_whole_hash(spark, n_bits):
    texts = [f"{i}:w{i % 40} x" for i in range(200)] + [""]
    df = spark.createDataFrame([(texts,), ([],)], "t array<string>")
    want = F.array_sort(F.array_distinct(F.transform("t", lambda t: F.pmod(md5_60(t), F.lit(n_bits)).cast("int"))))
    got = df.select(fold_distinct(F.col("t"), n_bits, "md5").alias("got"), want.alias("want")).collect()
    assert all(r.got == r.want for r in got) and got[1].got == []


def test_numbers_are_read_after_repeats_are_gone(spark):
    df = fp.token_chain_bits(spark.createDataFrame([("a b a b",)], "t string"), "t", 2, 256)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("conv(") == 1  # not once in every round


def test_positions_are_sorted_as_plain_numbers(spark):
    for hash, n_bits in (("md5", 256), ("md5", 100), ("xx", 1024)):
        df = fp.token_chain_bits(spark.createDataFrame([("a b a c d e",)], "t string"), "t", 1, n_bits, hash=hash)
        assert "array_sort(" not in df._jdf.queryExecution().toString().split("Optimized")[1]
        bits = df.first().bits
        assert bits == sorted(set(bits)) and len(bits) > 5
