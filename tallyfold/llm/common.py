"""Helpers the operators share: staged tables, columns that may clash, exact positions, bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.session import scratch_path
from tallyfold.sources.tables import read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(col: str | Column = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def id_key(col: Column) -> Column:
    """An id of any type as text that is never null and tells a null id from every other."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("null"))


#: A key with more than one row in this many counts as hot, so there are at most this many hot keys.
HOT_KEYS = 10_000


def join_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` with the columns of ``per_key`` (one row per key, no null keys), rows without a partner left out.

    ``count`` says how many rows of ``rows`` a key has.  Hot keys are at most ``HOT_KEYS`` by their definition: they are
    broadcast, and their rows stay where they are.  Each other key has one row in ``HOT_KEYS`` at most, so no task
    meets many of them for one key.  Both sides should be stored, as they are read twice.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * F.lit(HOT_KEYS) > F.lit(total)
    few = F.broadcast(per_key.where(hot))
    names = F.broadcast(per_key.where(hot).select(*keys))
    return rows.join(few, keys).unionByName(rows.join(names, keys, "left_anti").join(per_key.where(~hot), keys))


def within(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with the value computed once, however often it is used (it becomes a lambda variable)."""
    return F.transform(F.array(value), make)[0]


def hex64(col: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(col))), 16, "0")


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m", rows: int = 2_000) -> Iterator[None]:
    """Hand rows with whole texts to Python workers in small Arrow batches while a table is staged inside.

    A batch stands several times in an executor's memory (writer, socket, worker), beside the heap.
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def worker_cached(key: str, make: Callable):
    """One object per Python worker and key: tasks that follow in the same worker find it again."""
    import __main__

    cache = __main__.__dict__.setdefault("_tallyfold_llm", {})
    if key not in cache:
        cache[key] = make()
    return cache[key]


def doc_batches(batches: Iterable[pd.DataFrame], chars: int, text: str = "text") -> Iterator[pd.DataFrame]:
    """Cut incoming frames so that each piece holds about ``chars`` characters, or one row if that is longer."""
    for frame in batches:
        if not len(frame):
            continue
        group = np.cumsum(frame[text].str.len().to_numpy(np.int64)) // chars
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(frame)]):
            yield frame.iloc[a:b]


def running_start(df: DataFrame, by: list[str], order: list[str], value: str, out: str, buckets: int = 256) -> DataFrame:
    """Exact exclusive running sum of ``value`` within ``by``, in the order ``_key`` (a spread 64-bit hash), ``order``.

    ``by`` must not hold nulls.  A key with a large part of all rows is no burden: rows are dealt by the leading bits of ``_key`` as well, the sums
    of these buckets are added up first, and only then rows are ordered inside a bucket.
    """
    bucket = F.shiftrightunsigned("_key", 32) * F.lit(buckets)
    df = df.withColumn("_bucket", F.shiftrightunsigned(bucket, 32).cast("int"))
    # dealt by bucket explicitly, as rows already dealt by the key alone would stay there; equal keys go by a second hash
    df = df.repartition(*by, "_bucket")
    sums = df.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.shiftrightunsigned("_key", 1), "_key", *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = placed.join(bases, [*by, "_bucket"])
    return joined.withColumn(out, F.col("_base") + F.col("_in")).drop("_bucket", "_in", "_base")
