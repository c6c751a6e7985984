"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyfold.functions.scalars import shard_of

# ---------------------------------------------------------------------------------------- sources


def read_table(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet file, folder or list of them."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail before any job runs when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df


def row_count(df: DataFrame) -> DataFrame:
    """One row ``n_rows``; reads no column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0-based position of every row in its file; over several files, in order of file name.

    ``df`` must be a plain Parquet scan.
    """
    n_files = len(df.inputFiles())
    if n_files <= 1:
        return df.select("*", F.col("_metadata.row_index").alias(name))
    scan = df.select("*", F.col("_metadata.row_index").alias("_in_file"), F.col("_metadata.file_path").alias("_file"))
    before = Window.partitionBy(F.lit(1)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        scan.groupBy("_file")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    # one row per file, and the driver holds the listing already
    return scan.join(F.broadcast(offsets), "_file").select(
        *df.columns, (F.col("_before") + F.col("_in_file")).alias(name)
    )


def read_shards(df: DataFrame, shards: Sequence[int], shard_size: int) -> DataFrame:
    """Rows of the chosen shards: consecutive runs of ``shard_size`` rows in file order."""
    indexed = with_row_index(df)
    return indexed.where(shard_of(F.col("row_index"), shard_size).isin(list(shards)))


ZONES = "_zones"


def write_sharded(df: DataFrame, path: str, shard_size: int, files: int | None = None) -> None:
    """Write a plain Parquet scan so that single shards can be read alone.

    Rows are laid out in ranges of their position (column ``row_index``), one range a file, and a zone map beside them
    tells the first and last shard of each file: one row per file.
    """
    indexed = with_row_index(df).withColumn("_shard", shard_of(F.col("row_index"), shard_size))
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    indexed.repartitionByRange(n, "row_index").sortWithinPartitions("row_index").write.parquet(path)
    at = df.sparkSession.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), "_shard")
    at.groupBy("file").agg(F.min("_shard").alias("first"), F.max("_shard").alias("last")).coalesce(1).write.parquet(f"{path}/{ZONES}")


def read_sharded(spark: SparkSession, path: str, shards: Sequence[int]) -> DataFrame:
    """The chosen shards of :func:`write_sharded`, from the files that hold some of their rows and no others."""
    zones = spark.read.parquet(f"{path}/{ZONES}")
    wanted = F.array(*[F.lit(s).cast("bigint") for s in shards]) if shards else F.array().cast("array<bigint>")
    hit = F.exists(wanted, lambda s: s.between(F.col("first"), F.col("last")))
    files = [r.file for r in zones.where(hit).select("file").collect()]  # a part of the listing the driver holds anyway
    whole = spark.read.parquet(path)
    rows = spark.read.schema(whole.schema).parquet(*files) if files else whole.where(F.lit(False))
    return rows.where(F.array_contains(wanted, F.col("_shard").cast("bigint"))).drop("_shard")


def storage_profile(df: DataFrame) -> DataFrame:
    """Rows per file split of a plain Parquet scan, as Spark reads it."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start")]
    return df.select(*where).groupBy("file", "split_start").agg(F.count(F.lit(1)).alias("n_rows"))


def split_profile(df: DataFrame) -> DataFrame:
    """Which rows each split of each file holds: ``file, split_start, first_row, last_row, n_rows``.

    A split holds whole row groups, so its rows follow each other: ``n_rows`` is their distance.  ``df`` must be a plain
    Parquet scan; no column is read, and counts are added up map-side.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start"), F.col("_metadata.row_index").alias("_i")]
    rows = df.select(*where).groupBy("file", "split_start")
    return rows.agg(F.min("_i").alias("first_row"), F.max("_i").alias("last_row"), F.count(F.lit(1)).alias("n_rows"))


def row_group_profile(spark: SparkSession, path: str) -> DataFrame:
    """Rows per Parquet row group, from the footers alone; executors read one footer per file."""
    schema = "file string, row_group int, n_rows bigint, n_bytes bigint"

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for file in batch["path"]:
                system, inner = fs.FileSystem.from_uri(file)
                meta = pq.read_metadata(inner, filesystem=system)
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                yield pd.DataFrame(
                    {
                        "file": file,
                        "row_group": range(len(groups)),
                        "n_rows": [g.num_rows for g in groups],
                        "n_bytes": [g.total_byte_size for g in groups],
                    }
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.mapInPandas(footers, schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; types are inferred only when no schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``value, code`` table from a JSON object of names and integers."""
    entries = F.from_json("value", "map<string,int>")
    return spark.read.text(path, wholetext=True).select(F.explode(entries).alias("value", "code"))


# ------------------------------------------------------------------------------------------ sinks


def write_table(
    df: DataFrame,
    path: str,
    rows_per_group: int | None = None,
    rows_per_file: int | None = None,
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Parquet sink; ``rows_per_group`` caps the rows of a row group, ``rows_per_file`` those of a file."""
    writer = df.write.mode(mode)
    if rows_per_group:
        writer = writer.option("parquet.block.row.count.limit", rows_per_group)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV sink with a header and no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_membership(df: DataFrame, path: str, row_id: str, by: Sequence[str], mode: str = "errorifexists") -> None:
    """Row ids laid out by the sets they belong to, so reading one set reads only its folder."""
    write_table(df.select(row_id, *by), path, partition_by=by, mode=mode)


def read_membership(spark: SparkSession, path: str, **sets: str) -> DataFrame:
    """Ids of the named sets, e.g. ``split="val"``."""
    df = spark.read.option("recursiveFileLookup", False).parquet(path)
    for column, value in sets.items():
        df = df.where(F.col(column) == value)
    return df


def submission(scored: DataFrame, row_id: str, score: str, label: str, order: str | None = None) -> DataFrame:
    """``id, label`` table of scores, in input order when an order column is named."""
    out = scored.orderBy(order) if order else scored
    return out.select(F.col(row_id).alias("id"), F.col(score).alias(label))


def metrics_path(out_dir: str, input_path: str) -> str:
    """``{out_dir}/{input stem}_metrics.csv``."""
    stem = input_path.rsplit("/", 1)[-1].split(".", 1)[0]
    return f"{out_dir.rstrip('/')}/{stem}_metrics.csv"
