"""Finite runs over growing folders.

Fingerprints and scores are row-wise projections, so the same functions accept a streaming frame.  A
run takes the files that arrived since the last one, and stops; the checkpoint remembers them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def run_available(
    spark: SparkSession,
    in_dir: str,
    schema: T.StructType | str,
    transform: Callable[[DataFrame], DataFrame],
    out_dir: str,
    checkpoint_dir: str,
    files_per_batch: int | None = None,
) -> None:
    """Apply a row-wise ``transform`` to the unseen Parquet files of ``in_dir`` and append the result."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        transform(reader.parquet(in_dir))
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
