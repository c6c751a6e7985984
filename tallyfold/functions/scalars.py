"""Small column expressions used by several operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    Inside a lambda a column that is itself an expression would be worked out again for every element
    once the optimizer merges projections or pushes a filter down; a lambda variable never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def file_stem(path: Column) -> Column:
    """Base name of a path up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def above(score: Column, threshold: float = 0.5) -> Column:
    """Strict decision rule: a score equal to the threshold is negative."""
    return score > F.lit(threshold)


def shard_of(position: Column, shard_size: int) -> Column:
    """Floor of the quotient in whole numbers, so exact for all 64 bits; below zero too."""
    size = F.lit(shard_size).cast("bigint")
    return F.call_function("div", position.cast("bigint") - F.pmod(position.cast("bigint"), size), size)


def offset_in_shard(position: Column, shard_size: int) -> Column:
    return F.pmod(position, F.lit(shard_size)).cast("bigint")


def in_shard(position: Column, shard: int, shard_size: int) -> Column:
    """Half-open position range of one shard; constants only, so it can be pushed to the scan."""
    return (position >= F.lit(shard * shard_size)) & (position < F.lit((shard + 1) * shard_size))


def append_code(features: Column, code: Column, n_bits: int) -> Column:
    """Set positions of a feature row followed by ``(n_bits, code)`` as one more feature."""
    return F.concat(
        F.transform(features, lambda b: F.struct(b.cast("int").alias("index"), F.lit(1.0).alias("value"))),
        F.array(F.struct(F.lit(n_bits).alias("index"), code.cast("double").alias("value"))),
    )


def add_code(features: Column, code: Column, n_bits: int) -> Column:
    """Dense feature row with the code added to every position."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_bits - 1)),
        lambda i: F.array_contains(features, i).cast("double") + code.cast("double"),
    )
