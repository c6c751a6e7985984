"""Row and token hashing.

``md5`` is the portable choice: any SQL engine can recompute the first 15 hex digits of an md5, so
samples, splits and fingerprints can be checked outside Spark.  ``xx`` is about twice as fast and
stays inside Spark.  Both give a non-negative 60-bit integer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def md5_60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def xx_60(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 4)


HASHES: dict[str, Callable[[Column], Column]] = {"md5": md5_60, "xx": xx_60}


def hasher(name: str) -> Callable[[Column], Column]:
    if name not in HASHES:
        raise ValueError(f"unknown hash {name!r}; choose one of {sorted(HASHES)}")
    return HASHES[name]


def row_hash(row_id: str | Column, seed: int, hash: str = "md5") -> Column:
    """Seeded hash of a row id: its order is a reproducible random permutation of the rows."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return hasher(hash)(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def fold(h: Column, n_bits: int) -> Column:
    """Fold a hash to a bit position in ``[0, n_bits)``."""
    return F.pmod(h, F.lit(n_bits)).cast("int")


def fold_distinct(texts: Column, n_bits: int, hash: str) -> Column:
    """Ascending distinct bit positions of the hashes of an array of texts.

    The last hex digits alone tell an md5's position where ``n_bits`` is a power of two: repeats go before digits are
    read as numbers, so at most ``n_bits`` short strings are read for a text of any length.  Positions are sorted as
    plain numbers by ``sort_array``; ``array_sort`` would work out its comparator for every two of them.
    """
    if hash == "md5" and n_bits > 1 and n_bits & (n_bits - 1) == 0 and n_bits <= 1 << 31:
        digits = -(-(n_bits.bit_length() - 1) // 4)
        tails = F.array_distinct(F.transform(texts, lambda t: F.substring(F.md5(t), HASH_BITS // 4 + 1 - digits, digits)))
        bits = F.transform(tails, lambda t: fold(F.conv(t, 16, 10).cast("bigint"), n_bits))
        if n_bits == 1 << 4 * digits:  # different digits are different positions
            return F.sort_array(bits)
    else:
        h = hasher(hash)
        bits = F.transform(texts, lambda t: fold(h(t), n_bits))
    return F.sort_array(F.array_distinct(bits))
