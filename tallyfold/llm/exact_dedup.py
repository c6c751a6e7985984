"""Exact duplicates: two passes with a Bloom filter, so that only rows that may be repeated are shuffled."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import join_counted, staged, text_of

#: Rows whose hashes one range of the first filter takes; ranges grow in number with the rows, not in size.
RANGE = 1 << 20
BLOCK_BITS = 512
PROBES = 3
#: The second filter is broadcast; this bounds it (2^20 blocks of 64 bytes of bits: 64 MB of bits, about 120 MB as rows;
#: made for 33 million different repeated texts, however many rows there are).  Beyond that size more rows count as possible
#: repeats; the result stays exact.
MAX_BLOCKS = 1 << 20


def _dealt(ranges: int):
    """(range, hashes): a task's hashes as packed arrays, one per range; a hash met more than twice goes twice."""

    def pack(held: list[np.ndarray]) -> pd.DataFrame:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        h = np.repeat(h, np.minimum(n, 2))
        part = ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, h = part[order], h[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        return pd.DataFrame({"range": part[starts], "hashes": [x.tobytes() for x in np.split(h, starts[1:])]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            held.append(frame["_h"].to_numpy(np.int64))
            size += len(frame)
            if size >= RANGE:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    return run


def _met_twice(frame: pd.DataFrame) -> pd.DataFrame:
    """Hashes of a range all of whose bits were set by two of its hashes: first all bits are set, then each hash is tried."""
    packs = [np.frombuffer(p, np.int64).view(np.uint64) for p in frame["hashes"]]
    # as many bits per probe as there are 8 per hash; each probe has bits of its own
    width = max(10, math.ceil(math.log2(8 * sum(map(len, packs)))))
    seen, twice = np.zeros((PROBES, 1 << width), bool), np.zeros((PROBES, 1 << width), bool)
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # multipliers of public hashes

    def bits(h: np.ndarray, probe: int) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * odd[probe] >> np.uint64(64 - width)).astype(np.int64)

    for h in packs:
        for i in range(PROBES):
            at, n = np.unique(bits(h, i), return_counts=True)
            twice[i, at[(n > 1) | seen[i, at]]] = True
            seen[i, at] = True
    found = [h[np.logical_and.reduce([twice[i, bits(h, i)] for i in range(PROBES)])] for h in packs]
    return pd.DataFrame({"_h": np.unique(np.concatenate(found)).view(np.int64)})


def possible_repeats(hashes: DataFrame, n: int) -> DataFrame:
    """Hashes (column ``_h``) that may stand in two of the ``n`` rows or more, each once; those that do are all there.

    First pass: hashes are packed, 8 bytes each, into one row per task and range, so that the rows exchanged follow the
    tasks and not the table.  A range's task sets its bits one pack after the other and tells bits set once from bits set
    twice.  A text repeated a million times is sent twice per task.
    """
    packed = hashes.mapInPandas(_dealt(max(1, n // RANGE)), "range bigint, hashes binary")
    return packed.groupBy("range").applyInPandas(_met_twice, "_h bigint")


def _slots(blocks: int) -> tuple[Column, list[Column]]:
    """Block of a row's hash, and the bits it sets there, all from one 64-bit hash and its remix."""
    block = F.pmod("_h", F.lit(blocks))
    remix = F.xxhash64("_h")
    return block, [F.shiftrightunsigned(remix, 9 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(PROBES)]


def block_filter(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, words): the Bloom filter of the hashes, per block its bits as 64-bit words; empty blocks are absent."""
    block, bits = _slots(blocks)
    slots = hashes.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])

    def word(w: int) -> Column:
        # a shift by the whole bit number acts modulo 64
        each = [F.when(F.shiftright(f"b{i}", 6) == w, F.expr(f"shiftleft(1L, b{i} & 63)")).otherwise(F.lit(0).cast("bigint")) for i in range(PROBES)]
        return F.bit_or(each[0].bitwiseOR(each[1]).bitwiseOR(each[2]))

    return slots.groupBy("block").agg(*[word(w).alias(f"w{w}") for w in range(BLOCK_BITS // 64)]).select(
        "block", F.array(*[f"w{w}" for w in range(BLOCK_BITS // 64)]).alias("words")
    )


def _may_repeat(blocks: int) -> Column:
    _, bits = _slots(blocks)
    ok = F.col("words").isNotNull()
    for b in bits:
        word = F.element_at("words", F.shiftright(b, 6) + 1)
        ok = ok & (F.getbit(word, b.bitwiseAND(63)) == 1)
    return F.coalesce(ok, F.lit(False))


def split_by_filter(rows: DataFrame, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``_t`` is certainly alone, rows whose ``_t`` may be repeated), with the columns of ``rows``."""
    names = rows.columns
    keyed = rows.withColumn("_h", F.xxhash64("_t"))
    possible = staged(possible_repeats(keyed.select("_h"), rows.count()), "repeated")
    m = possible.count()
    blocks = 1
    while blocks < max_blocks and blocks * BLOCK_BITS < 16 * m:
        blocks *= 2
    # staged, as both branches read it; at most ``max_blocks`` rows, hence the broadcast
    bits = staged(block_filter(possible, blocks), "bloom").withColumnRenamed("block", "_block")
    probed = keyed.join(F.broadcast(bits), _slots(blocks)[0] == F.col("_block"), "left")
    return probed.where(~_may_repeat(blocks)).select(*names), probed.where(_may_repeat(blocks)).select(*names)


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  Of equal texts the row with the largest id stays; rows with
    a null id lose to any other; of rows equal in id and text exactly one stays.  ``keep_id`` is null when no row of the
    group has an id.  An empty table gives an empty result.  Other columns of ``docs`` are ignored.

    Rows that the filter clears never shuffle, but for 8 bytes of hash in packs.  The others are summed by (id, digest) and
    by digest before the shuffle, so a text that fills a third of the table costs one row per task in the sums; large
    groups are told their sums by broadcast.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))
    alone, repeats = split_by_filter(rows, max_blocks)
    sha = F.sha2("_t", 256).alias("text_sha256")
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), sha)
    repeats = staged(repeats.select("doc_id", sha).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("_n")), "repeats")
    groups = repeats.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.count("*").alias("_rows"))
    found = join_counted(repeats, staged(groups, "groups"), ["text_sha256"], "_rows").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)
    return alone.unionByName(found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``docs`` without the rows that :func:`exact_classes` does not keep, all columns as they are.

    Rows cleared by the filter pass straight through; only possible repeats shuffle, and their texts only where the row
    may stay.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    alone, repeats = split_by_filter(rows, max_blocks)
    repeats = repeats.select("_row", "_id", F.sha2("_t", 256).alias("_sha"))
    keep = repeats.groupBy("_sha").agg(F.max("_id").alias("_keep")).withColumnRenamed("_sha", "_g")
    # the winners' rows: one a group, but for rows repeated with their id, of which the first stays
    winners = repeats.join(keep, (F.col("_sha") == F.col("_g")) & F.col("_id").eqNullSafe(F.col("_keep")))
    return alone.select("_row.*").unionByName(winners.dropDuplicates(["_sha"]).select("_row.*"))
