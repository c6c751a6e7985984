"""Prefix trie of conversations: double-array tries of the shards, their shared upper nodes merged over all shards.

A node is a distinct sequence of first turns.  Every turn carries the running exclusive-or of hashes of (place, turn), so
a prefix has a 128-bit name wherever it occurs.  Equal conversations become one path with a count.  A node that more than
``limit`` paths run through is an *upper* node; a path is dealt by its first node below those, so all paths through any
other node meet in one shard, and a shard holds whole groups of at most ``limit`` paths.  Few nodes are upper ones: at
most (paths / limit) on each depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.llm.common import small_batches, staged
from tallyfold.operators.ranking import small_side

#: A node that fewer paths run through is never an upper node.
LEAST_LIMIT = 250
#: A task builds the trie of about this many paths at a time, of one group at least.
PATHS_AT_ONCE = 2_000
#: Upper nodes on one depth are fewer than this.
UPPER_NODES = 8_000
#: Conversation ids that are joined to one piece of text before they are hashed.
ID_RANGE = 1_024


# ------------------------------------------------------------------------------------------ turns


def ordered_turns(convs: DataFrame) -> DataFrame:
    """(conv_id, place, t1, t2, size): turns in order from 0, as a 128-bit hash of role and text and the text's bytes.

    Turns are ordered by ``turn``, null first, equal ones by the hash.  Null role or text counts as empty; rows without
    a conversation id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("second"), role, text).alias("t2"), F.octet_length(text).cast("bigint").alias("size")
    )
    along = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "t1", "t2")
    return rows.withColumn("place", F.row_number().over(along) - 1).select("conv_id", "place", "t1", "t2", "size")


def with_prefixes(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """(conv_id, depth, length, t1, t2, size, x1, x2): the root row (depth 0) and the turns of each conversation.

    ``turns`` has (conv_id, depth, t1, t2, size), depth from 1; (x1, x2) names the prefix that ends with the row.
    """
    root = conv_ids.select("conv_id", F.lit(0).alias("depth"), *[F.lit(0).cast("bigint").alias(c) for c in ("t1", "t2", "size")])
    rows = turns.select("conv_id", F.col("depth").cast("int").alias("depth"), "t1", "t2", "size").unionByName(root)
    along = Window.partitionBy("conv_id").orderBy("depth")
    name = lambda *c: F.bit_xor(F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64(*c))).over(along)
    rows = rows.withColumns({"x1": name("depth", "t1", "t2"), "x2": name("t2", "t1", "depth")})
    return rows.withColumn("length", F.max("depth").over(Window.partitionBy("conv_id")))


# ------------------------------------------------------------------------------------------ double array


class DoubleArray:
    """Trie over sorted distinct paths of dense ids: state s goes to t = base[s] + id if check[t] = s.

    ``order`` lists the states as they were made, parents first; a slot that is not taken has check -1.
    """

    TRIES = 64

    def __init__(self, paths: list[list[int]]):
        self.base, self.check, self.order = [0], [0], [0]
        self._free = 1
        waiting = [(0, 0, len(paths), 0)]
        while waiting:
            state, low, high, depth = waiting.pop()
            while low < high and len(paths[low]) == depth:  # ends here
                low += 1
            groups, at = [], low
            while at < high:
                code, start = paths[at][depth], at
                while at < high and paths[at][depth] == code:
                    at += 1
                groups.append((code, start, at))
            if not groups:
                continue
            base = self.base[state] = self._place([g[0] for g in groups])
            for code, start, end in groups:
                self.check[base + code] = state
                self.order.append(base + code)
                waiting.append((base + code, start, end, depth + 1))

    def _place(self, codes: list[int]) -> int:
        """A base at which the slots of all ``codes`` are free; these slots then exist."""
        while self._free < len(self.check) and self.check[self._free] >= 0:
            self._free += 1
        slot, first, last = self._free, codes[0], codes[-1]
        for _ in range(self.TRIES):
            while slot < len(self.check) and self.check[slot] >= 0:
                slot += 1
            base = slot - first
            if all(base + c >= len(self.check) or self.check[base + c] < 0 for c in codes[1:]):
                break
            slot += 1
        else:
            base = len(self.check) - first
        grow = base + last + 1 - len(self.check)
        if grow > 0:
            self.check += [-1] * grow
            self.base += [0] * grow
        return base

    def walk(self, path: list[int]) -> Iterator[int]:
        """States along a path, the root first; KeyError if the trie does not hold it."""
        state = 0
        yield state
        for code in path:
            nxt = self.base[state] + code
            if not 0 < nxt < len(self.check) or self.check[nxt] != state:
                raise KeyError(code)
            state = nxt
            yield state


NODES = """upper boolean, depth int, x1 bigint, x2 bigint, up1 bigint, up2 bigint, size bigint, conv_id bigint, parent bigint,
    n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends bigint"""
COLUMNS = [c.split()[0] for c in NODES.replace("\n", " ").split(",")]


def _frame(rows: list) -> pd.DataFrame:
    """Whole numbers stay whole where some are missing."""
    return pd.DataFrame(rows, columns=COLUMNS, dtype=object)


def shard_nodes(frame: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one shard.  Lower nodes are whole; of upper ones only what hangs below in this shard is known."""
    t1 = [np.asarray(x, np.int64)[1:] for x in frame["t1"]]
    t2 = [np.asarray(x, np.int64)[1:] for x in frame["t2"]]
    pairs = np.stack([np.concatenate(t1), np.concatenate(t2)], axis=1)
    _, ids = np.unique(pairs, axis=0, return_inverse=True)
    cuts = np.cumsum([len(x) for x in t1])[:-1]
    paths = [p.tolist() for p in np.split(ids.reshape(-1) + 1, cuts)]
    by_path = sorted(range(len(paths)), key=paths.__getitem__)
    trie = DoubleArray([paths[i] for i in by_path])
    size = len(trie.check)
    count, low, via, deep, ends = [0] * size, [None] * size, [0] * size, [0] * size, [None] * size
    reps, counts = frame["conv_id"].tolist(), frame["n"].tolist()
    for i in by_path:
        for depth, state in enumerate(trie.walk(paths[i])):
            count[state] += counts[i]
            low[state] = reps[i] if low[state] is None else min(low[state], reps[i])
            via[state], deep[state] = i, depth
        ends[state] = reps[i]
    # an upper node lies above the cut of its paths; where no node of a path is below the upper ones, all are upper
    cut = [2**31 if pd.isna(c) else int(c) for c in frame["cut"]]
    names1, names2, sizes = (frame[c].tolist() for c in ("x1", "x2", "size"))
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    out = []
    for state in reversed(trie.order):
        i, depth, parent = via[state], deep[state], trie.check[state]
        upper = depth < cut[i]
        if not upper:
            leaves[state] += not children[state]
            saved[state] += (count[state] - 1) * int(sizes[i][depth])
            if state:
                children[parent] += 1
                leaves[parent] += leaves[state]
                saved[parent] += saved[state]
        above = (names1[i][depth - 1], names2[i][depth - 1]) if depth else (0, 0)
        known = low[parent] if depth and depth - 1 >= cut[i] else None
        out.append((upper, depth, names1[i][depth], names2[i][depth], *above, sizes[i][depth], low[state], known, count[state], children[state], leaves[state], saved[state], ends[state]))
    return _frame(out)


def _shards(at_once: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows are sorted by shard key; whole groups are gathered until there are ``at_once`` paths."""
        held, size = [], 0
        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            size += len(frame)
            if size < at_once:
                continue
            whole = pd.concat(held, ignore_index=True)
            done = whole["shard"] != whole["shard"].iloc[-1]
            if done.any():
                yield shard_nodes(whole[done].reset_index(drop=True))
            held = [whole[~done]]
            size = len(held[0])
        if held:
            yield shard_nodes(pd.concat(held, ignore_index=True))

    return run


def _finish_upper(frame: pd.DataFrame) -> pd.DataFrame:
    """Subtree sums and parents of the merged upper nodes, deepest first; ``ends`` comes as text, as it may be null."""
    frame = frame.sort_values("depth", ascending=False)
    rows = frame.to_dict("records")
    by_name = {(r["depth"], r["x1"], r["x2"]): r for r in rows}
    for r in rows:
        r["ends"] = None if r["ends"] is None else int(r["ends"])
        r["parent"] = None
        r["n_leaves"] += r["n_children"] == 0
        r["saved"] += (r["n_convs"] - 1) * r["size"]
        if r["depth"]:
            up = by_name[r["depth"] - 1, r["up1"], r["up2"]]
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved"] += r["saved"]
            r["parent"] = up["conv_id"]
    return _frame([[r[c] for c in COLUMNS] for r in rows])


# ------------------------------------------------------------------------------------------ whole trie


def _end_digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest per path over pieces sorted by path and range; a path may go on in the next frame."""
    name, low, state = None, None, None
    for frame in frames:
        out = []
        for x1, x2, ids, first in zip(frame["x1"], frame["x2"], frame["ids"], frame["low"]):
            if (x1, x2) != name:
                if name is not None:
                    out.append((low, state.hexdigest()))
                name, low, state = (x1, x2), first, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["ends", "ends_sha256"])
    if name is not None:
        yield pd.DataFrame([(low, state.hexdigest())], columns=["ends", "ends_sha256"])


def prefix_nodes(turns: DataFrame, conv_ids: DataFrame, least: int = LEAST_LIMIT, most_upper: int = UPPER_NODES) -> DataFrame:
    """One row per trie node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` has (conv_id, depth, t1, t2, size) with depths 1, 2, … of each conversation, ``conv_ids`` one row per
    conversation; one without turns ends at the root.  ``conv_id`` is a node's smallest member; ``saved_tokens`` sums
    (n_convs - 1) times the bytes of the last text over the subtree; ``ends_sha256`` is the digest of the sorted ids that
    end at the node.  Copies of a conversation cost one row each and are never brought together but as counts and pieces
    of id text; a conversation's own turns (16 bytes each) are held by one task.  An empty table gives an empty result.
    """
    named = staged(with_prefixes(turns, conv_ids), "trie-turns")
    last = named.where("depth = length")
    paths = staged(last.groupBy("x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")), "trie-paths")
    n_paths = paths.count()
    limit = max(least, -(-n_paths // most_upper))
    rows = staged(named.join(paths.select("conv_id", "n"), "conv_id"), "trie-rows")
    upper = staged(rows.groupBy("depth", "x1", "x2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("depth", "x1", "x2"), "trie-upper")
    rows = rows.join(small_side(upper.withColumn("hot", F.lit(True)), upper.count()), ["depth", "x1", "x2"], "left")
    step = F.struct("depth", "t1", "t2", "size", "x1", "x2")
    whole = rows.groupBy("conv_id", "n").agg(
        F.min(F.when(F.col("hot").isNull(), F.struct("depth", "x1", "x2"))).alias("cut"), F.array_sort(F.collect_list(step)).alias("path")
    )
    columns = [F.col(f"path.{c}").alias(c) for c in ("t1", "t2", "size", "x1", "x2")]
    shard = F.when(F.col("cut").isNull(), F.xxhash64("conv_id")).otherwise(F.xxhash64("cut.x1", "cut.x2"))
    dealt = whole.select(shard.alias("shard"), "conv_id", "n", F.col("cut.depth").alias("cut"), *columns)
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    with small_batches(turns.sparkSession, rows=1_000):
        nodes = staged(dealt.mapInPandas(_shards(max(limit, PATHS_AT_ONCE)), NODES), "trie-nodes")
        chunk = F.floor(F.col("conv_id") / ID_RANGE).alias("range")
        pieces = last.groupBy("x1", "x2", chunk).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"), F.min("conv_id").alias("low"))
        pieces = pieces.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "range")
        ended = staged(pieces.mapInPandas(_end_digests, "ends bigint, ends_sha256 string"), "trie-ends")
    names = ["depth", "x1", "x2"]
    merged = nodes.where("upper").groupBy(*names).agg(
        *[F.max(c).alias(c) for c in ("up1", "up2", "size", "ends")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    )
    merged = merged.withColumns({"upper": F.lit(True), "ends": F.col("ends").cast("string")})
    # at most UPPER_NODES rows on a depth
    merged = staged(merged.groupBy("upper").applyInPandas(_finish_upper, NODES), "trie-merged")
    heads = small_side(merged.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("up1"), F.col("x2").alias("up2"), F.col("conv_id").alias("_head")), merged.count())
    lower = nodes.where("not upper").join(heads, ["depth", "up1", "up2"], "left").withColumn("parent", F.coalesce("parent", "_head")).select(*COLUMNS)
    nothing = hashlib.sha256().hexdigest()
    return (
        lower.unionByName(merged)
        .join(ended, "ends", "left")
        .select("conv_id", F.col("depth").cast("bigint").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    )


def rebuilt_turns(turns: DataFrame, every: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations and their ids.

    Conversation c gets the first h turns of conversation c - c % ``every``, then its own after its first h, with h the
    CRC-32 of the decimal c modulo ``modulus``.
    """
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumns({"h": F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(modulus)).cast("int"), "given": F.col("conv_id") - F.col("conv_id") % every})
    convs = staged(convs.join(convs.select(F.col("conv_id").alias("given"), F.col("n").alias("n_given")), "given", "left"), "trie-convs")
    own = turns.join(convs, "conv_id").where("place >= h").withColumn("depth", F.least("h", F.coalesce("n_given", F.lit(0))) + F.col("place") - F.col("h") + 1)
    first = turns.where(F.col("place") < modulus - 1).withColumnRenamed("conv_id", "given").join(convs.select("conv_id", "given", "h"), "given")
    first = first.where("place < h").withColumn("depth", F.col("place") + 1)
    columns = ["conv_id", "depth", "t1", "t2", "size"]
    return own.select(*columns).unionByName(first.select(*columns)), convs.select("conv_id")
