"""Merkle manifest of a dataset: a postorder append log that aligned builders write, and proofs addressed by position.

Every tree has fan-out 16.  Leaves are numbered along an order; while multiple nodes remain, every 16 consecutive ones
(the last run may be shorter) become one.  Nodes are logged as they complete: a node follows the last of its children.
The position of any node then has a closed form: before leaf i complete i leaves and, on each level k, i // 16^k nodes, and
the nodes above a run's last leaf follow it at once.  So builders need not talk to each other.  Each takes an aligned block
of 16^LEVELS leaves of one tree, writes its nodes with their final positions, and hands its top node to the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import ascii_lower, staged
from tallyfold.operators.ranking import running_totals

FANOUT = 16
#: Levels that one builder raises its block by; a block has FANOUT ** LEVELS leaves.
LEVELS = 2


# ------------------------------------------------------------------------------------------ closed forms


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    h = 0
    while FANOUT**h < n:
        h += 1
    return h


def width(level: int, n: int) -> int:
    """Nodes on a level of a tree of ``n`` leaves."""
    return -(-n // FANOUT**level)


def position(level: int, index: int, n: int) -> int:
    """Place of a node in the postorder log of a tree of ``n`` leaves, from 0."""
    last = min((index + 1) * FANOUT**level, n) - 1
    done, size = last, FANOUT
    while size <= last:
        done += last // size
        size *= FANOUT
    return done + level


def log_length(n: int) -> int:
    return position(height(n), 0, n) + 1 if n else 0


def siblings(level: int, index: int, n: int) -> tuple[range, range]:
    """Indices of the others in the run of a node, to its left and to its right."""
    start = index // FANOUT * FANOUT
    return range(start, index), range(index + 1, min(start + FANOUT, width(level, n)))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ------------------------------------------------------------------------------------------ leaves


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns one after the other, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def tree_key(group: Column) -> Column:
    """Key of a group's tree: sorts like the group bytewise, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``idx``, the place within ``tree`` along ``order``, and ``n``, the leaves of the tree."""
    placed = running_totals(leaves, order, {"_place": F.lit(1).cast("bigint")}, by=["tree"])
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).select(F.col("tree").alias("_tree"), "n")
    # one row per tree; a tree that many leaves share is split by adaptive execution
    return placed.join(sizes, F.col("tree") == F.col("_tree")).drop("_tree").withColumn("idx", F.col("_place") - 1).drop("_place")


# ------------------------------------------------------------------------------------------ append log

LOG = "tree string, level int, idx bigint, pos bigint, digest string, n bigint"


def _raise_block(base: int, levels: int):
    """Builder of one aligned block whose leaves lie on level ``base``: its nodes in the order they complete."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        tree, n = rows["tree"].iloc[0], int(rows["n"].iloc[0])
        top = min(base + levels, height(n))
        out, runs = [], [[] for _ in range(top - base + 1)]

        def complete(level: int, index: int, value: str) -> None:
            out.append((tree, level, index, position(level, index, n), value, n))
            if level == top:
                return
            run = runs[level - base]
            run.append(value)
            if index % FANOUT == FANOUT - 1 or index == width(level, n) - 1:
                parent = digest(*run)
                run.clear()
                complete(level + 1, index // FANOUT, parent)

        for index, value in zip(rows["idx"].tolist(), rows["digest"]):
            complete(base, index, value)
        frame = pd.DataFrame(out, columns=["tree", "level", "idx", "pos", "digest", "n"])
        return frame[frame["level"] > base]

    return run


def leaf_position(idx: Column) -> Column:
    """Closed form of :func:`position` for leaves: the same for every tree, whatever its size."""
    return sum((F.shiftright(idx, 4 * k) for k in range(1, 16)), idx)


def append_log(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, level, idx, pos, digest, n): the nodes above the leaves of every tree's postorder log, a stored table.

    ``leaves`` has (tree, idx, n, digest); a leaf's own place is :func:`leaf_position`.  Builders take FANOUT ** levels
    nodes at a time, so a tree of any size is spread over the cluster; a round leaves one node per block, so rounds grow
    with the logarithm of the largest tree.  A tree of one leaf has no such nodes; an empty table gives an empty log.
    """
    spark = leaves.sparkSession
    tallest = height(leaves.agg(F.max("n")).first()[0] or 0)
    below = leaves.select("tree", "idx", "digest", "n")
    log = spark.createDataFrame([], LOG)
    for base in range(0, tallest, levels):
        open_ = below.where(F.col("n") > FANOUT**base).withColumn("block", F.shiftright("idx", 4 * levels))
        made = staged(open_.groupBy("tree", "block").applyInPandas(_raise_block(base, levels), LOG), f"merkle-{base}")
        log = log.unionByName(made)
        below = made.where(F.col("level") == base + levels).select("tree", "idx", "digest", "n")
    return log


def roots(leaves: DataFrame, log: DataFrame) -> DataFrame:
    """(tree, n, root): the last node of every tree's log, a lone leaf itself."""
    high = log.groupBy("tree").agg(F.max_by("digest", "level").alias("root"), F.first("n").alias("n"))
    return leaves.where("n = 1").select("tree", "n", F.col("digest").alias("root")).unionByName(high.select("tree", "n", "root"))


# ------------------------------------------------------------------------------------------ proofs

PATH = "lefts array<string>, rights array<string>, subroot string, root string"


def _paths(nodes: pd.DataFrame, above: pd.DataFrame, base: int, levels: int) -> Iterator[tuple]:
    """(row of ``nodes`` on level ``base``, lefts, rights) up to the root, siblings addressed by their log positions."""
    if not len(nodes) or not len(above):
        return
    n = int(nodes["n"].iloc[0])
    up = above.iloc[0]
    at = dict(zip(nodes["pos"].tolist(), nodes["digest"]))
    runs: dict[tuple[int, int], list[str]] = {}
    for row in nodes[nodes["level"] == base].itertuples(index=False):
        lefts, rights, j = [], [], int(row.idx)
        for level in range(base, min(base + levels, height(n))):
            run, k = divmod(j, FANOUT)
            if (level, run) not in runs:
                here = range(run * FANOUT, min((run + 1) * FANOUT, width(level, n)))
                runs[level, run] = [at[position(level, s, n)] for s in here]
            found = runs[level, run]
            lefts.append("".join(found[:k]))
            rights.append("".join(found[k + 1 :]))
            j = run
        yield row, lefts + list(up.lefts), rights + list(up.rights)


def _hand_down(base: int, levels: int):
    def run(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = [(x.tree, x.idx, left, right, above.subroot.iloc[0], above.root.iloc[0]) for x, left, right in _paths(nodes, above, base, levels)]
        return pd.DataFrame(rows, columns=["tree", "block", "lefts", "rights", "subroot", "root"])

    return run


def fold(claim: str, lefts: list[str], rights: list[str]) -> str:
    """Root that a leaf digest and its siblings lead to."""
    for left, right in zip(lefts, rights):
        claim = digest(left, claim, right)
    return claim


def _folded(levels: int):
    def run(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for x, lefts, rights in _paths(nodes, above, 0, levels):
            proof = digest(*(s for pair in zip(lefts, rights) for s in pair))
            rows.append((x.tree, x.idx, proof, fold(x.claim, lefts, rights), above.subroot.iloc[0], above.root.iloc[0]))
        return pd.DataFrame(rows, columns=["tree", "idx", "proof_sha256", "folded_root", "subroot", "root"])

    return run


def _descend(leaves: DataFrame, log: DataFrame, tops: DataFrame, levels: int, last, schema: str) -> DataFrame:
    """Hand paths down from the trees' roots, a round of blocks at a time; ``last`` handles the blocks of leaves."""
    tallest = height(leaves.agg(F.max("n")).first()[0] or 0)
    low = leaves.select("tree", F.lit(0).alias("level"), "idx", leaf_position(F.col("idx")).alias("pos"), "digest", "n", "claim")
    nodes = low.unionByName(log, allowMissingColumns=True)
    paths = None
    for base in reversed(range(0, max(tallest, 1), levels)):
        least = FANOUT**base if base else 0
        begin = tops.where((F.col("n") > least) & (F.col("n") <= FANOUT ** (base + levels)))
        above = begin.select("tree", F.lit(0).cast("bigint").alias("block"), "lefts", "rights", "subroot", "root")
        above = above if paths is None else above.unionByName(paths)
        block = F.expr(f"shiftright(idx, 4 * ({base + levels} - level))").alias("block")
        here = nodes.where((F.col("n") > least) & F.col("level").between(base, base + levels - 1)).select("*", block)
        both = here.groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
        if not base:
            return both.applyInPandas(last, schema)
        paths = staged(both.applyInPandas(_hand_down(base, levels), f"tree string, block bigint, {PATH}"), f"merkle-paths-{base}")


def forest(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Log of the groups' trees, and one row per tree with the way from its root to the root over all trees.

    ``leaves`` is a stored table (tree, idx, n, digest).  The groups' roots, ordered by ``tree``, are the leaves of one
    more tree of the same kind.
    """
    log = append_log(leaves, levels)
    subs = roots(leaves, log).select(F.lit("").alias("tree"), F.col("tree").alias("sub"), F.col("n").alias("size"), F.col("root").alias("digest"))
    subs = staged(numbered(staged(subs, "merkle-subroots"), ["sub"]).withColumn("claim", F.col("digest")), "merkle-top")
    top_log = append_log(subs, levels)
    empty = F.array().cast("array<string>")
    crown = roots(subs, top_log).select("tree", "n", empty.alias("lefts"), empty.alias("rights"), F.lit("").alias("subroot"), "root")
    found = _descend(subs, top_log, crown, levels, _hand_down(0, levels), f"tree string, block bigint, {PATH}")
    found = found.select(F.col("block").alias("idx"), "lefts", "rights", "root")
    # one row per group
    tops = subs.join(found, "idx").select(F.col("sub").alias("tree"), F.col("size").alias("n"), "lefts", "rights", F.col("digest").alias("subroot"), "root")
    return log, staged(tops, "merkle-tops")


def manifest(docs: DataFrame, id_col: str, columns: list[str], group: str, claims: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of ``docs``.

    A leaf is :func:`leaf_digest` of ``columns``; each value of ``group`` (null too) has a tree over its rows by ascending
    ``id_col`` (null first; equal ids by digest), and the trees' roots, by group, form the last tree.  ``claims`` is the
    digest that a proof is tried with, the leaf itself where it is null.  Repeated rows are leaves of their own, an empty
    table gives an empty result, other columns are ignored.
    """
    leaf = leaf_digest([F.col(c) for c in columns])
    claim = F.lit(None).cast("string") if claims is None else claims
    rows = docs.select(tree_key(F.col(group)).alias("tree"), F.col(id_col).alias("doc_id"), leaf.alias("digest"), claim.alias("claim"))
    leaves = staged(numbered(staged(rows, "merkle-leaves"), ["doc_id", "digest"]).withColumn("claim", F.coalesce("claim", "digest")), "merkle-numbered")
    log, tops = forest(leaves, levels)
    schema = "tree string, idx bigint, proof_sha256 string, folded_root string, subroot string, root string"
    proofs = _descend(leaves, log, tops, levels, _folded(levels), schema)
    joined = leaves.select("tree", "idx", "doc_id", "digest").join(proofs, ["tree", "idx"])
    return joined.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered_leaf(id_col: str, columns: list[str], text_col: str, every: int) -> Column:
    """Digest of the row with the A-Z of its text lower-cased, where ``every`` divides the CRC-32 of the decimal id; else null."""
    changed = leaf_digest([ascii_lower(F.col(c)) if c == text_col else F.col(c) for c in columns])
    return F.when(F.crc32(F.col(id_col).cast("string")) % every == 0, changed)
