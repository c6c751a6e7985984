"""Near duplicates by SimHash: fingerprints, a Gray-order hierarchical index, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import doc_batches, id_key, small_batches, staged, text_of
from tallyfold.llm.components import connected_components
from tallyfold.operators.ranking import BROADCAST_ROWS

SEED = 42
BITS = 64
#: Rows of the index are handled in units of at most two blocks of this many fingerprints.
BLOCK = 32_768
FANOUT = 16


# ------------------------------------------------------------------------------------------- fingerprints


def fingerprints_of(texts: Iterable[str], words: int) -> np.ndarray:
    """Signed 64-bit SimHash of each text; see :func:`fingerprints`."""
    import xxhash

    out = np.zeros(0, np.int64)
    made = []
    for text in texts:
        tokens = text.encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            made.append(0)
            continue
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        k = min(words, len(tokens))
        begin = np.concatenate([[0], ends[: len(tokens) - k] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        total, half = np.zeros(BITS, np.int64), len(begin)
        stops = ends[k - 1 :].tolist()
        for at in range(0, len(begin), 65_536):  # bounded memory for very long texts
            h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin[at : at + 65_536], stops[at : at + 65_536])), np.uint64)
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        made.append(int(np.packbits((2 * total > half).astype(np.uint8), bitorder="little").view(np.int64)[0]))
    return np.array(made, np.int64) if made else out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): SimHash of the whole text over word shingles, repeats included.

    A-Z are lower-cased; words are separated by ASCII white space; a shingle is ``words`` words joined by a blank, the
    whole sequence if the text has fewer.  Bit b is set if more than half of the shingles' XXH64 (seed 42) have it.
    Null and empty texts have fingerprint zero.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in doc_batches(frames, 1_000_000):
            yield frame[["doc_id", "text_hash"]].assign(fp=fingerprints_of(frame["text"], words))

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("text_hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, text_hash bigint, fp bigint")


# -------------------------------------------------------------------------- Gray-order hierarchical index


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray code; neighbours in this order differ in few leading bits."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _runs(unit: np.ndarray) -> np.ndarray:
    """First rows of runs of up to FANOUT neighbours that do not cross a unit."""
    begin = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    within = np.arange(len(unit)) - np.repeat(begin, np.diff(np.append(begin, len(unit))))
    return np.flatnonzero(within % FANOUT == 0)


class GrayIndex:
    """Hierarchy over fingerprints sorted by (unit, Gray rank).

    Level 0 are the fingerprints; a node of the next level stands for up to FANOUT neighbours of one unit and holds
    the bit pattern they share: a mask and the bits under it.  Two nodes can only hold fingerprints within ``most``
    bits of each other if their patterns differ in at most ``most`` bits that both masks have, so whole groups are
    pruned by the differences added up so far.
    """

    def __init__(self, fp: np.ndarray, unit: np.ndarray):
        full = np.full(len(fp), ~np.uint64(0))
        self.levels = [(fp, full, unit, None)]
        while len(self.levels[-1][0]) > len(np.unique(self.levels[-1][2])):
            bits, mask, unit, _ = self.levels[-1]
            at = _runs(unit)
            both = np.bitwise_and.reduceat(bits, at)
            some = np.bitwise_or.reduceat(bits, at)
            shared = np.bitwise_and.reduceat(mask, at) & ~(both ^ some)
            self.levels.append((both & shared, shared, unit[at], np.append(at, len(bits))))

    def pairs(self, most: int, step: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every pair (i < j) of rows of one unit that differ in ``most`` bits or fewer, in slices of bounded size."""
        top = np.arange(len(self.levels[-1][0]))
        yield from self._below(len(self.levels) - 1, top, top, most, step)

    def _below(self, level: int, a: np.ndarray, b: np.ndarray, most: int, step: int):
        if level == 0:
            keep = a < b
            yield a[keep], b[keep]
            return
        bits, mask, _, _ = self.levels[level - 1]
        cuts = self.levels[level][3]
        size = np.diff(cuts)
        made = size[a] * size[b]
        total = np.append(0, np.cumsum(made))
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(total, total[at] + step, "right")) - 1)
            n = made[at:to]
            pair = np.repeat(np.arange(at, to), n)
            k = np.arange(total[to] - total[at]) - np.repeat(total[at:to] - total[at], n)
            width = size[b[pair]]
            x, y = cuts[a[pair]] + k // width, cuts[b[pair]] + k % width
            # of a node against itself each pair of children counts once
            near = (x <= y) & (np.bitwise_count((bits[x] ^ bits[y]) & mask[x] & mask[y]) <= most)
            yield from self._below(level - 1, x[near], y[near], most, step)
            at = to


def union_links(n: int, slices: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row each row reaches, over links that come in slices."""
    root = np.arange(n)
    for a, b in slices:
        while True:
            x, y = root[a], root[b]
            split = x != y
            if not split.any():
                break
            a, b, x, y = a[split], b[split], x[split], y[split]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _link_units(most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames are sorted by unit; rows of a unit may go on in the next frame."""
        held = []
        size = 0

        def links(frame: pd.DataFrame) -> pd.DataFrame:
            code, _ = pd.factorize(frame["unit"])
            fp = frame["fp"].to_numpy(np.int64).view(np.uint64)
            order = np.lexsort((gray_rank(fp), code))
            node = frame["node"].to_numpy()[order]
            unit = code[order]
            # inside a unit, a smaller node is a better root: renumber rows by node for the union
            rank = np.empty(len(node), np.int64)
            rank[np.argsort(node, kind="stable")] = np.arange(len(node))
            by_rank = np.sort(node, kind="stable")
            slices = ((rank[a], rank[b]) for a, b in GrayIndex(fp[order], unit).pairs(most))
            root = union_links(len(node), slices)
            moved = np.flatnonzero(root != np.arange(len(node)))
            return pd.DataFrame({"src": by_rank[moved], "dst": by_rank[root[moved]]}).query("src != dst")

        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            size += len(frame)
            if size < 2 * BLOCK:
                continue
            whole = pd.concat(held)
            last = whole["unit"].iloc[-1]
            done = (whole["unit"] != last).to_numpy()
            if done.any():
                yield links(whole[done])
            held = [whole[~done]]
            size = len(held[0])
        if held:
            yield links(pd.concat(held))

    return run


def hamming_links(nodes: DataFrame, most: int = 3, block: int = BLOCK, spare: int = 1) -> DataFrame:
    """Links (src, dst) that connect all ``nodes`` (node, fp; fp distinct) within ``most`` bits of each other.

    The root level of the index is a shared pattern of ``spare`` out of ``most + spare`` blocks of bits: two
    fingerprints within ``most`` bits agree in at least one such choice of blocks, so nothing is lost.  The fingerprints
    that agree there form one unit with a Gray-order hierarchy of its own, and units are spread over the cluster.
    (One spare block gives 4 copies of each fingerprint and patterns of 16 bits for 3 bits; two give 10 copies and
    patterns of 25 bits, for tens of billions of fingerprints.)  A unit of more than ``block`` fingerprints is cut by
    hash and each pair of its cuts becomes a unit, so no task ever holds more than two of them at a time.  Of each unit
    only a spanning set of links is returned.
    """
    blocks = most + spare
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    patterns = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen) for chosen in combinations(range(blocks), spare)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in patterns]
    ways = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in signed])).alias("way", "bits")
    units = nodes.select("node", "fp", ways)
    sizes = units.groupBy("way", "bits").agg(F.count("*").alias("_n")).where("_n > 1")
    units = units.join(sizes, ["way", "bits"]).withColumn("cuts", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
    mine = F.pmod(F.xxhash64("fp", F.lit("cut")), F.col("cuts")).cast("int")
    small = units.where("cuts = 1").select("node", "fp", "way", "bits", F.lit(0).alias("x"), F.lit(0).alias("y"))
    large = (
        units.where("cuts > 1")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select("node", "fp", "way", "bits", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    )
    dealt = small.union(large).select("node", "fp", F.xxhash64("way", "bits", "x", "y").alias("unit"))
    dealt = dealt.repartition(F.col("unit")).sortWithinPartitions("unit")
    kind = nodes.schema["node"].dataType.simpleString()
    return dealt.mapInPandas(_link_units(most), f"src {kind}, dst {kind}")


def _classes(fps: DataFrame, most: int) -> DataFrame:
    """Rows of ``fps`` with class_fp (the smallest fingerprint of the class) and component_id."""
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    links = hamming_links(nodes.select(F.col("fp").alias("node"), "fp"), most)
    comps = connected_components(links)
    lows = comps.join(nodes, comps["node"] == nodes["fp"]).groupBy("component").agg(F.min("low").alias("component_id"))
    named = comps.join(lows, "component").select(F.col("node").alias("fp"), F.col("component").alias("class_fp"), "component_id")
    names = nodes.join(named, "fp", "left").select("fp", F.coalesce("class_fp", "fp").alias("class_fp"), F.coalesce("component_id", "low").alias("component_id"))
    # one row per fingerprint in names; a fingerprint that many rows share is split by adaptive execution
    return fps.join(names, "fp")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: component_id is the smallest id reachable by links.

    Fingerprints link at ``most`` or fewer differing bits; equal ones, that of empty texts included, are one node and
    never expanded into pairs.  Rows with a null id get a component through their fingerprint (null if no row of the
    component has an id).  Repeated rows give repeated rows; an empty table gives an empty result; other columns of
    ``docs`` are ignored.
    """
    with small_batches(docs.sparkSession):
        fps = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    return _classes(fps, most).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that with the smallest id; all columns as they are.

    ``classes`` is a stored table (doc_id, text_hash, class_fp) of all rows.  A row without an id stays only if its class
    has no id at all.  Of rows repeated with id and text one stays.
    """
    ordered = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    heads = classes.groupBy("class_fp").agg(F.min(ordered).alias("head"))
    marked = classes.join(heads, "class_fp").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("head.id")) & (F.col("text_hash") == F.col("head.hash")))
    # the id as text, so that joins and the removal of repeats are dealt by the same two plain columns
    key = [id_key(F.col("doc_id")).alias("_id"), F.col("text_hash").alias("_hash")]
    marked = staged(marked.select(*key, "stays", "class_fp"), "marked")
    staying, all_heads, going = marked.agg(F.count_if("stays"), F.count_distinct(F.when(F.col("stays"), F.col("class_fp"))), F.count_if(~F.col("stays"))).first()
    rows = docs.select(
        F.struct("*").alias("_row"), id_key(F.col(id_col)).alias("_id"), F.xxhash64(text_of(text_col)).alias("_hash")
    )
    if going <= BROADCAST_ROWS and staying == all_heads:  # few rows go and none is repeated: no text moves
        gone = marked.where(~F.col("stays")).select("_id", "_hash").distinct()
        return rows.join(F.broadcast(gone), ["_id", "_hash"], "left_anti").select("_row.*")
    heads = marked.where("stays").select("_id", "_hash").distinct()
    return rows.join(heads, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select("_row.*")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """``docs`` with one row of each class of :func:`near_classes`, as :func:`keep_first` picks it."""
    with small_batches(docs.sparkSession):
        fps = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = staged(_classes(fps, most).select("doc_id", "text_hash", "class_fp"), "classes")
    return keep_first(docs, classes, id_col, text_col)
