"""Near-duplicate embeddings: sign hashing by random hyperplanes, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import staged
from tallyfold.llm.components import connected_components
from tallyfold.llm.simhash import union_links
from tallyfold.operators.ranking import small_side

#: A bucket with more vectors is cut; each pair of its cuts is a unit, so a task holds two cuts at a time at most.
BLOCK = 2_048
#: Vectors a bucket should hold; the number of sign bits grows with the table so that it stays there.
BUCKET = 1_024
#: Bits of the sketch that goes to the buckets in a vector's place: signs on further hyperplanes.
SKETCH = 256
#: A sketch pair may differ in so many standard deviations more bits than a pair at the threshold does on average; fewer
#: than one in 20,000 pairs at the threshold lie beyond.
DEVIATIONS = 4.5
#: Chance that a pair exactly at the threshold meets in at least one table.
RECALL = 0.97

PARTS = [f"s{i}" for i in range(SKETCH // 64)]


def plan_tables(n: int, threshold: float) -> tuple[int, int]:
    """(bits per table, tables) for ``n`` vectors: a pair at the threshold meets in some table with chance RECALL."""
    bits = min(30, max(4, math.ceil(math.log2(max(2, n) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))


def sketch_limit(threshold: float) -> int:
    """Most bits in which the sketches of two vectors may differ that are still to be compared."""
    apart = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.floor(SKETCH * apart + DEVIATIONS * math.sqrt(SKETCH * apart * (1 - apart)))


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors as they are stored, floats or doubles; v is null for those that link with nothing."""
    stored = table.select(vector_col).schema.fields[0].dataType.simpleString()
    v = F.col(vector_col).cast(stored if stored in ("array<float>", "array<double>") else "array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0.0)
    return table.select(F.col(id_col).alias("vec_id"), F.when(v.isNotNull() & ~bad & ~zero, v).alias("v"))


def embedding_classes(
    table: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", bits: int | None = None, tables: int | None = None, seed: int = 11
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links are pairs with cosine >= ``threshold``.

    Equal vectors are one node with a count and are never expanded into pairs.  Nodes meet where the signs of their
    projections on ``bits`` random hyperplanes agree in one of the tables.  A sketch of ``SKETCH`` further signs goes to
    the buckets first and tells which nodes have a possible partner in which table; only those nodes' vectors move, to
    the buckets of these tables.  There every pair is verified in double precision and counted in the first table it meets
    in.  Buckets keep all their members: large ones are cut by hash and each pair of cuts is handled on its own.  A unit
    returns marks of nodes, sums of links and a spanning set of links, not pairs.

    Null, zero, non-finite vectors, vectors with null components, and vectors of another length link with nothing of
    other lengths.  Rows that repeat a vec_id count as vectors of their own.  A null vec_id takes part but names no
    component while others do.  An empty table gives an empty result.
    """
    rows = staged(valid_vectors(table, id_col, vector_col), "vectors")
    # -0.0 and 0.0 are one value; a hash of 128 bits names the vector
    flat = F.array_join(F.transform("v", lambda x: (x.cast("double") + 0.0).cast("string")), ",")
    keyed = staged(rows.select("vec_id", F.md5(flat).alias("key"), "v"), "vectors")
    nodes = keyed.where("v is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("v").alias("v"))
    # numbered once, in the stored table
    nodes = staged(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    count = nodes.count()
    own_bits, own_tables = plan_tables(count, threshold)
    bits, tables = bits or own_bits, tables or own_tables

    def hash_signs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for frame in frames:
            for dim, part in frame.groupby(frame["v"].map(len)):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits + SKETCH))
                x = np.stack(part["v"].to_list()).astype(np.float64)
                signs = (x / np.abs(x).max(1, keepdims=True)) @ planes[dim] > 0
                codes = signs[:, : tables * bits].reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                sketch = np.packbits(signs[:, tables * bits :], axis=1).view(np.int64)
                yield part.assign(dim=dim, codes=[c.astype(np.int32) for c in codes], **dict(zip(PARTS, sketch.T)))

    signs = f"id bigint, n bigint, v {dict(nodes.dtypes)['v']}, dim int, codes array<int>, {', '.join(f'{s} bigint' for s in PARTS)}"
    coded = staged(nodes.select("id", "n", "v").mapInPandas(hash_signs, signs), "signs")
    placed = coded.select("id", "dim", *PARTS, F.posexplode("codes").alias("way", "code"))
    # buckets to cut: few; beyond that number the join shuffles
    sizes = placed.groupBy("dim", "way", "code").agg(F.count("*").alias("_m"))
    large = staged(sizes.where(F.col("_m") > BLOCK), "large")
    large = small_side(large, large.count())
    marked = _units(placed, large, *PARTS).mapInPandas(_by_unit(_mark(sketch_limit(threshold))), "id bigint, way int")
    near = staged(marked.groupBy("id").agg(F.collect_set("way").alias("ways")), "near")  # no more ways than tables
    moved = coded.join(near, "id").select("id", "n", "v", "codes", "dim", F.explode("ways").alias("way"))
    moved = moved.withColumn("code", F.element_at("codes", F.col("way") + 1))
    found = _units(moved, large, "n", "v", "codes").mapInPandas(_by_unit(_verify(threshold)), "src bigint, dst bigint, links bigint")
    found = staged(found, "links")
    links = found.where("links > 0").groupBy("src").agg(F.sum("links").alias("more"))
    classes = connected_components(found.where("src <> dst"))
    per = nodes.select("id", "key", "n", "low").join(links, F.col("id") == F.col("src"), "left").drop("src")
    per = per.join(classes, F.col("id") == F.col("node"), "left").select("key", "low", F.coalesce("component", "id").alias("root"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    lows = per.groupBy("root").agg(F.min("low").alias("component_id"))
    per = per.join(lows, "root").select("key", "n_links", "component_id")
    out = keyed.select("vec_id", "key").join(per, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _units(placed: DataFrame, large: DataFrame, *held: str) -> DataFrame:
    """``id, way, unit, side`` and the columns ``held`` of each row of ``placed`` (id, dim, way, code, …), dealt by unit.

    A unit is a bucket, or two cuts of a large one (``side`` 0 and 1) or one such cut (``side`` 2).
    """
    placed = placed.join(large, ["dim", "way", "code"], "left")
    placed = placed.withColumn("cuts", F.coalesce(F.ceil(F.col("_m") / F.lit(BLOCK)).cast("int"), F.lit(1)))
    mine = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    unit = F.xxhash64("dim", "way", "code", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int"))
    placed = placed.select("id", "way", unit.alias("unit"), side.alias("side"), *held)
    return placed.repartition(F.col("unit")).sortWithinPartitions("unit")


def _by_unit(run: Callable[[pd.DataFrame], pd.DataFrame]):
    """``run`` on each unit of two rows or more; frames are sorted by unit, whose rows may go on in the next frame."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            last = frame["unit"].iloc[-1]
            if held and frame["unit"].iloc[0] == last == held[0]["unit"].iloc[0]:
                held.append(frame)
                continue
            whole = pd.concat([*held, frame])
            for _, part in whole[whole["unit"] != last].groupby("unit", sort=False):
                if len(part) > 1:
                    yield run(part)
            held = [whole[whole["unit"] == last]]
        if held and len(whole := pd.concat(held)) > 1:
            yield run(whole)

    return each


def _mark(limit: int):
    """Nodes that have a partner in the unit whose sketch differs in at most ``limit`` bits."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        words = [part[c].to_numpy(np.int64).view(np.uint64) for c in PARTS]
        side, near = part["side"].to_numpy(), np.zeros(len(part), bool)
        for at in range(0, len(part), 256):
            to = slice(at, at + 256)
            differ = sum(np.bitwise_count(w[to, None] ^ w[None, at:]).astype(np.uint16) for w in words)
            close = (differ <= limit) & ((side[to, None] == 2) | (side[to, None] != side[None, at:]))
            rows = np.arange(close.shape[0])
            close[rows, rows] = False
            near[to] |= close.any(1)
            near[at:] |= close.any(0)
        return part.loc[near, ["id", "way"]]

    return run


def _verify(threshold: float):
    """Links of the nodes of a unit, each pair in the first table it meets in: their numbers, and a spanning set of them."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["v"].to_list()).astype(np.float64)
        codes, way = np.stack(part["codes"].to_list()), int(part["way"].iloc[0])
        n, side, node = part["n"].to_numpy(np.int64), part["side"].to_numpy(), part["id"].to_numpy(np.int64)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        sums = np.zeros(len(x), np.int64)
        # a smaller id makes a smaller root
        order = np.argsort(node, kind="stable")
        rank = np.empty(len(node), np.int64)
        rank[order] = np.arange(len(node))

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for at in range(0, len(x), 256):
                a, b = np.nonzero(x[at : at + 256] @ x.T >= threshold)
                a = a + at
                good = (a < b) & ((side[a] == 2) | (side[a] != side[b]))
                a, b = a[good], b[good]
                for i in range(0, len(a), 100_000):
                    s, e = a[i : i + 100_000], b[i : i + 100_000]
                    if way:  # an earlier table has the pair already
                        new = ~(codes[s, :way] == codes[e, :way]).any(1)
                        s, e = s[new], e[new]
                    sums[:] += np.bincount(s, n[e], len(x)).astype(np.int64) + np.bincount(e, n[s], len(x)).astype(np.int64)
                    yield rank[s], rank[e]

        root = union_links(len(node), pairs())
        by_rank = node[order]
        moved = np.flatnonzero(root != np.arange(len(node)))
        some = np.flatnonzero(sums)
        src, dst = np.concatenate([by_rank[moved], node[some]]), np.concatenate([by_rank[root[moved]], node[some]])
        return pd.DataFrame({"src": src, "dst": dst, "links": np.concatenate([np.zeros(len(moved), np.int64), sums[some]])})

    return run
