"""Second-order boosted trees over sparse bits and binned numbers, grown one stored round at a time.

A level of a tree is one aggregate: gradient and hessian sums per (node, feature, bin), added up map-side over the bins
a row has set; the sums of all other rows follow by subtraction.  Sums are whole numbers (gradients in fixed point), so
they do not depend on the order of rows, on partitions or on retries, and a refit grows the same trees anywhere.

Each round starts from a stored table of margins and ends by writing the next one.  Training can therefore stop at any
round, and go on from a saved one.  The driver holds the trees (2 ** depth nodes) and nothing else.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.session import drop_path, scratch_path, spread

#: Gradients are rounded to multiples of 1 / FIXED; sums of up to 5 * 10^11 rows of weight 1 fit a bigint.
FIXED = 1 << 24
#: An item is feature * BIN_SLOTS + bin; bin 0 is never stored.
BIN_SLOTS = 256
#: Splits that gain less are not made.
LEAST_GAIN = 1e-6


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2i + 1 (bit absent, value at most the threshold) and 2i + 2.

    ``feature`` is -1 at leaves and unused places; ``bin`` is the first bin that goes right, ``threshold`` the largest
    value that goes left; ``value`` is a leaf's step on the margin.
    """

    feature: list[int]
    bin: list[int]
    threshold: list[float]
    value: list[float]


@dataclass
class Growth:
    """Settings of the growth that do not change between rounds."""

    max_depth: int = 6
    eta: float = 0.3
    alpha: float = 0.0
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    seed: int = 42


def model_inputs(df: DataFrame, bits: str | None, numbers: list[str | Column] = ()) -> DataFrame:
    """Add ``in_bits`` (set positions) and ``in_numbers`` (an array of doubles), the two inputs of every tree."""
    set_bits = F.col(bits).cast("array<int>") if bits else F.array().cast("array<int>")
    values = [(F.col(n) if isinstance(n, str) else n).cast("double") for n in numbers]
    return df.withColumns({"in_bits": set_bits, "in_numbers": F.array(*values).cast("array<double>")})


# ------------------------------------------------------------------------------------------ model


@dataclass
class BitTreeModel:
    """Trees over ``n_bits`` bits and, after them, ``n_numbers`` numbers."""

    n_bits: int
    n_numbers: int
    trees: list[Tree] = field(default_factory=list)

    @property
    def n_rounds(self) -> int:
        return len(self.trees)

    def _walker(self, rounds: int | None):
        """Function (bits, numbers) -> leaf of every tree, one numpy step per level for a whole Arrow batch."""
        trees = self.trees if rounds is None else self.trees[:rounds]
        n_bits, n_numbers = self.n_bits, self.n_numbers
        size = max((len(t.feature) for t in trees), default=1)
        pad = lambda xs, x: list(xs) + [x] * (size - len(xs))
        feature = np.array([pad(t.feature, -1) for t in trees], np.int32).reshape(len(trees), size)
        threshold = np.array([pad(t.threshold, 0.0) for t in trees], np.float64).reshape(len(trees), size)
        depth = size.bit_length() - 1

        def leaves(bits: pa.Array, numbers: pa.Array) -> np.ndarray:
            n = len(bits)
            here = np.arange(n)
            on = np.zeros((n, n_bits + 1), bool)
            at = np.repeat(here, np.diff(bits.offsets.to_numpy()) if bits.null_count == 0 else bits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = bits.flatten().to_numpy(zero_copy_only=False)
            known = flat < n_bits  # positions that no training row had set
            on[at[known], flat[known]] = True
            values = numbers.flatten().to_numpy(zero_copy_only=False).reshape(n, n_numbers) if n_numbers and n else None
            out = np.zeros((n, len(trees)), np.int32)
            for t in range(len(trees)):
                node = out[:, t]
                for _ in range(depth):
                    f = feature[t][node]
                    right = on[here, np.where((f >= 0) & (f < n_bits), f, n_bits)]
                    if values is not None:
                        more = values[here, np.clip(f - n_bits, 0, n_numbers - 1)] > threshold[t][node]
                        right = np.where(f >= n_bits, more, right)
                    node = np.where(f < 0, node, 2 * node + 1 + right)
                out[:, t] = node
            return out

        value = np.array([pad(t.value, 0.0) for t in trees], np.float64).reshape(len(trees), size)
        return leaves, value

    def margins(self, rounds: int | None = None) -> Column:
        """Running margins after each of the first ``rounds`` trees, all in one pass over the row."""
        leaves, value = self._walker(rounds)

        @F.arrow_udf("array<double>")
        def run(bits: pa.Array, numbers: pa.Array) -> pa.Array:
            steps = value[np.arange(len(value)), leaves(bits, numbers)] if len(value) else np.zeros((len(bits), 0))
            return pa.ListArray.from_arrays(np.arange(len(bits) + 1, dtype=np.int32) * len(value), np.cumsum(steps, axis=1).reshape(-1))

        return run("in_bits", "in_numbers")

    def leaf_pattern(self) -> Column:
        """The leaf of every tree, packed; rows with one pattern have equal scores after every round."""
        leaves, _ = self._walker(None)

        @F.arrow_udf("binary")
        def run(bits: pa.Array, numbers: pa.Array) -> pa.Array:
            return pa.array([r.tobytes() for r in leaves(bits, numbers)], pa.binary())

        return run("in_bits", "in_numbers")

    def pattern_margins(self, pattern: str) -> Column:
        """Running margins of a :meth:`leaf_pattern`."""
        _, value = self._walker(None)

        @F.arrow_udf("array<double>")
        def run(patterns: pa.Array) -> pa.Array:
            leaves = np.frombuffer(b"".join(patterns.to_pylist()), np.int32).reshape(len(patterns), len(value))
            steps = value[np.arange(len(value)), leaves]
            return pa.ListArray.from_arrays(np.arange(len(patterns) + 1, dtype=np.int32) * len(value), np.cumsum(steps, axis=1).reshape(-1))

        return run(pattern)

    def score(self, df: DataFrame, rounds: int | None = None, name: str = "score") -> DataFrame:
        """Add the probability of class 1 by all trees or by the first ``rounds``."""
        if rounds is not None and not 0 < rounds <= self.n_rounds:
            raise ValueError(f"the model has {self.n_rounds} rounds, not {rounds}")
        leaves, value = self._walker(rounds)

        @F.arrow_udf("double")
        def run(bits: pa.Array, numbers: pa.Array) -> pa.Array:
            total = np.cumsum(value[np.arange(len(value)), leaves(bits, numbers)], axis=1)[:, -1] if len(value) else np.zeros(len(bits))
            return pa.array(1.0 / (1.0 + np.exp(-total)))

        return df.withColumn(name, run("in_bits", "in_numbers"))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per tree."""
        rows = [(i, t.feature, t.bin, t.threshold, t.value) for i, t in enumerate(self.trees)]
        return spark.createDataFrame(rows, TREES)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        notes = json.dumps({"n_bits": self.n_bits, "n_numbers": self.n_numbers})
        spark.createDataFrame([(notes,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/shape")
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")

    def add_saved(self, path: str, tree: Tree) -> None:
        """Add the newest tree to a saved model."""
        row = (self.n_rounds - 1, tree.feature, tree.bin, tree.threshold, tree.value)
        SparkSession.active().createDataFrame([row], TREES).coalesce(1).write.mode("append").parquet(f"{path}/trees")

    @classmethod
    def load(cls, path: str) -> BitTreeModel:
        spark = SparkSession.active()
        shape = json.loads(spark.read.text(f"{path}/shape").first().value)
        rows = spark.read.schema(TREES).parquet(f"{path}/trees").orderBy("round").collect()
        return cls(**shape, trees=[Tree(list(r.feature), list(r.bin), list(r.threshold), list(r.value)) for r in rows])


def walked(model: BitTreeModel, bits: str) -> Column:
    """Probability of class 1 of a model without numbers as one SQL expression, tree by tree; for small models and checks."""

    def node(tree: Tree, i: int) -> str:
        if tree.feature[i] < 0:
            return f"{tree.value[i]!r}D"
        return f"if(array_contains({bits}, {tree.feature[i]}), {node(tree, 2 * i + 2)}, {node(tree, 2 * i + 1)})"

    return F.expr(f"1D / (1D + exp(-({' + '.join(node(t, 0) for t in model.trees)})))")


TREES = "round int, feature array<int>, bin array<int>, threshold array<double>, value array<double>"


# ------------------------------------------------------------------------------------------ growth


def number_cuts(df: DataFrame, n_numbers: int, max_bins: int) -> list[list[float]]:
    """Ascending cut values of each number; a value's bin is how many of them lie below it."""
    if not n_numbers:
        return []
    shares = [i / max_bins for i in range(1, max_bins)]
    found = df.agg(*[F.percentile_approx(F.get("in_numbers", F.lit(j)), shares, 10_000).alias(f"c{j}") for j in range(n_numbers)]).first()
    return [sorted(set(found[j] or [])) for j in range(n_numbers)]


def _constant(values: list, kind: str) -> str:
    """An array of numbers as one constant of SQL; a growing tree's constants change at every level, so plans are text."""
    return f"cast(split('{','.join(map(repr, values))}', ',') as array<{kind}>)"


def binned(df: DataFrame, n_bits: int, cuts: list[list[float]]) -> DataFrame:
    """Add ``bins`` (bin of each number) and ``items`` (set bits and bins above 0 as feature * BIN_SLOTS + bin)."""

    def number_bin(j: int) -> Column:
        value = F.coalesce(F.get("in_numbers", F.lit(j)), F.lit(float("-inf")))  # a missing number goes left
        return F.size(F.filter(F.expr(_constant(cuts[j], "double")), lambda cut: cut < value)) if cuts[j] else F.lit(0)

    df = df.withColumn("bins", F.array(*[number_bin(j) for j in range(len(cuts))]).cast("array<int>"))
    items = F.transform(F.coalesce("in_bits", F.array().cast("array<int>")), lambda b: b * BIN_SLOTS + 1)
    if cuts:
        placed = F.transform("bins", lambda b, j: F.when(b > 0, (j + n_bits) * BIN_SLOTS + b))
        items = F.concat(items, F.array_compact(placed))
    return df.withColumn("items", items.cast("array<int>"))


def _with_node(df: DataFrame, tree: Tree, steps: int, n_bits: int) -> DataFrame:
    """Add ``_n``, the node a row has reached after ``steps`` levels; each step is a projection of its own."""
    df = df.withColumn("_n", F.lit(0))
    for level in range(steps):
        upto = 2 ** (level + 1) - 1
        f = f"get({_constant(tree.feature[:upto], 'int')}, _n)"
        right = f"array_contains(items, {f} * {BIN_SLOTS} + 1)"
        if any(x >= n_bits for x in tree.feature[:upto]):
            more = f"get(bins, {f} - {n_bits}) >= get({_constant(tree.bin[:upto], 'int')}, _n)"
            right = f"if({f} >= {n_bits}, {more}, {right})"
        df = df.withColumn("_n", F.expr(f"if({f} < 0, _n, 2 * _n + 1 + cast({right} as int))"))
    return df


def _best_splits(rows: DataFrame, growth: Growth) -> DataFrame:
    """(node, g, h, best): sums of every node of ``rows`` (node, g, h, items) and its best split, null if none gains.

    Item 0 stands for the node itself.  A candidate takes the bins from its own upwards to the right.  Of equal gains the
    first feature and bin win.
    """
    each = rows.selectExpr("node", "g", "h", "explode(concat(array(0), items)) as item")
    sums = each.groupBy("node", "item").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    # all items of a node: as many as there are bins, whatever the number of rows
    sums = sums.selectExpr("node", "item", "g", "h", f"if(item = 0, -1, item div {BIN_SLOTS}) as f")
    whole, upwards = "over (partition by node)", "over (partition by node, f order by item desc rows between unbounded preceding and current row)"
    sums = sums.selectExpr("node", "item", *[f"max(if(item = 0, {c}, null)) {whole} as all_{c}" for c in "gh"], *[f"sum({c}) {upwards} as right_{c}" for c in "gh"])
    sums = sums.selectExpr("*", *[f"all_{c} - right_{c} as left_{c}" for c in "gh"])

    def real(name: str) -> str:
        return f"({name} / {float(FIXED)!r}D)"

    def quality(side: str) -> str:
        soft = f"greatest(abs({real(side + '_g')}) - {float(growth.alpha)!r}D, 0D)"
        return f"pow({soft}, 2D) / ({real(side + '_h')} + {float(growth.reg_lambda)!r}D)"

    sums = sums.selectExpr("*", f"{quality('left')} + {quality('right')} - {quality('all')} as gain")
    least = f"{float(growth.min_child_weight)!r}D"
    good = f"item > 0 and {real('left_h')} >= {least} and {real('right_h')} >= {least} and gain > {LEAST_GAIN!r}D"
    best = F.expr(f"max_by(struct(item, right_g, right_h), if({good}, struct(gain, -item), null))")
    return sums.groupBy("node").agg(F.max("all_g").alias("g"), F.max("all_h").alias("h"), best.alias("best"))


def _sampled(state: DataFrame, growth: Growth, round_no: int, n_features: int) -> DataFrame:
    """(g, h, items, bins, used): gradients in fixed point of the round's rows, and the items of the round's features."""
    rows = state.where("split = 'train'")
    if growth.subsample < 1:
        drawn = F.pmod(F.xxhash64("row_id", F.lit(growth.seed), F.lit(round_no)), F.lit(1_000_000))
        rows = rows.where(drawn < F.lit(int(growth.subsample * 1_000_000)))
    used = "items"
    if growth.colsample_bytree < 1:
        some = max(1, int(growth.colsample_bytree * n_features))
        chosen = set(random.Random(f"{growth.seed}:{round_no}").sample(range(n_features), some))
        allowed = _constant([int(f in chosen) for f in range(n_features)], "int")
        used = f"filter(items, x -> get({allowed}, x div {BIN_SLOTS}) = 1)"
    rows = rows.selectExpr("y", "w", "items", "bins", f"{used} as used", "1D / (1D + exp(-margin)) as p")
    fixed = lambda x: f"cast(round({x} * {float(FIXED)!r}D) as bigint)"
    return rows.selectExpr(f"{fixed('w * (p - y)')} as g", f"{fixed('w * p * (1D - p)')} as h", "items", "bins", "used")


def grow_tree(state: DataFrame, growth: Growth, round_no: int, n_bits: int, cuts: list[list[float]]) -> Tree:
    """One tree from the margins of the ``train`` rows of a stored state table."""
    rows = _sampled(state, growth, round_no, n_bits + len(cuts))
    size = 2 ** (growth.max_depth + 1) - 1
    tree = Tree([-1] * size, [0] * size, [0.0] * size, [0.0] * size)

    def leaf(node: int, g: int, h: int) -> None:
        g, h = g / FIXED, h / FIXED
        soft = (g > 0) * max(g - growth.alpha, 0.0) - (g < 0) * max(-g - growth.alpha, 0.0)
        tree.value[node] = -growth.eta * soft / (h + growth.reg_lambda)

    for level in range(growth.max_depth):
        at = _with_node(rows, tree, level, n_bits).where(f"_n >= {2**level - 1}")
        found = _best_splits(at.selectExpr("_n as node", "g", "h", "used as items"), growth).collect()
        for r in found:  # at most 2 ** level rows
            leaf(r.node, r.g, r.h)
            if r.best is None:
                continue
            f, b = divmod(r.best.item, BIN_SLOTS)
            tree.feature[r.node], tree.bin[r.node] = f, b
            tree.threshold[r.node] = cuts[f - n_bits][b - 1] if f >= n_bits else 0.0
            leaf(2 * r.node + 1, r.g - r.best.right_g, r.h - r.best.right_h)
            leaf(2 * r.node + 2, r.best.right_g, r.best.right_h)
        if not any(r.best for r in found):
            break
    return tree


class Boosting:
    """Rounds of one model over a stored table; ``state`` is the table after the rounds grown so far.

    ``df`` has ``row_id``, the 0/1 ``label`` (rows without one are left out), ``split``, the inputs of
    :func:`model_inputs` and, if named, a ``weight``.  ``model`` goes on from the rounds it has.
    """

    def __init__(self, df: DataFrame, row_id: str, label: str, split: str, growth: Growth, weight: str | None = None, max_bins: int = 32, n_bits: int | None = None, model: BitTreeModel | None = None):
        if not 2 <= max_bins < BIN_SLOTS:
            raise ValueError(f"max_bins must be from 2 to {BIN_SLOTS - 1}")
        self.spark, self.growth, self._next = df.sparkSession, growth, None
        known = df.where(F.col(label).isin(0, 1))
        train = known.where(F.col(split) == "train")
        seen = known.agg(F.max(F.array_max("in_bits")).alias("bit"), F.max(F.size("in_numbers")).alias("numbers")).first()
        if model is not None:
            n_bits, n_numbers = model.n_bits, model.n_numbers
        else:
            n_bits = (seen.bit if seen.bit is not None else -1) + 1 if n_bits is None else n_bits
            n_numbers = max(seen.numbers or 0, 0)
        self.cuts = number_cuts(train, n_numbers, max_bins)
        self.model = BitTreeModel(n_bits, n_numbers, list(model.trees) if model else [])
        start = F.lit(0.0)
        if self.model.trees:
            start = F.get(self.model.margins(), F.lit(self.model.n_rounds - 1))
        rows = known.select(F.col(row_id).alias("row_id"), F.col(split).alias("split"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), "in_bits", "in_numbers", start.alias("margin"))
        self._store(binned(spread(rows), n_bits, self.cuts).drop("in_bits", "in_numbers"))

    def _store(self, rows: DataFrame) -> None:
        path, before = scratch_path(self.spark, "boosting"), getattr(self, "path", None)
        rows.write.parquet(path)
        self.state, self.path = self.spark.read.schema(rows.schema).parquet(path), path
        if before:
            drop_path(self.spark, before)

    def look_ahead(self) -> Tree:
        """The next round's tree, kept for :meth:`step`; the model and the margins stay as they are."""
        if self._next is None:
            self._next = grow_tree(self.state, self.growth, self.model.n_rounds, self.model.n_bits, self.cuts)
        return self._next

    def step(self) -> Tree:
        """Grow one more round and store the margins after it."""
        tree = self.look_ahead()
        self._next = None
        moved = _with_node(self.state, tree, self.growth.max_depth, self.model.n_bits)
        moved = moved.withColumn("margin", F.expr(f"margin + get({_constant(tree.value, 'double')}, _n)")).drop("_n")
        self._store(moved)
        self.model.trees.append(tree)
        return tree

    def close(self) -> None:
        """Drop the last stored table."""
        drop_path(self.spark, self.path)
