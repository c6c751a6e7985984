"""Mixing sources to target weights: budgets down a tree, then a token prefix of seeded epochs for every leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.functions.hashing import md5_60
from tallyfold.llm.common import id_key, running_start, staged, text_of
from tallyfold.operators.ranking import BROADCAST_ROWS, small_side

#: Weights are whole numbers up to this, so that budget times weight stays exact for any corpus.
MAX_WEIGHT = 10_000


def word_count(text: str = "text") -> Column:
    """Tokens of a text where none are counted yet: runs without ASCII white space; null has none."""
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def leaf_budgets(leaves: DataFrame, levels: list[str], total: int, weights: dict[str, int] | None = None, max_epochs: int = 1) -> DataFrame:
    """(levels..., tokens, budget) for every leaf: tokens it may give, from a total that runs down the tree.

    ``leaves`` has one row per leaf with its ``tokens``.  ``weights`` maps a path of names joined by "/" to a whole
    number from 0 to MAX_WEIGHT; others weigh 1 among their siblings.  A node holds at most ``max_epochs`` times the
    tokens below it.  At each node the budget is split among the children by weight; a child that cannot hold its share
    takes what it holds and the shortage goes to its siblings by weight, again until all fit.  Only what a whole subtree
    cannot hold reaches the siblings of its parent.  Shares are rounded down (less than a token per child is lost); a
    child of weight 0 gets nothing, and what lies below it adds nothing to what its ancestors can hold.

    Null names are a name of their own.  The tree is one row per leaf and never leaves the cluster; a window holds the
    children of one node.
    """
    spark = leaves.sparkSession
    for path, w in (weights or {}).items():
        if not (isinstance(w, int) and 0 <= w <= MAX_WEIGHT):
            raise ValueError(f"weight of {path!r} must be a whole number from 0 to {MAX_WEIGHT}")
    named = spark.createDataFrame([(k, v) for k, v in (weights or {}).items()] or [("", 1)], "_path string, _w bigint")
    named = named.dropDuplicates(["_path"])
    path = lambda names: F.concat_ws("/", *[F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in names])
    tree = leaves.withColumn("_cap", (F.col("tokens") * max_epochs).cast("bigint"))
    for depth in range(1, len(levels) + 1):
        shut = named.where("_w = 0").select(F.col("_path").alias("_shut"))
        tree = tree.join(F.broadcast(shut), path(levels[:depth]) == F.col("_shut"), "left")
        tree = tree.withColumn("_cap", F.when(F.col("_shut").isNull(), F.col("_cap")).otherwise(F.lit(0).cast("bigint"))).drop("_shut")
    budgets = None
    for depth in range(1, len(levels) + 1):
        names, parent = levels[:depth], levels[: depth - 1]
        nodes = tree.groupBy(*names).agg(F.sum("_cap").alias("_c"))
        nodes = nodes.withColumn("_path", path(names)).join(F.broadcast(named), "_path", "left").withColumn("_w", F.coalesce("_w", F.lit(1).cast("bigint"))).drop("_path")
        if budgets is None:
            nodes = nodes.withColumn("_b", F.lit(int(total)).cast("bigint"))
        else:
            on = [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in parent]
            both = nodes.alias("l").join(budgets.alias("r"), on)
            nodes = both.select(*[F.col(f"l.{n}") for n in names], "l._c", "l._w", F.col("r._got").alias("_b"))
        # children in the order in which they fill up: least capacity per weight first (weight 0 last)
        ratio = F.when(F.col("_w") > 0, F.col("_c").cast("double") / F.col("_w")).otherwise(F.lit(float("inf")))
        nodes = nodes.withColumn("_c", F.when(F.col("_w") > 0, F.col("_c")).otherwise(F.lit(0).cast("bigint"))).withColumn("_ratio", ratio)
        order = Window.partitionBy(*parent).orderBy("_ratio", *[F.col(n).asc_nulls_first() for n in names])
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumn("_left", F.col("_b") - F.coalesce(F.sum("_c").over(before), F.lit(0)))
        nodes = nodes.withColumn("_open", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        # a child fills up if its share of what is left, among those not yet full, is at least its capacity
        full = F.when(F.col("_w") > 0, F.expr("(_left * _w) div _open") >= F.col("_c")).otherwise(F.lit(True))
        nodes = nodes.withColumn("_stop", F.when(~full, F.struct("_left", "_open")))
        nodes = nodes.withColumn("_at", F.first("_stop", ignorenulls=True).over(whole))
        ahead = F.max(F.when(~full, F.lit(1)).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        share = F.expr("(_at._left * _w) div _at._open")
        nodes = nodes.withColumn("_got", F.when((ahead == 0) | (F.col("_w") == 0), F.col("_c")).otherwise(F.least(share, F.col("_c"))))
        budgets = staged(nodes.select(*names, F.greatest("_got", F.lit(0).cast("bigint")).alias("_got")), "budgets")
    on = [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in levels]
    return leaves.alias("l").join(budgets.alias("r"), on).select(*[F.col(f"l.{n}") for n in levels], "l.tokens", F.col("r._got").alias("budget"))


def _leaf_key(names: list[str]) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names], *[F.col(n).isNull() for n in names])


def _rows(docs: DataFrame, levels: dict[str, Column], id_col: str, text_col: str, tokens: Column | None, *more: Column) -> DataFrame:
    """Names of the leaf, id, token count and a hash of text and names, which with the id tells rows apart."""
    size = (tokens if tokens is not None else word_count(text_col)).cast("bigint").alias("tokens")
    rows = docs.select(*more, *[c.alias(n) for n, c in levels.items()], F.col(id_col).alias("doc_id"), size, text_of(text_col).alias("_text"))
    return rows.withColumn("_hash", F.xxhash64("_text", _leaf_key(list(levels)))).drop("_text")


def mix_plan(
    docs: DataFrame,
    levels: dict[str, Column],
    total: int | None = None,
    share: float = 1.0,
    weights: dict[str, int] | None = None,
    max_epochs: int = 1,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """One row per chosen document and epoch: the leaf's names, doc_id, tokens, epoch, start, taken.

    Every leaf's documents are laid out in epochs, each in a seeded hash order of its own; the leaf's budget (see
    :func:`leaf_budgets`) takes the prefix of that row of tokens: whole epochs, then the documents of the next one that
    begin before the budget ends.  ``start`` is where the document begins in its epoch and ``taken`` how many of its
    tokens the prefix holds, fewer than ``tokens`` for the last one of a leaf only.  ``total`` is the number of tokens
    wanted, by default ``share`` of all there are; ``tokens`` counts those of a row, by default its words.

    Rows without tokens (null and empty texts) carry no weight and are left out.  Rows that repeat id, text and names
    count once.  Null ids and null names are values like others; an empty table gives an empty result.  No leaf meets in
    one task: positions are sums per hash range first, then within a range.
    """
    return _plan(docs, levels, total, share, weights, max_epochs, seed, id_col, text_col, tokens)[1]


def _plan(
    docs: DataFrame,
    levels: dict[str, Column],
    total: int | None = None,
    share: float = 1.0,
    weights: dict[str, int] | None = None,
    max_epochs: int = 1,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All rows with tokens, repeated ones counted, and :func:`mix_plan` of them."""
    names = list(levels)
    rows = _rows(docs, levels, id_col, text_col, tokens).where("tokens > 0")
    light = rows.groupBy(*names, "doc_id", "_hash").agg(F.max("tokens").alias("tokens"), F.count("*").alias("_copies"))
    light = staged(light, "lengths")
    leaves = staged(light.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "leaves")
    there, most = leaves.agg(F.sum("tokens"), F.max("n")).first()
    wanted = int(share * (there or 0)) if total is None else int(total)
    budgets = leaf_budgets(leaves.select(*names, "tokens"), names, wanted, weights, max_epochs).where("budget > 0")
    # whole epochs take all of a leaf, the last one a prefix
    epochs = budgets.withColumn("epoch", F.explode(F.expr("sequence(0L, (budget - 1) div tokens)")))
    room = F.least(F.col("tokens"), F.col("budget") - F.col("epoch") * F.col("tokens"))
    epochs = epochs.select(_leaf_key(names).alias("_leaf"), "epoch", room.alias("_room"))
    epochs = staged(epochs, "epochs")
    placed = light.withColumn("_leaf", _leaf_key(names)).join(small_side(epochs, epochs.count()), "_leaf")
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))  # steers the order only
    order = md5_60(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), id_text))
    placed = placed.withColumn("_key", F.shiftleft(order, 4))  # 60 bits, spread over 64
    buckets = max(16, int(most or 0) // 50_000)
    placed = running_start(placed, ["_leaf", "epoch"], ["doc_id", "_hash"], "tokens", "start", buckets).where("start < _room")
    taken = F.least(F.col("tokens"), F.col("_room") - F.col("start")).alias("taken")
    return light, placed.select(*names, "doc_id", "_hash", "tokens", "epoch", "start", taken)


def mix_documents(docs: DataFrame, levels: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, **how) -> DataFrame:
    """The rows of ``docs`` that :func:`mix_plan` chooses, whole and with all their columns, once per epoch."""
    light, plan = _plan(docs, levels, id_col=id_col, text_col=text_col, tokens=tokens, **how)
    known = lambda c: id_key(F.col(c)).alias("_id")
    times = staged(plan.select(known("doc_id"), "_hash").groupBy("_id", "_hash").agg(F.count("*").alias("_times")), "chosen")
    rows = _rows(docs, levels, id_col, text_col, tokens, F.struct("*").alias("_row")).select("_row", known("doc_id"), "_hash", "tokens")
    left = light.select(known("doc_id"), "_hash").join(times, ["_id", "_hash"], "left_anti")
    left = staged(left.distinct(), "left")
    most, copies = times.agg(F.max("_times")).first()[0], light.agg(F.max("_copies")).first()[0]
    if left.count() <= BROADCAST_ROWS and (most or 0) == (copies or 0) == 1:  # few rows go, none is repeated: no text moves
        return rows.where("tokens > 0").join(F.broadcast(left), ["_id", "_hash"], "left_anti").select("_row.*")
    once = rows.join(times, ["_id", "_hash"]).dropDuplicates(["_id", "_hash"])
    return once.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "_times"))).select("_row.*")
