"""Exact ranks, samples and running totals without a one-task sort.

Two building blocks carry everything here.

``rank_cutoffs`` finds the row that holds a wanted rank.  It counts rows per bucket (a map-side
aggregate), keeps only the bucket that contains the rank, and repeats inside it; the last step ranks
the few rows left.  A sample or split is then the plain filter "at or before the cutoff row": the
data rows themselves are never shuffled or sorted.

``running_totals`` is a distributed prefix sum: bucket totals are summed in bucket order, and each
bucket is then summed on its own.  Buckets come from a sample of the keys, so they are even whatever the
distribution; the sample only steers balance, never the result.  Their number grows with the rows: a bounded
sample cuts the order once, and where the pieces would still be large a second one, taken and ranked by the
executors, cuts each piece again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.functions.hashing import HASH_BITS, row_hash
from tallyfold.session import scratch_path

LEVEL_BITS = 12
# Sides known to have at most this many rows are broadcast; beyond it the join is left to the planner.
BROADCAST_ROWS = 100_000
# Samples of up to this many rows per group are cut in every task before the exchange.
HEAP_ROWS = 100
# A bucket of the natural order holds about this many rows at least, and this many keys are sampled for it.
BUCKET_ROWS = 1_000
SAMPLE_PER_BUCKET = 32
# A bucket of a running total that would hold more rows is cut again.
SPLIT_ROWS = 1_000_000


def small_side(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Broadcast ``df`` if its row bound is known and small, else leave the choice to the planner."""
    return F.broadcast(df) if max_rows is not None and max_rows <= BROADCAST_ROWS else df


def _no_rows(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


# ---------------------------------------------------------------------------------------- buckets


def settled(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back, for what is used more than once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def order_bounds(df: DataFrame, order: Sequence[str], bits: int, rows: int | None = None) -> list[Row]:
    """Ascending bounds that cut ``df`` into up to ``2 ** bits`` buckets of about even size along ``order``.

    They are taken from a sample of a fixed number of keys per bucket, of any type that Spark can order.
    """
    n = df.count() if rows is None else rows
    buckets = min(2**bits, n // BUCKET_ROWS)
    if buckets < 2:
        return []
    share = SAMPLE_PER_BUCKET * buckets / n
    keys = df.select(*order)
    got = (keys.sample(share, seed=17) if share < 1 else keys).orderBy(*order).collect()
    picked = [got[len(got) * i // buckets] for i in range(1, buckets)] if got else []
    return [row for i, row in enumerate(picked) if not i or row != picked[i - 1]]


def with_order_bucket(df: DataFrame, order: Sequence[str], name: str, bounds: Sequence[Row]) -> DataFrame:
    """Add a monotone bucket number: how many ``bounds`` lie before the row, nulls first.

    The bounds are constants.  A row finds its bucket by binary search, one short step per bit, inside
    generated code.
    """
    if not bounds:
        return df.withColumn(name, F.lit(0))
    place = F.struct(*[F.col(c) for c in order])
    table = df.sparkSession.createDataFrame([tuple(r) for r in bounds], df.select(*order).schema)
    df = df.withColumn("_q", table.agg(F.array_sort(F.collect_list(place))).scalar())
    return _bounds_before(df, order, len(bounds)).withColumn(name, F.col("_s")).drop("_q", "_s")


def _bounds_before(df: DataFrame, order: Sequence[str], longest: int) -> DataFrame:
    """Add ``_s``: how many of the sorted bounds in ``_q`` (at most ``longest``; null for none) lie before the row."""
    place = F.struct(*[F.col(c) for c in order])
    df = df.withColumn("_s", F.lit(0))
    # each step refers to the last one twice, so the optimizer keeps the steps apart instead of nesting them
    for half in (2**i for i in reversed(range(longest.bit_length()))):
        past = F.coalesce(F.get("_q", F.col("_s") + (half - 1)) < place, F.lit(False))
        df = df.withColumn("_s", F.col("_s") + F.when(past, F.lit(half)).otherwise(F.lit(0)))
    return df


def with_growing_buckets(df: DataFrame, order: Sequence[str], name: str, bits: int = 10) -> tuple[DataFrame, int]:
    """Add a monotone bucket number, nulls first; also return a bound on the number of buckets.

    Up to ``2 ** bits`` buckets come from constant bounds.  Where they would hold more than ``SPLIT_ROWS`` rows each is
    cut again: executors sample ``SAMPLE_PER_BUCKET`` keys per wanted piece, rank them inside their bucket and hand every
    bucket its list of bounds.  There are at most ``BROADCAST_ROWS`` buckets, as the bounds are broadcast; beyond
    ``SPLIT_ROWS * BROADCAST_ROWS`` rows (10^11) buckets grow again.
    """
    order = list(order)
    n = df.count()
    bounds = order_bounds(df, order, bits, n)
    tagged, buckets = with_order_bucket(df, order, name, bounds), len(bounds) + 1
    pieces = min(-(-n // (buckets * SPLIT_ROWS)), BROADCAST_ROWS // buckets)
    if pieces < 2:
        return tagged, buckets
    keys = tagged.select(name, *order)
    share = SAMPLE_PER_BUCKET * buckets * pieces / n
    keys = keys.sample(share, seed=18) if share < 1 else keys
    inside = Window.partitionBy(name)
    keys = keys.withColumns({"_r": F.row_number().over(inside.orderBy(*order)), "_m": F.count(F.lit(1)).over(inside)})
    # the last sampled key of every piece but the last one
    piece = lambda r: F.floor(r * F.lit(pieces) / F.col("_m"))
    ends = keys.where((piece(F.col("_r")) > piece(F.col("_r") - 1)) & (F.col("_r") < F.col("_m")))
    finer = ends.groupBy(name).agg(F.array_sort(F.collect_set(F.struct(*order))).alias("_q"))
    finer = settled(finer.withColumnRenamed(name, "_at"), "bounds")
    cut = tagged.join(F.broadcast(finer), F.col(name) == F.col("_at"), "left").drop("_at")
    cut = _bounds_before(cut, order, pieces - 1).withColumn(name, F.col(name) * F.lit(pieces) + F.col("_s"))
    return cut.drop("_q", "_s"), buckets * pieces


def constant(df: DataFrame, order: Sequence[str], row: Row) -> Column:
    """A key as a constant struct with the types it has in ``df``."""
    types = {f.name: f.dataType for f in df.select(*order).schema.fields}
    return F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in order])


def hash_bucket(h: str | Column, bits: int = LEVEL_BITS) -> Column:
    """Leading ``bits`` of a 60-bit hash; even by construction."""
    return F.shiftright(h, HASH_BITS - bits)


# ---------------------------------------------------------------------------------------- cutoffs


def rank_cutoffs(
    keyed: DataFrame,
    order: Sequence[str],
    want: Callable[[Column], Column] | None = None,
    by: Sequence[str] = (),
    levels: int = 2,
    n_cuts: int | None = None,
    every: int | None = None,
) -> DataFrame:
    """Rows that hold the wanted 1-based ranks: columns ``*by, rank, *order, take, ties``.

    ``order[0]`` is a 60-bit hash.  ``want`` maps the row count of the group to an array of ranks, or
    ``every`` asks for all its multiples.  Ranks outside ``1..count`` yield no row.  ``ties`` rows are equal
    in ``order`` to the row found and ``take`` of them lie at or before the rank.  A level narrows the search
    by 4096, so two levels leave a 16-millionth of the rows for the last step.  ``n_cuts`` is a proven bound
    on the number of result rows, if there is one.
    """
    by = list(by)
    edges, path = None, []
    for level in range(1, levels + 1):
        b = f"_b{level}"
        rows = keyed
        if edges is not None:
            hot = small_side(edges.select(*by, *path).distinct(), n_cuts)
            rows = rows.join(hot, [*by, *path], "left_semi")
        keyed = keyed.withColumn(b, hash_bucket(order[0], LEVEL_BITS * level))
        rows = rows.withColumn(b, hash_bucket(order[0], LEVEL_BITS * level))
        counts = rows.groupBy(*by, *path, b).agg(F.count(F.lit(1)).alias("_n"))
        if edges is None:
            group = Window.partitionBy(*by)
            if want:
                counts = counts.withColumn("_want", want(F.sum("_n").over(group)))
            counts = counts.withColumn("_base", F.lit(0))
        else:
            counts = counts.join(small_side(edges, n_cuts), [*by, *path])
            group = Window.partitionBy(*by, "rank")
        before = F.coalesce(F.sum("_n").over(group.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("_base", (F.col("_base") + before).cast("bigint"))
        counts = counts.withColumn("_upto", F.col("_base") + F.col("_n"))
        path = [*path, b]
        if edges is not None:
            inside = (F.col("rank") > F.col("_base")) & (F.col("rank") <= F.col("_upto"))
            edges = counts.where(inside).select(*by, *path, "_base", "rank")
        elif every:
            step = F.lit(int(every)).cast("bigint")
            first, last = F.expr(f"(_base div {every}L + 1) * {every}L"), F.expr(f"(_upto div {every}L) * {every}L")
            ranks = F.when(first <= last, F.sequence(first, last, step))
            edges = counts.select(*by, *path, "_base", F.explode(ranks).alias("rank"))
        else:
            inside = F.filter("_want", lambda r: (r > F.col("_base")) & (r <= F.col("_upto")))
            edges = counts.select(*by, *path, "_base", F.explode(inside).alias("rank"))
    last = keyed.join(small_side(edges, n_cuts), [*by, *path])
    inside = Window.partitionBy(*by, "rank").orderBy(*order)
    equal = F.count(F.lit(1)).over(Window.partitionBy(*by, "rank", *order))
    return (
        last.withColumns({"_place": F.row_number().over(inside), "_low": F.rank().over(inside), "ties": equal})
        .where(F.col("_base") + F.col("_place") == F.col("rank"))
        .select(*by, "rank", *order, (F.col("_place") - F.col("_low") + 1).alias("take"), "ties")
    )


def cutoff_row(df: DataFrame, order: Sequence[str], rank: int) -> tuple[Row, int, int] | None:
    """The row at a 1-based ``rank`` along ``order`` (any types, nulls first), with how many rows equal to it
    lie at or before the rank and how many there are; None beyond the last row.

    Buckets are counted and only the one that holds the rank is searched on, until it is small or made of
    equal rows.
    """
    order = list(order)
    rows, left, size = df.select(*order), int(rank), None
    while bounds := order_bounds(rows, order, LEVEL_BITS):
        counts = sorted(tuple(r) for r in with_order_bucket(rows, order, "_b", bounds).groupBy("_b").count().collect())
        hit = None
        for b, n in counts:
            if left <= n:
                hit = b, n
                break
            left -= n
        if hit is None:
            return None
        b, n = hit
        place = F.struct(*[F.col(c) for c in order])
        if b:
            rows = rows.where(place > constant(df, order, bounds[b - 1]))
        if b < len(bounds):
            rows = rows.where(place <= constant(df, order, bounds[b]))
        if n <= BUCKET_ROWS or (size is not None and n > 0.9 * size):
            break
        size = n
    # equal rows collapse before they meet
    upto = F.sum("count").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.groupBy(*order).count().withColumn("_upto", upto).where(F.col("_upto") >= left).orderBy(*order).limit(1).collect()
    if not found:
        return None
    row = found[0]
    return Row(**{c: row[c] for c in order}), left - (row["_upto"] - row["count"]), row["count"]


def _hashed(df: DataFrame, row_id: str, seed: int, hash: str, keep: Sequence[str | Column] = ()) -> DataFrame:
    # never null, or every join on its buckets would hash each row once more to test for null
    h = F.coalesce(row_hash(row_id, seed, hash), F.lit(0).cast("bigint"))
    return df.select(*keep, h.alias("_h"), F.col(row_id).alias("_id"))


def _place(row_id: str, seed: int, hash: str) -> Column:
    return F.struct(row_hash(row_id, seed, hash).alias("_h"), F.col(row_id).alias("_id"))


def at_or_before_rank(
    df: DataFrame, row_id: str, want: Callable[[Column], Column], seed: int = 42, hash: str = "md5", levels: int = 2
) -> Column:
    """Boolean column: the row is among the first ``want(count)`` rows of the seeded order.

    Rows that share an id cannot be told apart: an end between them is an error when the query runs.
    """
    cut = rank_cutoffs(_hashed(df, row_id, seed, hash), ["_h", "_id"], lambda n: F.array(want(n)), levels=levels, n_cuts=1)
    torn = F.raise_error(F.lit(f"{row_id} is not unique: the last row taken shares its id with others"))
    whole = F.struct("_h", "_id")
    cut = cut.select(F.when(F.col("take") < F.col("ties"), torn.cast(cut.select(whole.alias("c")).schema["c"].dataType)).otherwise(whole).alias("cut")).scalar()
    return F.coalesce(_place(row_id, seed, hash) <= cut, F.lit(False))


# ---------------------------------------------------------------------------------------- samples


def sample_n(
    df: DataFrame, row_id: str, n: int, seed: int = 42, hash: str = "md5", strict: bool = False, levels: int = 2
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement; a ``row_id`` that is not unique may be an error.

    With ``strict`` asking for more rows than exist raises.
    """
    if n < 0:
        raise ValueError(f"cannot sample {n} rows")
    if strict:
        rows = df.count()
        if n > rows:
            raise ValueError(f"cannot sample {n} of {rows} rows without replacement")
    if n == 0:
        return _no_rows(df)
    return df.where(
        at_or_before_rank(df, row_id, lambda total: F.least(F.lit(n), total).cast("bigint"), seed, hash, levels)
    )


def debug_subset(df: DataFrame, row_id: str, rows: int = 50_000, seed: int = 42, hash: str = "md5") -> DataFrame:
    """Fixed-size trial subset; fewer rows than asked for is an error."""
    return sample_n(df, row_id, rows, seed, hash, strict=True)


def stratified_sample(
    df: DataFrame, row_id: str, class_col: str, sizes: Mapping, seed: int = 42, hash: str = "md5", levels: int = 2
) -> DataFrame:
    """Exactly ``min(sizes[c], rows of c)`` rows of each class named in ``sizes``."""
    sizes = {c: int(n) for c, n in sizes.items() if n > 0}
    if not sizes:
        return _no_rows(df)
    classes = df.where(F.col(class_col).isin(list(sizes)))
    wanted = F.coalesce(*[F.when(F.col(class_col) == c, F.lit(n)) for c, n in sizes.items()])
    cuts = rank_cutoffs(
        _hashed(classes, row_id, seed, hash, [class_col]),
        ["_h", "_id"],
        lambda total: F.array(F.least(wanted, total).cast("bigint")),
        by=[class_col],
        levels=levels,
        n_cuts=len(sizes),
    ).select(class_col, F.struct("_h", "_id").alias("_cut"))
    return (
        classes.join(small_side(cuts, len(sizes)), class_col)
        .where(_place(row_id, seed, hash) <= F.col("_cut"))
        .select(*df.columns)
    )


def per_group_sample(
    df: DataFrame, row_id: str, group_cols: Sequence[str], n: int, seed: int = 42, hash: str = "md5"
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows of every group, in the seeded order; ids may repeat.

    A small ``n`` keeps the first n rows of each group within every task, before anything is exchanged, so at most n rows
    per group and task move, whatever the number of groups.  For a larger ``n`` each group's cutoff row is found by
    counting, as for one sample, so neither a hot group nor a large ``n`` brings a group together.  Rows with one id are
    told apart by their content; equal rows by nothing.
    """
    if n <= 0:
        return _no_rows(df)
    if n <= HEAP_ROWS:
        h = F.coalesce(row_hash(row_id, seed, hash), F.lit(0).cast("bigint"))
        # names that no column of the table has, and keys made before the ranking, so that the limit reaches below the exchange
        marked = df.select(F.struct(*df.columns).alias("_row"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], h.alias("_h"), F.col(row_id).alias("_id"), F.xxhash64(*df.columns).alias("_r"))
        nth = F.row_number().over(Window.partitionBy(*[f"_g{i}" for i in range(len(group_cols))]).orderBy("_h", "_id", "_r"))
        return marked.withColumn("_nth", nth).where(F.col("_nth") <= n).select("_row.*")
    keyed = df.withColumn("_g", F.to_json(F.struct(*group_cols)))  # never null, so no group is lost in the join
    rows = _hashed(keyed, row_id, seed, hash, ["_g", F.xxhash64(*df.columns).alias("_r")])
    cuts = rank_cutoffs(rows, ["_h", "_id", "_r"], lambda total: F.array(F.least(F.lit(n), total).cast("bigint")), by=["_g"])
    cuts = settled(cuts.select("_g", F.struct("_h", "_id", "_r").alias("_cut"), "take", "ties"), "cuts")
    groups, torn = cuts.agg(F.count(F.lit(1)), F.max(F.col("ties") - F.col("take"))).first()
    h = F.coalesce(row_hash(row_id, seed, hash), F.lit(0).cast("bigint"))
    place = F.struct(h.alias("_h"), F.col(row_id).alias("_id"), F.xxhash64(*df.columns).alias("_r"))
    near = keyed.join(small_side(cuts, groups), "_g").withColumn("_place", place)
    if not torn:
        return near.where(F.col("_place") <= F.col("_cut")).select(*df.columns)
    nth = F.row_number().over(Window.partitionBy("_g").orderBy("_place"))
    equal = near.where(F.col("_place") == F.col("_cut")).withColumn("_nth", nth).where(F.col("_nth") <= F.col("take"))
    return near.where(F.col("_place") < F.col("_cut")).select(*df.columns).union(equal.select(*df.columns))


def first_n(df: DataFrame, row_id: str, n: int) -> DataFrame:
    """Exactly ``min(n, rows)`` first rows by an id of any type, nulls first; ids may repeat.

    The n-th row is found by counting buckets; the result is a filter.  Rows with one id are ordered by a
    hash of their content, so only wholly equal rows are ever cut by a limit.
    """
    if n <= 0:
        return _no_rows(df)
    keyed = df.select("*", F.col(row_id).alias("_key"), F.xxhash64(*df.columns).alias("_r"))
    found = cutoff_row(keyed, ["_key", "_r"], n)
    if found is None:
        return df
    row, take, ties = found
    place, cut = F.struct("_key", "_r"), constant(keyed, ["_key", "_r"], row)
    if take == ties:
        return keyed.where(place <= cut).select(*df.columns)
    return keyed.where(place < cut).select(*df.columns).union(keyed.where(place == cut).limit(take).select(*df.columns))


# ---------------------------------------------------------------------------------- running totals


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    bucket: Column | None = None,
    descending: bool = False,
    key_bits: int = 10,
) -> DataFrame:
    """Inclusive running sums of ``sums`` along ``order`` within ``by``, exact for a unique order.

    Without a ``bucket`` the bounds are sampled at once, so ``df`` should be a stored table or cheap to read twice.
    """
    by = list(by)
    if bucket is None:
        tagged, n_buckets = with_growing_buckets(df, order, "_b", key_bits)
    else:
        tagged, n_buckets = df.withColumn("_b", bucket), 2**LEVEL_BITS
    if descending:
        tagged = tagged.withColumn("_b", -F.col("_b"))
    for name, value in sums.items():
        tagged = tagged.withColumn(f"_v_{name}", value)
    totals = tagged.groupBy(*by, "_b").agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    # one row per (group, bucket): small whatever the table size
    ahead = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_g_{c}") for c in by],
        F.col("_b").alias("_g_b"),
        *[F.coalesce(F.sum(f"_t_{name}").over(ahead), F.lit(0)).alias(f"_o_{name}") for name in sums],
    )
    same = F.col("_b") == F.col("_g_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = tagged.join(small_side(offsets, None if by else n_buckets), same)
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    inside = Window.partitionBy(*by, "_b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *df.columns, *[(F.col(f"_o_{name}") + F.sum(f"_v_{name}").over(inside)).alias(name) for name in sums]
    )


def global_ordinal(df: DataFrame, key: str | Sequence[str], name: str = "ordinal", key_bits: int = 10) -> DataFrame:
    """0-based position of every row along one or more columns of any orderable type, nulls first.

    The last column should be unique; rows equal in all of them get positions next to each other.
    """
    order = [key] if isinstance(key, str) else list(key)
    ranked = running_totals(df, order, {"_pos": F.lit(1).cast("bigint")}, key_bits=key_bits)
    return ranked.select(*df.columns, (F.col("_pos") - 1).alias(name))


def shuffle_rank(df: DataFrame, row_id: str, seed: int = 42, hash: str = "md5", name: str = "shuffle_rank") -> DataFrame:
    """1-based rank of every row in the seeded permutation."""
    hashed = df.withColumn("_h", row_hash(row_id, seed, hash))
    ranked = running_totals(
        hashed, ["_h", row_id], {"_pos": F.lit(1).cast("bigint")}, bucket=hash_bucket("_h")
    )
    return ranked.select(*df.columns, F.col("_pos").alias(name))
