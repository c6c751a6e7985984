"""Class counts, table profiles, category codes and class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.scalars import shard_of
from tallyfold.operators.ranking import BROADCAST_ROWS, global_ordinal, running_totals, settled, small_side

# A value that more than one row in this many has is hot; so there are fewer hot values than this.
HOT_VALUES = 10_000


def _label_counts(label: str) -> list[Column]:
    y = F.col(label)
    return [F.count_if(y == 0).alias("neg"), F.count_if(y == 1).alias("pos")]


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """One row ``neg, pos``; null and other labels are in neither."""
    return df.agg(*_label_counts(label))


def class_counts_by(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """``neg, pos`` of every group in one pass, e.g. of all learners' row sets."""
    return df.groupBy(*by).agg(*_label_counts(label))


def class_counts_within(df: DataFrame, label: str, row_id: str, ids: DataFrame) -> DataFrame:
    """``neg, pos`` of the rows named in ``ids``."""
    return class_counts(df.select(row_id, label).join(ids.select(row_id).distinct(), row_id, "left_semi"), label)


def value_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def log_value_counts(df: DataFrame, label: str) -> DataFrame:
    return value_counts(df, label).withColumn("log_n", F.log("n"))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """``neg, pos, scale_pos_weight`` = neg / pos; a table without positives is an error when run."""
    none = F.raise_error(F.lit(f"no row has {label} = 1, so neg / pos is undefined")).cast("double")
    return class_counts(df, label).withColumn(
        "scale_pos_weight", F.when(F.col("pos") == 0, none).otherwise(F.col("neg") / F.col("pos"))
    )


def with_class_weight(
    df: DataFrame, label: str, scale_pos_weight: float | None = None, name: str = "weight"
) -> DataFrame:
    """Weight of a positive row is neg / pos unless given; every other row weighs 1."""
    if scale_pos_weight is None:
        weight = imbalance(df, label).select("scale_pos_weight").scalar()
    else:
        weight = F.lit(float(scale_pos_weight))
    return df.withColumn(name, F.when(F.col(label) == 1, weight).otherwise(F.lit(1.0)))


def running_class_counts(df: DataFrame, label: str, shard: str) -> DataFrame:
    """Class totals up to and including each shard, in shard order."""
    per_shard = class_counts_by(df, label, [shard])
    return running_totals(per_shard, [shard], {"running_neg": F.col("neg"), "running_pos": F.col("pos")})


def with_label(df: DataFrame, label: str, default: int = -1) -> DataFrame:
    """The table with its label, or with ``default`` in every row when it has no label column."""
    return df if label in df.columns else df.withColumn(label, F.lit(default))


def unlabelled_groups(df: DataFrame, group: str, label: str) -> DataFrame:
    """Groups none of whose rows has a label."""
    return (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count(label).alias("n_labelled"))
        .where("n_labelled = 0")
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Type and non-null count of every column, from one aggregate row."""
    counted = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"n{i}").alias("non_null"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counted.select(F.inline(F.array(*entries)))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram over [min, max] with every bin present; the last bin is closed.

    Bin edges follow the usual convention: an empty table spans [0, 1], a constant one ``c ± 0.5``.
    """
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    lo, hi = F.coalesce(F.min("v"), F.lit(0.0)), F.coalesce(F.max("v"), F.lit(1.0))
    span = v.agg(lo.alias("lo"), hi.alias("hi")).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    span = span.select(F.struct("lo", "hi").alias("s")).scalar()
    edge_of = lambda i: F.col("s.lo") + i * ((F.col("s.hi") - F.col("s.lo")) / bins)
    guess = F.least(
        F.floor((F.col("v") - F.col("s.lo")) / (F.col("s.hi") - F.col("s.lo")) * bins).cast("int"), F.lit(bins - 1)
    )
    # the quotient can land one bin off an edge by rounding, so compare with the edges themselves
    fixed = (
        F.col("g")
        - (F.col("v") < edge_of(F.col("g"))).cast("int")
        + ((F.col("v") >= edge_of(F.col("g") + 1)) & (F.col("g") < bins - 1)).cast("int")
    )
    counts = (
        v.withColumn("s", span)
        .withColumn("g", guess)
        .groupBy(fixed.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("s", span)
    return frame.join(counts, "bin", "left").select(
        "bin",
        edge_of(F.col("bin")).alias("low"),
        F.when(F.col("bin") == bins - 1, F.col("s.hi")).otherwise(edge_of(F.col("bin") + 1)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


# ---------------------------------------------------------------------------------- category codes


def dictionary_frame(spark: SparkSession, codes: Mapping[str, int]) -> DataFrame:
    """``value, code`` table of a mapping held on the driver; broadcast when it is small."""
    schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("code", T.IntegerType())])
    return small_side(spark.createDataFrame(list(codes.items()), schema), len(codes))


def encode_category(df: DataFrame, column: str, dictionary: DataFrame, name: str = "code", n_codes: int | None = None) -> DataFrame:
    """Left lookup of a category's code; unknown and null categories get null.

    ``n_codes`` says how many values the dictionary has.  Up to ``BROADCAST_ROWS`` it is broadcast; a larger one is
    looked up by :func:`split_lookup`; without the number the choice is the planner's.
    """
    codes = dictionary.select(F.col("value").alias("_value"), F.col("code").alias(name))
    if n_codes is not None and n_codes > BROADCAST_ROWS:
        return split_lookup(df, column, codes, "_value")
    return df.join(small_side(codes, n_codes), F.col(column) == F.col("_value"), "left").drop("_value")


def split_lookup(df: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
    """``df`` left-joined with a ``table`` that is too large to broadcast and has one row per ``key``; ``key`` goes.

    Values are counted first (map-side).  Hot ones, each more than one row in ``HOT_VALUES`` and so fewer than that, are
    broadcast with what the table holds of them, and their rows stay where they are; so do rows with a null.  All others
    meet by shuffle, and no task gets more than one row in ``HOT_VALUES`` for one value.  ``df`` is read three times, so
    it should be stored.
    """
    value = df.select(F.col(column).alias("_hot"))
    counts = settled(value.where("_hot is not null").groupBy("_hot").agg(F.count(F.lit(1)).alias("_n")), "values")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = settled(counts.where(F.col("_n") * F.lit(HOT_VALUES) > F.lit(total)).select("_hot"), "hot")
    known = table.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "right").drop(key)
    at_once = df.join(F.broadcast(known), F.col(column) == F.col("_hot")).drop("_hot")
    rest = df.join(F.broadcast(hot), F.col(column) == F.col("_hot"), "left_anti")
    # a join would send all nulls to one task
    given, none = rest.where(F.col(column).isNotNull()), rest.where(F.col(column).isNull())
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.drop(key).schema.fields]
    met = given.join(table, F.col(column) == F.col(key), "left").drop(key)
    return at_once.unionByName(met).unionByName(none.select("*", *empty))


def grow_dictionary(df: DataFrame, column: str, row_id: str, dictionary: DataFrame, n_known: int) -> DataFrame:
    """Dictionary extended by the unseen categories of ``df``, coded in order of first appearance.

    One code per category for the whole table, whatever the partitioning.  ``row_id`` may have any type that
    can be ordered and should be unique.  Rows collapse to one per category before anything is joined or ordered.
    """
    seen = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(row_id).alias("first"))
    unseen = seen.join(dictionary.select("value"), "value", "left_anti")
    coded = global_ordinal(settled(unseen, "unseen"), ["first", "value"], name="_pos")
    return dictionary.select("value", "code").unionByName(
        coded.select("value", (F.lit(n_known) + F.col("_pos")).cast("int").alias("code"))
    )


# ------------------------------------------------------------------------------------ learner count


def learner_count(n_rows: int, final_size: int, weak_size: int) -> int:
    """How many weak learners of ``weak_size`` rows fit beside ``final_size`` rows (-1: all rows are theirs)."""
    pool = n_rows if final_size == -1 else n_rows - final_size
    if pool <= 0:
        raise ValueError(f"final model takes {final_size} of {n_rows} rows and leaves none for weak learners")
    k = pool // weak_size
    if k == 0:
        raise ValueError(f"a weak learner of {weak_size} rows does not fit into {pool} rows")
    return k


def learner_count_table(df: DataFrame, final_size: int, weak_size: int) -> DataFrame:
    """``n_rows, pool, num_weak`` with the same two error cases, as one lazy row."""
    pool = F.col("n_rows") if final_size == -1 else F.col("n_rows") - F.lit(final_size)
    k = shard_of(F.col("pool"), weak_size)
    fail = lambda text: F.raise_error(F.lit(text)).cast("bigint")
    return (
        df.agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("pool", pool)
        .withColumn(
            "num_weak",
            F.when(F.col("pool") <= 0, fail("the final model leaves no rows for weak learners"))
            .when(k == 0, fail("a weak learner does not fit into the remaining rows"))
            .otherwise(k),
        )
    )
