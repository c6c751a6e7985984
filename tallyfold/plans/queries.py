"""Registered queries: one or more per operator, each over whole tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.hashing import md5_60
from tallyfold.functions.scalars import (
    above,
    add_code,
    append_code,
    file_stem,
    in_shard,
    offset_in_shard,
    shard_of,
)
from tallyfold.operators import fingerprints as fp
from tallyfold.operators import boosting, graphs, labels, learning, metrics, ranking, rowsets, structure
from tallyfold.plans import oracle as sql
from tallyfold.plans.job import load_run, run_job
from tallyfold.plans.params import Columns, JobParams
from tallyfold.session import scratch_path, spread
from tallyfold.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query and, where there is one, its SQL twin."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/{name}.parquet")


def pseudo_score(text: Column) -> Column:
    return F.pmod(md5_60(text), F.lit(1000)) / F.lit(1000.0)


def joined(bits: str | Column) -> Column:
    return F.array_join(F.col(bits).cast("array<string>") if isinstance(bits, str) else bits, ",")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return rounded_to(df, 6, *names)


def rounded_to(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def documents_with_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


# ============================================================================ scans, sources, sinks


@query(
    "s1_parquet_scan",
    "select doc_id, md5(text) as text_md5, lang, source, n_chars from documents",
)
def s1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query("s2_row_count", "select count(*) as n_rows from documents")
def s2(spark, d):
    return tables.row_count(table(spark, d, "documents"))


@query(
    "s3_storage_profile",
    "select 'lineitem' as file, count(*) as n_rows from lineitem union all select 'orders', count(*) from orders",
)
def s3(spark, d):
    """Rows per file, summed over its splits."""
    both = tables.storage_profile(table(spark, d, "lineitem")).union(tables.storage_profile(table(spark, d, "orders")))
    return both.groupBy(file_stem(F.col("file")).alias("file")).agg(F.sum("n_rows").alias("n_rows"))


@query(
    "s3_row_group_profile",
    """select 'lineitem' as file, 0::bigint as first_row, count(*) as n_rows, 0::bigint as n_lost from lineitem
       union all select 'orders', 0, count(*), 0 from orders union all select 'events', 0, count(*), 0 from events""",
)
def s3_groups(spark, d):
    """Rows per file from the runs of row numbers in its splits; ``n_lost`` counts gaps within and between the splits."""
    splits = None
    for name in ("lineitem", "orders", "events"):
        found = tables.split_profile(table(spark, d, name))
        splits = found if splits is None else splits.union(found)
    inside = F.sum(F.col("last_row") - F.col("first_row") + 1 - F.col("n_rows"))
    between = F.max("last_row") - F.min("first_row") + 1 - F.sum(F.col("last_row") - F.col("first_row") + 1)
    found = splits.groupBy("file").agg(F.min("first_row").alias("first_row"), F.sum("n_rows").alias("n_rows"), (inside + between).alias("n_lost"))
    # one row per table file; check tables have many files of one name
    return found.groupBy(file_stem(F.regexp_replace("file", r"\.parquet/.*$", ".parquet")).alias("file")).agg(F.min("first_row").alias("first_row"), F.sum("n_rows").alias("n_rows"), F.sum("n_lost").alias("n_lost"))


@query("s4_row_index", "select o_orderkey, row_number() over () - 1 as row_index from orders")
def s4(spark, d):
    return tables.with_row_index(table(spark, d, "orders")).select("o_orderkey", "row_index")


@query(
    "s5_shard_scan",
    """select o_orderkey, row_index from (select o_orderkey, row_number() over () - 1 as row_index from orders)
       where row_index // 1000 between 0 and 13""",
)
def s5(spark, d):
    return tables.read_shards(table(spark, d, "orders"), list(range(14)), 1000).select("o_orderkey", "row_index")


@query(
    "s5_shards_by_zone_map",
    """select o_orderkey, row_index from (select o_orderkey, row_number() over () - 1 as row_index from orders)
       where row_index // 1000 in (2, 3, 11)""",
)
def s5_zones(spark, d):
    path = scratch_path(spark, "sharded")
    tables.write_sharded(table(spark, d, "orders"), path, 1000, files=16)
    return tables.read_sharded(spark, path, [2, 3, 11]).select("o_orderkey", "row_index")


@query("s6_parquet_sink", "select o_orderkey, o_totalprice from orders")
def s6(spark, d):
    path = scratch_path(spark, "parquet")
    tables.write_table(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), path, rows_per_group=500)
    return tables.read_table(spark, path)


@query("s7_s8_csv_sink_and_source", "select c_custkey, c_name, c_acctbal from customer")
def s7(spark, d):
    path = scratch_path(spark, "csv")
    tables.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return tables.read_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("s9_json_dictionary", "select n_name as value, n_nationkey as code from nation")
def s9(spark, d):
    path = scratch_path(spark, "json")
    entries = F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))
    table(spark, d, "nation").agg(F.to_json(entries).alias("value")).write.text(path)
    return tables.read_dictionary(spark, f"{path}/*.txt")


@query(
    "s10_membership_sets",
    f"""select o_orderkey, 'val' as split from
        (select o_orderkey, row_number() over (order by {sql.seeded('o_orderkey')}, o_orderkey) as r, count(*) over () as n from orders)
        where r > trunc(0.8::double * n)""",
)
def s10(spark, d):
    path = scratch_path(spark, "members")
    split = rowsets.split_train_val(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    tables.write_membership(split, path, "o_orderkey", ["split"])
    return tables.read_membership(spark, path, split="val")


# ======================================================================== projections and predicates


@query("p1_projection", "select doc_id, lang from documents")
def p1(spark, d):
    return tables.read_table(spark, f"{d}/documents.parquet", ["doc_id", "lang"])


@query("p2_label_filter", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'R'")
def p2(spark, d):
    flagged = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R")
    return flagged.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "p3_shard_range",
    """select o_orderkey, i - 3000 as relative from (select o_orderkey, row_number() over () - 1 as i from orders)
       where i >= 3000 and i < 4000""",
)
def p3(spark, d):
    rows = tables.with_row_index(table(spark, d, "orders"), "i").where(in_shard(F.col("i"), 3, 1000))
    return rows.select("o_orderkey", offset_in_shard(F.col("i"), 1000).alias("relative"))


@query(
    "p4_shard_and_offset",
    """select o_orderkey, i // 1000 as shard, i % 1000 as relative
       from (select o_orderkey, row_number() over () - 1 as i from orders)""",
)
def p4(spark, d):
    rows, i = tables.with_row_index(table(spark, d, "orders"), "i"), F.col("i")
    return rows.select("o_orderkey", shard_of(i, 1000).alias("shard"), offset_in_shard(i, 1000).alias("relative"))


@query(
    "p5_strict_threshold",
    f"select event_id, {sql.pseudo_score('event_id::varchar')} > 0.5 as predicted from events",
)
def p5(spark, d):
    score = pseudo_score(F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", above(score).alias("predicted"))


@query("p6_default_label", "select doc_id, -1 as quality from documents")
def p6(spark, d):
    return labels.with_label(table(spark, d, "documents"), "quality").select("doc_id", "quality")


@query(
    "p7_unlabelled_groups",
    """select doc_id // 4 as shard, count(*) as n_rows, count(quality) as n_labelled
       from documents left join labels using (doc_id) group by 1 having count(quality) = 0""",
)
def p7(spark, d):
    rows = documents_with_labels(spark, d).withColumn("shard", shard_of(F.col("doc_id"), 4))
    return labels.unlabelled_groups(rows, "shard", "quality")


# ============================================================================================= joins

CODES = {"en": 0, "fr": 1}


@query(
    "j1_dictionary_lookup",
    "select doc_id, case lang when 'en' then 0 when 'fr' then 1 end as code from documents",
)
def j1(spark, d):
    known = labels.dictionary_frame(spark, CODES)
    return labels.encode_category(table(spark, d, "documents").select("doc_id", "lang"), "lang", known).drop("lang")


RETURNED = "(select distinct l_orderkey from lineitem where l_returnflag = 'R')"


def returned_orders(spark, d):
    flagged = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R")
    return flagged.select(F.col("l_orderkey").alias("o_orderkey"))


@query("j2_rows_in_set", f"select o_orderkey, o_totalprice from orders where o_orderkey in {RETURNED}")
def j2(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rowsets.keep_ids(orders, "o_orderkey", returned_orders(spark, d))


@query("j3_rows_not_in_set", f"select o_orderkey, o_totalprice from orders where o_orderkey not in {RETURNED}")
def j3(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rowsets.drop_ids(orders, "o_orderkey", returned_orders(spark, d))


@query(
    "j4_zip_scores_with_labels",
    f"""select doc_id, quality, {sql.pseudo_score('doc_id::varchar')} as score
        from documents join labels using (doc_id)""",
)
def j4(spark, d):
    scores = table(spark, d, "documents").select("doc_id", pseudo_score(F.col("doc_id").cast("string")).alias("score"))
    return rowsets.zip_scores(table(spark, d, "labels").select("doc_id", "quality"), scores, "doc_id")


@query(
    "j5_one_column_per_learner",
    "select o_orderkey, "
    + ", ".join(f"""{sql.pseudo_score(f"o_orderkey || ':{i}'")} as weak_{i}""" for i in range(3))
    + " from orders",
)
def j5(spark, d):
    long = table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    score = pseudo_score(F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("i").cast("string")))
    long = long.select("o_orderkey", F.concat(F.lit("weak_"), F.col("i")).alias("learner"), score.alias("score"))
    return rowsets.widen_scores(long, "o_orderkey", "learner", "score", [f"weak_{i}" for i in range(3)])


# ====================================================================================== aggregations


def lineitem_labels(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"))


@query(
    "a1_class_counts",
    "select count(*) filter (where l_returnflag <> 'R') as neg, count(*) filter (where l_returnflag = 'R') as pos from lineitem",
)
def a1(spark, d):
    return labels.class_counts(lineitem_labels(spark, d), "y")


@query(
    "a2_class_counts_within_set",
    f"""select count(*) filter (where o_orderstatus <> 'P') as neg, count(*) filter (where o_orderstatus = 'P') as pos
        from orders where o_orderkey in {RETURNED}""",
)
def a2(spark, d):
    rows = order_labels(spark, d)
    return labels.class_counts_within(rows, "y", "o_orderkey", returned_orders(spark, d))


@query(
    "a2_class_counts_per_learner",
    f"""select (r - 1) // 1000 as learner, count(*) filter (where y = 0) as neg, count(*) filter (where y = 1) as pos
        from (select row_number() over (order by {sql.seeded('o_orderkey')}, o_orderkey) as r,
                     (o_orderstatus = 'P')::int as y from orders)
        group by 1""",
)
def a2_learners(spark, d):
    ranked = ranking.shuffle_rank(order_labels(spark, d), "o_orderkey")
    ranked = ranked.withColumn("learner", shard_of(F.col("shuffle_rank") - 1, 1000))
    return labels.class_counts_by(ranked, "y", ["learner"])


@query("a3_value_counts", "select l_returnflag, count(*) as n from lineitem group by 1")
def a3(spark, d):
    return labels.value_counts(table(spark, d, "lineitem"), "l_returnflag")


@query(
    "a4_imbalance_ratio",
    """select neg, pos, neg::double / pos as scale_pos_weight from (
         select count(*) filter (where quality = 0) as neg, count(*) filter (where quality = 1) as pos from labels)""",
)
def a4(spark, d):
    return labels.imbalance(table(spark, d, "labels"), "quality")


@query(
    "a5_x2_log_class_counts",
    "select l_returnflag, count(*) as n, round(ln(count(*)), 6) as log_n from lineitem group by 1",
)
def a5(spark, d):
    return rounded(labels.log_value_counts(table(spark, d, "lineitem"), "l_returnflag"), "log_n")


EVENT_ROWS = f"select {sql.pseudo_score('event_id::varchar')} as score, (event_type = 'error')::int as y from events"


def scored_events(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        pseudo_score(F.col("event_id").cast("string")).alias("score"),
        (F.col("event_type") == "error").cast("int").alias("y"),
    )


@query(
    "a6_accuracy",
    f"select round(avg(((score > 0.5)::int = y)::int), 6) as accuracy from ({EVENT_ROWS})",
)
def a6(spark, d):
    return rounded(metrics.accuracy(scored_events(spark, d), "score", "y"), "accuracy")


METRICS = ("roc_auc", "average_precision", "accuracy")


@query(
    "a7_a8_auc_and_ap_distinct_scores",
    sql.metrics_from("select l_extendedprice as score, (l_returnflag = 'R')::int as y from lineitem"),
)
def a7(spark, d):
    rows = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(metrics.binary_metrics(rows, "l_extendedprice", "y"), *METRICS)


@query(
    "a7_a8_auc_and_ap_tied_scores",
    sql.metrics_from("select l_discount * 10 as score, (l_returnflag = 'R')::int as y from lineitem"),
)
def a8(spark, d):
    rows = table(spark, d, "lineitem").select(
        (F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y")
    )
    return rounded(metrics.binary_metrics(rows, "score", "y"), *METRICS)


@query("a9_histogram", sql.histogram_of("select o_totalprice as v from orders"))
def a9(spark, d):
    return rounded(labels.histogram(table(spark, d, "orders"), "o_totalprice"), "low", "high")


PROFILE = [
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
    ("quality", "int"), ("toxic", "int"),
]


@query(
    "a10_table_profile",
    " union all ".join(
        f"""select {i} as position, '{c}' as "column", '{t}' as dtype, count({c}) as non_null
            from documents left join labels using (doc_id)"""
        for i, (c, t) in enumerate(PROFILE)
    ),
)
def a10(spark, d):
    return labels.table_profile(documents_with_labels(spark, d))


STAGED_ROWS = (
    "select i::int as round, case when "
    + sql.h60("'7:' || o_orderkey")
    + " % 5 = 0 then 'val' else 'train' end as split, "
    + sql.pseudo_score("o_orderkey || ':' || i")
    + " as score, (o_orderstatus = 'F')::int as y from orders, range(10) t(i)"
)


def staged_rows(spark, d):
    rows = spread(table(spark, d, "orders").select("o_orderkey", "o_orderstatus")).select(
        "o_orderkey", "o_orderstatus", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("round")
    )
    key = F.col("o_orderkey").cast("string")
    in_val = F.pmod(md5_60(F.concat(F.lit("7:"), key)), F.lit(5)) == 0
    return rows.select(
        "round",
        F.when(in_val, "val").otherwise("train").alias("split"),
        pseudo_score(F.concat_ws(":", key, F.col("round").cast("string"))).alias("score"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
    )


@query("a11_metric_curve", sql.metrics_from(STAGED_ROWS, "round, split"))
def a11(spark, d):
    return rounded(metrics.round_curve(staged_rows(spark, d), "round", "split", "score", "y"), *METRICS)


GROWN = """
    select lang as value, 2 + row_number() over (order by min(doc_id)) - 1 as code
    from documents where lang not in ('en', 'fr') group by lang"""


@query(
    "a12_dictionary_growth",
    f"select 'en' as value, 0 as code union all select 'fr', 1 union all select value, code::int from ({GROWN})",
)
def a12(spark, d):
    known = labels.dictionary_frame(spark, CODES)
    return labels.grow_dictionary(table(spark, d, "documents"), "lang", "doc_id", known, len(CODES))


@query("a12_dictionary_growth_by_string_id", f"select 'en' as value, 0 as code union all select 'fr', 1 union all select value, code::int from ({GROWN.replace('min(doc_id)', "min('d' || doc_id)")})")
def a12_string(spark, d):
    docs = table(spark, d, "documents").select("lang", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"))
    return labels.grow_dictionary(docs, "lang", "key", labels.dictionary_frame(spark, CODES), len(CODES))


@query(
    "a13_learner_count",
    """select n as n_rows, n - 50 as pool, (n - 50) // 60 as num_weak from (select count(*) as n from documents)""",
)
def a13(spark, d):
    return labels.learner_count_table(table(spark, d, "documents"), 50, 60)


# ================================================================================= window-shaped rows


@query("w1_global_ordinal", "select event_id, row_number() over (order by ts, event_id) - 1 as ordinal from events")
def w1(spark, d):
    return ranking.global_ordinal(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"]).drop("ts")


@query(
    "w1_global_ordinal_by_string",
    "select event_id, row_number() over (order by event_type, event_id) - 1 as ordinal from events",
)
def w1_string(spark, d):
    return ranking.global_ordinal(table(spark, d, "events").select("event_id", "event_type"), ["event_type", "event_id"]).drop("event_type")


@query(
    "w2_running_class_counts",
    """select shard, neg, pos, (sum(neg) over (order by shard))::bigint as running_neg,
              (sum(pos) over (order by shard))::bigint as running_pos
       from (select i // 500 as shard, count(*) filter (where y = 0) as neg, count(*) filter (where y = 1) as pos
             from (select row_number() over () - 1 as i, (o_orderstatus = 'P')::int as y from orders) group by 1)""",
)
def w2(spark, d):
    rows = tables.with_row_index(table(spark, d, "orders"), "i")
    rows = rows.select(shard_of(F.col("i"), 500).alias("shard"), (F.col("o_orderstatus") == "P").cast("int").alias("y"))
    return labels.running_class_counts(rows, "y", "shard")


@query(
    "w3_shuffle_rank",
    f"""select o_orderkey, row_number() over (order by {sql.seeded('o_orderkey')}, o_orderkey) as shuffle_rank from orders""",
)
def w3(spark, d):
    return ranking.shuffle_rank(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "w4_sample_per_group_and_class",
    f"""select event_id, event_type, y from (
          select event_id, event_type, (value > 50)::int as y,
                 row_number() over (partition by event_type, value > 50 order by {sql.seeded('event_id')}, event_id) as r
          from events) where r <= 2""",
)
def w4(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", (F.col("value") > 50).cast("int").alias("y"))
    return ranking.per_group_sample(rows, "event_id", ["event_type", "y"], 2)


@query(
    "w4_large_sample_per_group",
    f"""select event_id, event_type from (
          select event_id, event_type, row_number() over (partition by event_type order by {sql.seeded('event_id')}, event_id) as r
          from events) where r <= 700""",
)
def w4_large(spark, d):
    return ranking.per_group_sample(table(spark, d, "events").select("event_id", "event_type"), "event_id", ["event_type"], 700)


def sql_group_sample(n: int) -> str:
    return f"""select event_id, event_type from (
          select event_id, event_type, row_number() over (partition by event_type order by {sql.seeded('event_id')}, event_id) as r
          from events) where r <= {n}"""


def group_sample(n: int) -> Query:
    return lambda spark, d: ranking.per_group_sample(table(spark, d, "events").select("event_id", "event_type"), "event_id", ["event_type"], n)


for rows_per_group in (500, 501):
    query(f"w4_sample_of_{rows_per_group}_per_group", sql_group_sample(rows_per_group))(group_sample(rows_per_group))


# ================================================================================== samples and limits


@query(
    "k1_sample_exact_n",
    f"select o_orderkey, o_totalprice from orders order by {sql.seeded('o_orderkey')}, o_orderkey limit 5003",
)
def k1(spark, d):
    return ranking.sample_n(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5003)


@query(
    "k2_stratified_sample",
    f"""(select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'F'
         order by {sql.seeded('o_orderkey')}, o_orderkey limit 1500)
        union all
        (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'O'
         order by {sql.seeded('o_orderkey')}, o_orderkey limit 789)""",
)
def k2(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ranking.stratified_sample(orders, "o_orderkey", "o_orderstatus", {"F": 1500, "O": 789})


@query("k3_first_n_by_id", "select o_orderkey, o_custkey from orders order by o_orderkey limit 1000")
def k3(spark, d):
    return ranking.first_n(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000)


@query("k3_first_n_of_repeated_ids", "select o_custkey, count(*) as n from (select o_custkey from orders order by o_custkey limit 1234) group by 1")
def k3_repeated(spark, d):
    first = ranking.first_n(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 1234)
    return first.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("k3_first_n_by_string", "select c_name from customer order by c_name limit 120")
def k3_string(spark, d):
    return ranking.first_n(table(spark, d, "customer").select("c_name"), "c_name", 120)


@query("k3_first_most", "select l_orderkey, count(*) as n from (select l_orderkey from lineitem order by l_orderkey limit (select count(*) - 7 from lineitem)) group by 1")
def k3_most(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return ranking.first_n(lines, "l_orderkey", lines.count() - 7).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k4_sorted_id_set",
    f"select distinct o_orderkey from orders where o_orderkey not in {RETURNED} order by o_orderkey",
)
def k4(spark, d):
    return rowsets.id_difference(table(spark, d, "orders"), returned_orders(spark, d), "o_orderkey").orderBy("o_orderkey")


@query("k5_preview", "select doc_id, lang, source from documents order by doc_id limit 5")
def k5(spark, d):
    return ranking.first_n(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", 5)


@query(
    "k6_debug_subset",
    f"select event_id, event_type from events order by {sql.seeded('event_id')}, event_id limit 900",
)
def k6(spark, d):
    return ranking.debug_subset(table(spark, d, "events").select("event_id", "event_type"), "event_id", 900)


@query(
    "u1_union_all",
    "select c_name as name, c_acctbal as balance from customer union all select s_name, s_acctbal from supplier",
)
def u1(spark, d):
    left = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    right = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return left.unionByName(right)


@query("u2_id_difference", "select doc_id from documents except select doc_id from labels")
def u2(spark, d):
    return rowsets.id_difference(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


# ========================================================================================== row sets


@query(
    "c1_train_size_cap",
    f"select doc_id, lang from documents order by {sql.seeded('doc_id')}, doc_id limit 500",
)
def c1(spark, d):
    return rowsets.cap_train_size(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 500)


@query(
    "c2_train_val_split",
    f"""select doc_id, case when r <= trunc(0.8::double * n) then 'train' else 'val' end as split from (
          select doc_id, row_number() over (order by {sql.seeded('doc_id')}, doc_id) as r, count(*) over () as n from documents)""",
)
def c2(spark, d):
    return rowsets.split_train_val(table(spark, d, "documents").select("doc_id"), "doc_id")


def order_labels(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").cast("int").alias("y"))


@query(
    "c3_positive_top_up",
    f"""with o as (select o_orderkey, (o_orderstatus = 'P')::int as y from orders),
        working as (select * from o order by {sql.seeded('o_orderkey')}, o_orderkey limit 3000),
        want as (select floor(count(*) filter (where y = 0) / 1.5::double - count(*) filter (where y = 1))::bigint as n from o),
        drawn as (select o_orderkey, y, row_number() over (order by {sql.seeded('o_orderkey', 7)}, o_orderkey) as r
                  from o where y = 1)
        select o_orderkey, y from working
        union all
        select o_orderkey, y from drawn, want where r <= want.n and o_orderkey not in (select o_orderkey from working)""",
)
def c3(spark, d):
    orders = order_labels(spark, d)
    working = rowsets.cap_train_size(orders, "o_orderkey", 3000)
    return rowsets.top_up_positives(working, orders, "o_orderkey", "y", 1.5, seed=7)


@query(
    "c4_learner_allotment",
    f"""with s as (select count(*) as n, count(*) // 7 as weak, count(*) // 5 as final_size from orders),
        pool as (select o_orderkey, weak, (n - final_size) // weak as k,
                        row_number() over (order by {sql.seeded('o_orderkey')}, o_orderkey) as r
                 from (select *, row_number() over (order by o_orderkey) - 1 as i from orders), s where i < n - final_size)
        select o_orderkey, case when r <= k * weak then ((r - 1) // weak)::varchar else 'final' end as learner
        from orders left join pool using (o_orderkey)""",
)
def c4(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    n = orders.count()
    return rowsets.allot_learners(orders, "o_orderkey", n // 7, n // 5)


@query(
    "c4_learner_allotment_by_string_id",
    f"""with o as (select 'o' || o_orderkey as id from orders),
        s as (select count(*) as n, count(*) // 7 as weak, count(*) // 5 as final_size from o),
        pool as (select id, weak, (n - final_size) // weak as k, row_number() over (order by {sql.seeded('id')}, id) as r
                 from (select *, row_number() over (order by id) - 1 as i from o), s where i < n - final_size)
        select id, case when r <= k * weak then ((r - 1) // weak)::varchar else 'final' end as learner
        from o left join pool using (id)""",
)
def c4_string(spark, d):
    orders = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    n = orders.count()
    return rowsets.allot_learners(orders, "id", n // 7, n // 5)


@query(
    "c5_class_weight",
    """select doc_id, quality, case when quality = 1 then w else 1.0::double end as weight
       from labels, (select count(*) filter (where quality = 0)::double / count(*) filter (where quality = 1) as w from labels)""",
)
def c5(spark, d):
    return labels.with_class_weight(table(spark, d, "labels"), "quality").select("doc_id", "quality", "weight")


# ==================================================================================== scalar functions


@query(
    "x1_integer_arithmetic",
    """select o_orderkey, trunc(o_totalprice * 0.8::double)::bigint as truncated, o_orderkey // 7 as quotient,
              least(o_orderkey, 1000) as capped, round(o_totalprice / (o_orderkey + 1), 6) as ratio from orders""",
)
def x1(spark, d):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey",
        (price * F.lit(0.8)).cast("bigint").alias("truncated"),
        shard_of(key, 7).alias("quotient"),
        F.least(key, F.lit(1000)).cast("bigint").alias("capped"),
        F.round(price / (key + 1), 6).alias("ratio"),
    )


@query(
    "x3_hash_and_fold",
    f"select c_custkey, ({sql.h60('c_name')} % 1024)::int as bit from customer",
)
def x3(spark, d):
    from tallyfold.functions.hashing import fold

    return table(spark, d, "customer").select("c_custkey", fold(md5_60(F.col("c_name")), 1024).alias("bit"))


@query("x5_file_stem", "select page_id, split_part(regexp_replace(url, '^.*/', ''), '.', 1) as stem from pages")
def x5(spark, d):
    return table(spark, d, "pages").select("page_id", file_stem(F.col("url")).alias("stem"))


@query("x6_null_test", "select doc_id, quality is null as unlabelled from documents left join labels using (doc_id)")
def x6(spark, d):
    return documents_with_labels(spark, d).select("doc_id", F.col("quality").isNull().alias("unlabelled"))


# ======================================================================================== fingerprints

RADIUS, N_BITS = 2, 256


def document_bits(spark, d, hash: str = "md5") -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text"))
    return fp.token_chain_bits(docs, "text", RADIUS, N_BITS, hash=hash)


@query("f3_token_chain_fingerprint", sql.token_chain_sql(RADIUS, N_BITS))
def f3(spark, d):
    return document_bits(spark, d).select("doc_id", joined("bits").alias("bits"))


@query(
    "f3_token_chain_fingerprint_fast_hash",
    r"select doc_id, case when regexp_matches(text, '[^ \t\r\n]') then true end as in_range from documents",
)
def f3_xx(spark, d):
    """Another hash sets other bits, so only their range can be checked in SQL."""
    return document_bits(spark, d, "xx").select("doc_id", (F.array_max("bits") < N_BITS).alias("in_range"))


@query("f4_pattern_key_fingerprint", sql.pattern_key_sql("pages", "page_id", "html", fp.PROSE_KEYS))
def f4(spark, d):
    pages = spread(table(spark, d, "pages").select("page_id", "html"))
    return fp.pattern_key_bits(pages, "html", fp.PROSE_KEYS).select("page_id", joined("bits").alias("bits"))


@query(
    "f4_pattern_key_fingerprint_notation",
    f"with {sql.NOTATION} " + sql.pattern_key_sql("strings", "g as p_partkey", "s", fp.NOTATION_KEYS),
)
def f4_notation(spark, d):
    return fp.pattern_key_bits(notation(spark, d), "s", fp.NOTATION_KEYS).select("p_partkey", joined("bits").alias("bits"))


def notation(spark, d) -> DataFrame:
    """A line-notation string per part, put together from fragments by its key."""
    k, frags = F.col("p_partkey"), F.array(*[F.lit(f) for f in sql.FRAGMENTS])
    pick = lambda step: F.get(frags, F.pmod(shard_of(k, step), F.lit(12)).cast("int"))
    salt = F.when(F.pmod("p_size", F.lit(5)) == 0, ".[Na+]").otherwise("")
    return table(spark, d, "part").select("p_partkey", F.concat(pick(1), pick(12), pick(144), salt).alias("s"))


@query("f5_notation_nodes", f"with {sql.GRAPH} select * from nodes")
def f5_nodes(spark, d):
    return graphs.notation_tables(notation(spark, d), "p_partkey", "s")[0]


@query(
    "f5_notation_edges",
    f"with {sql.GRAPH} select graph_id, least(src, dst) as a, greatest(src, dst) as b, label from edges",
)
def f5_edges(spark, d):
    edges = graphs.notation_tables(notation(spark, d), "p_partkey", "s")[1]
    return edges.select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "label")


@query("f6_graph_fingerprint_tables", sql.graph_bits_sql(2, N_BITS))
def f6(spark, d):
    nodes, edges = graphs.notation_tables(spread(notation(spark, d)), "p_partkey", "s")
    at = scratch_path(spark, "graphs")
    tables.write_table(nodes, f"{at}/nodes")
    tables.write_table(edges, f"{at}/edges")
    bits = graphs.graph_bits(spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/edges"), 2, N_BITS)
    return bits.select(F.col("graph_id").alias("p_partkey"), joined("bits").alias("bits"))


@query("f6_graph_fingerprint_rows", sql.graph_bits_sql(3, 1024))
def f6_rows(spark, d):
    bits = graphs.notation_bits(spread(notation(spark, d)), "s", 3, 1024)
    return bits.select("p_partkey", joined("bits").alias("bits"))


@query("f5_structure_counts", sql.structure_counts_sql())
def f5_structure(spark, d):
    """Atoms, bonds, bonds in rings and hydrogens of every string."""
    seen = structure.perceive(spread(notation(spark, d)), "s", "x")
    ringed = F.size(F.filter("x.bonds", lambda b: b["in_ring"])).cast("bigint")
    hydrogens = F.aggregate("x.atoms", F.lit(0).cast("bigint"), lambda n, a: n + a["hydrogens"])
    sizes = [F.size(f"x.{c}").cast("bigint").alias(f"n_{c}") for c in ("atoms", "bonds")]
    return seen.select("p_partkey", *sizes, ringed.alias("n_ring_bonds"), hydrogens.alias("n_hydrogens"))


@query("f4_structure_key_fingerprint", sql.structure_keys_sql(structure.STRUCTURE_KEYS))
def f4_structure(spark, d):
    bits = structure.structure_key_bits(spread(notation(spark, d)), "s")
    return bits.select("p_partkey", joined("bits").alias("bits"))


GROWN_CODES = f"(select 'en' as value, 0 as code union all select 'fr', 1 union all select value, code::int from ({GROWN}))"


def coded_documents(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    known = labels.dictionary_frame(spark, CODES)
    grown = ranking.settled(labels.grow_dictionary(docs, "lang", "doc_id", known, len(CODES)), "codes")
    grown = ranking.small_side(grown, grown.count())
    bits = fp.pattern_key_bits(spread(docs.select("doc_id", "lang", "text")), "text", fp.PROSE_KEYS)
    return fp.with_category_code(bits, "lang", grown)


DOC_KEYS = sql.pattern_key_sql("documents", "doc_id, lang", "text", fp.PROSE_KEYS)


@query(
    "f7_x4_category_code_appended",
    f"""select doc_id, code, case when bits = '' then '' else bits || ',' end || '24=' || code as feature_row
        from ({DOC_KEYS}) join {GROWN_CODES} on lang = value""",
)
def f7(spark, d):
    row = append_code(F.col("bits"), F.col("code"), 24)
    spelled = F.transform(
        row,
        lambda f: F.when(f["index"] < 24, f["index"].cast("string")).otherwise(
            F.concat_ws("=", f["index"].cast("string"), f["value"].cast("int").cast("string"))
        ),
    )
    return coded_documents(spark, d).select("doc_id", "code", F.array_join(spelled, ",").alias("feature_row"))


@query(
    "f7_category_code_added",
    f"""select doc_id, ((case when bits = '' then 0 else len(string_split(bits, ',')) end) + 24 * code)::double as total
        from ({DOC_KEYS}) join {GROWN_CODES} on lang = value""",
)
def f7_add(spark, d):
    dense = add_code(F.col("bits"), F.col("code"), 24)
    total = F.aggregate(dense, F.lit(0.0), lambda a, x: a + x)
    return coded_documents(spark, d).select("doc_id", total.alias("total"))


@query(
    "f9_bits_to_vector",
    f"select p_partkey, bits, len(string_split(bits, ','))::double as vector_sum from ({sql.graph_bits_sql(2, N_BITS)})",
)
def f9(spark, d):
    rows = graphs.notation_bits(spread(notation(spark, d)), "s", 2, N_BITS)
    dense = vector_to_array("features")
    on = F.filter(F.sequence(F.lit(0), F.lit(N_BITS - 1)), lambda i: F.get("dense", i) == 1.0)
    rows = fp.bits_to_vector(rows, "bits", N_BITS).withColumn("dense", dense)
    total = F.aggregate("dense", F.lit(0.0), lambda a, x: a + x)
    return rows.select("p_partkey", joined(on.cast("array<string>")).alias("bits"), total.alias("vector_sum"))


def letters_present(text: str) -> list[int]:
    """Example of a user kernel: which of a–z occur."""
    return [ord(c) - 97 for c in set(text) if "a" <= c <= "z"]


@query(
    "u_1_f2_user_kernel",
    "select doc_id, array_to_string(list_filter(["
    + ", ".join(f"case when contains(text, '{chr(97 + i)}') then {i} end" for i in range(26))
    + "], lambda x: x is not null), ',') as bits from documents",
)
def user_kernel(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return fp.user_kernel_bits(docs, "text", letters_present).select("doc_id", joined("bits").alias("bits"))


# ============================================================================== learning and evaluation

SMALL = learning.BoostParams(
    max_depth=3, num_boost_round=3, eta=0.3, subsample=1.0, colsample_bytree=1.0, early_stopping_rounds=2, partitions=8
)


def document_features(spark, d) -> DataFrame:
    """Bits, label, split and class weight of every document (nulls where there is no label), written once."""
    path = scratch_path(spark, "features")
    split = rowsets.split_train_val(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    split = labels.with_class_weight(split, "quality")
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    bits = fp.token_chain_bits(docs, "text", 1, 1024, hash="xx").select("doc_id", "bits")
    bits.join(split, "doc_id", "left").write.parquet(path)
    return boosting.model_inputs(spark.read.parquet(path), "bits").drop("bits")


def fitted(spark, d) -> tuple[learning.BoostedModel, DataFrame, DataFrame]:
    """Model on the labelled documents; their rows with a split; and the rows without a label."""
    rows = document_features(spark, d)
    known = rows.where(F.col("quality").isNotNull())
    model, _ = learning.train_rounds(known, "quality", SMALL, "doc_id", "split", "weight")
    return model, known, rows.where(F.col("quality").isNull())


def in_unit(score: str) -> Column:
    return F.col(score).between(0.0, 1.0)


LABELLED_SPLIT = f"""
    select doc_id, case when r <= trunc(0.8::double * n) then 'train' else 'val' end as split from (
      select doc_id, row_number() over (order by {sql.seeded('doc_id')}, doc_id) as r, count(*) over () as n
      from documents join labels using (doc_id))"""


@query("l1_l2_l4_train_and_score", f"select doc_id, split, true as same from ({LABELLED_SPLIT})")
def l4(spark, d):
    """Scores of the one-pass scorer beside those that the training left in its margin table, row by row."""
    known = document_features(spark, d).where(F.col("quality").isNotNull())
    run = boosting.Boosting(known, "doc_id", "quality", "split", boosting.Growth(max_depth=3), "weight")
    for _ in range(2):
        run.step()
    grown = run.state.select(F.col("row_id").alias("doc_id"), (1 / (1 + F.exp(-F.col("margin")))).alias("grown"))
    both = run.model.score(known).join(grown, "doc_id")
    return both.select("doc_id", "split", (F.abs(F.col("score") - F.col("grown")) < 1e-12).alias("same"))


@query(
    "l1_l2_l4_model_scores",
    f"select count(*) as n_rows, true as beats_chance, true as many_scores from ({LABELLED_SPLIT}) where split = 'train'",
)
def l4_scores(spark, d):
    """The scores of the training rows tell the classes apart, and are many."""
    model, known, _ = fitted(spark, d)
    scored = ranking.settled(model.score(known.where("split = 'train'")).select("doc_id", "quality", "score"), "scored")
    many = (scored.agg(F.count_distinct("score").alias("n")).scalar() > 10).alias("many_scores")
    found = metrics.binary_metrics(scored, "score", "quality")
    return found.select((F.col("n_pos") + F.col("n_neg")).alias("n_rows"), (F.col("roc_auc") > 0.6).alias("beats_chance"), many)


SMALL_JOB = {
    "model": {"name": "single", "max_depth": 3, "num_boost_round": 4, "eta": 0.3, "eval_metric": "auc"},
    "train": {"early_stopping_rounds": 2, "train_size": -1},
    "featurizer": {"name": "token_chain", "radius": 1, "length": 256},
}


@query(
    "job_saved_run_scores_again",
    "select doc_id as row_id, true as same from documents where doc_id not in (select doc_id from labels where quality is not null)",
)
def job_again(spark, d):
    """Train, save and score with the whole job; then load the run and score the same documents once more."""
    rows = documents_with_labels(spark, d)
    train, test = rows.where("quality is not null"), rows.where("quality is null")
    columns = Columns(text="text", label="quality", row_id="doc_id", category="lang")
    out = scratch_path(spark, "run")
    run_job(spark, train, test, JobParams.from_dict(SMALL_JOB), columns, out, CODES)
    sent = spark.read.option("header", True).schema("row_id bigint, sent double").csv(f"{out}/submission.csv")
    return load_run(spark, out).score(test).join(sent, "row_id").select("row_id", (F.abs(F.col("score") - F.col("sent")) < 1e-9).alias("same"))


@query(
    "l3_early_stopping",
    f"""with m as ({sql.metrics_from(STAGED_ROWS, "round, split").replace("round(ap / n_pos, 6)", "ap / n_pos")}),
        v as (select round, average_precision as ap, max(average_precision) over (order by round) as best
              from m where split = 'val'),
        s as (select round, (select min(w.round) from v w where w.ap = v.best) as best_round from v),
        e as (select coalesce(min(round) filter (where round - best_round >= 3), max(round)) as stop_round from s)
        select best_round, stop_round, (stop_round + 1)::bigint as kept_rounds from e join s on s.round = e.stop_round""",
)
def l3(spark, d):
    curve = metrics.round_curve(staged_rows(spark, d), "round", "split", "score", "y")
    return metrics.early_stop(curve.where(F.col("split") == "val"), "round", "average_precision", 3)


WATCHED = learning.BoostParams(
    max_depth=2, num_boost_round=30, eta=0.5, subsample=1.0, colsample_bytree=1.0, early_stopping_rounds=2, eval_metric="auc"
)


@query(
    "l3_a11_stops_while_growing",
    "select true as stopped_early, true as stopped_by_the_rule, 0::bigint as n_different",
)
def l3_growing(spark, d):
    """Training ends where patience runs out; the curve it kept equals that of the finished model's staged scores."""
    known = document_features(spark, d).where(F.col("quality").isNotNull())
    model, curve = learning.train_rounds(known, "quality", WATCHED, "doc_id", "split", "weight", train_curve=True)
    staged = learning.curve_of_rounds(model.model, known, "quality", "split")
    apart = F.abs(F.col("c.roc_auc") - F.col("s.roc_auc")) + F.abs(F.col("c.average_precision") - F.col("s.average_precision"))
    both = curve.alias("c").join(staged.alias("s"), ["round", "split"], "full").agg(F.count_if(~F.coalesce(apart < 1e-9, F.lit(False))).alias("n_different"))
    rule = metrics.early_stop(curve.where("split = 'val'"), "round", "roc_auc", WATCHED.early_stopping_rounds)
    rule = rule.select((F.col("stop_round") == model.model.n_rounds - 1).alias("stopped_by_the_rule"))
    return both.crossJoin(F.broadcast(rule)).select(F.lit(model.model.n_rounds < 30).alias("stopped_early"), "stopped_by_the_rule", "n_different")


STUMP_ALPHA, STUMP_ETA = 2.0, 0.3


def _stump_sql(n: int) -> str:
    """Best bit, leaf steps and margins of one round of stumps, from the margins of the round before."""
    prev = f"m{n - 1}"
    soft = lambda g: f"(greatest(abs({g}) - {STUMP_ALPHA}, 0) * sign({g}))"
    score = lambda g, h: f"({soft(g)} * {soft(g)} / ({h} + 1))"
    return f"""
    g{n} as (select *, round((p - y) * 16777216) / 16777216 as g, round(p * (1 - p) * 16777216) / 16777216 as h
             from (select *, 1 / (1 + exp(-margin)) as p from {prev}) where split = 'train'),
    t{n} as (select sum(g) as ag, sum(h) as ah from g{n}),
    s{n} as (select bit, sum(g) as rg, sum(h) as rh from (select unnest(on_bits) as bit, g, h from g{n}) group by bit),
    b{n} as (select *, ag - rg as lg, ah - rh as lh from s{n}, t{n}),
    c{n} as (select *, {score("lg", "lh")} + {score("rg", "rh")} - {score("ag", "ah")} as gain from b{n} where lh >= 1 and rh >= 1),
    d{n} as (select * from c{n} where gain > 1e-6 order by gain desc, bit limit 1),
    m{n} as (select m.* replace (margin - {STUMP_ETA} * case when d.bit is null then {soft("t.ag")} / (t.ah + 1)
               when list_contains(on_bits, d.bit) then {soft("d.rg")} / (d.rh + 1) else {soft("d.lg")} / (d.lh + 1) end as margin)
             from {prev} m cross join t{n} t left join d{n} d on true)"""


@query(
    "l2_boosted_stump_scores",
    f"""with bits as ({sql.pattern_key_sql("documents", "doc_id", "text", fp.PROSE_KEYS)}),
    m0 as (select doc_id, split, quality::double as y, 0.0::double as margin,
                  case when bits = '' then []::int[] else list_transform(string_split(bits, ','), lambda x: x::int) end as on_bits
           from ({LABELLED_SPLIT}) join bits using (doc_id) join labels using (doc_id)),
    {", ".join(_stump_sql(n) for n in (1, 2, 3))}
    select doc_id, split, round(1 / (1 + exp(-margin)), 9) as score from m3""",
)
def l2_stumps(spark, d):
    """Three second-order rounds with an L1 penalty, recomputed in SQL down to the scores of all labelled rows."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    split = rowsets.split_train_val(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    rows = fp.pattern_key_bits(docs, "text", fp.PROSE_KEYS).select("doc_id", "bits").join(split, "doc_id")
    rows = ranking.settled(boosting.model_inputs(rows, "bits"), "stumps")
    growth = boosting.Growth(max_depth=1, eta=STUMP_ETA, alpha=STUMP_ALPHA)
    run = boosting.Boosting(rows, "doc_id", "quality", "split", growth)
    for _ in range(3):
        run.step()
    return rounded_to(run.model.score(rows).select("doc_id", "split", "score"), 9, "score")


@query(
    "l6_score_with_earlier_round",
    "select count(*) as n_rows, 0::bigint as n_different from documents",
)
def l6(spark, d):
    """Scores of the first k trees, taken from the staged margins and from the short model, agree for every k."""
    model, known, rest = fitted(spark, d)
    rows = known.select("doc_id", "in_bits", "in_numbers").unionByName(rest.select("doc_id", "in_bits", "in_numbers"))
    n = model.model.n_rounds
    staged = rows.withColumn("margins", model.model.margins())
    for k in range(1, n + 1):
        staged = model.score(staged, k, f"s{k}")
    differ = F.lit(False)
    for k in range(1, n + 1):
        differ = differ | (F.abs(F.col(f"s{k}") - 1 / (1 + F.exp(-F.get("margins", F.lit(k - 1))))) > 1e-12)
    return staged.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(differ).alias("n_different"))


@query(
    "s11_model_round_trip",
    "select count(*) as n_rows, 0::bigint as n_different from documents join labels using (doc_id)",
)
def s11(spark, d):
    model, known, _ = fitted(spark, d)
    path = scratch_path(spark, "model")
    model.save(path)
    both = learning.BoostedModel.load(path).score(model.score(known), name="again")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("again") != F.col("score")).alias("n_different"))


GIVEN = f"select quality as y, {sql.pseudo_score('doc_id::varchar')} as score from documents left join labels using (doc_id)"


def given_scores(spark, d):
    return documents_with_labels(spark, d).select(
        "doc_id", "quality", pseudo_score(F.col("doc_id").cast("string")).alias("score")
    )


@query(
    "l7_s13_validation_metrics",
    f"select roc_auc, average_precision, accuracy from ({sql.metrics_from(GIVEN)})",
)
def l7(spark, d):
    found = metrics.binary_metrics(given_scores(spark, d), "score", "quality").select(*METRICS)
    path = tables.metrics_path(scratch_path(spark, "metrics"), f"{d}/documents.parquet")
    tables.write_csv(found, path)
    return rounded(tables.read_csv(spark, path, "roc_auc double, average_precision double, accuracy double"), *METRICS)


@query(
    "l7_metrics_without_labels",
    """select avg(quality)::double as roc_auc, avg(quality)::double as average_precision, avg(quality)::double as accuracy,
              count(quality) as n_pos, count(quality) as n_neg, count(*) as n_rows
       from documents left join labels using (doc_id) where quality is null""",
)
def l7_none(spark, d):
    """Metrics of the documents that really have no label: null, over no rows."""
    rows = given_scores(spark, d).where("quality is null")
    n_rows = rows.agg(F.count(F.lit(1)).alias("n_rows")).scalar()
    return metrics.binary_metrics(rows, "score", "quality").withColumn("n_rows", n_rows)


WIDE_POSITIONS = "select o_orderkey, (1152921504606846975 - o_orderkey * 7919)::bigint as v from orders"


@query("p4_x1_shards_of_60_bit_positions", f"select o_orderkey, v // 1000 as shard, v % 1000 as place from ({WIDE_POSITIONS})")
def p4_wide(spark, d):
    v = F.lit(1152921504606846975).cast("bigint") - F.col("o_orderkey") * F.lit(7919).cast("bigint")
    rows = table(spark, d, "orders").select("o_orderkey", v.alias("v"))
    return rows.select("o_orderkey", shard_of(F.col("v"), 1000).alias("shard"), offset_in_shard(F.col("v"), 1000).alias("place"))


@query(
    "f5_f6_unreadable_notation",
    """select p_partkey, p_partkey % 7 <> 0 as readable, p_partkey % 7 <> 0 as has_bits from part""",
)
def f5_bad(spark, d):
    """Every seventh string is broken: the flag says so, and it has no bits."""
    strings = spread(notation(spark, d)).withColumn("s", F.when(F.col("p_partkey") % 7 == 0, F.concat("s", F.lit("??("))).otherwise(F.col("s")))
    parsed = graphs.parse_notation(graphs.notation_bits(strings, "s", 1, 256, bad="null"), "s", "g")
    return parsed.select("p_partkey", F.col("g.parse_ok").alias("readable"), F.col("bits").isNotNull().alias("has_bits"))


@query(
    "l8_s12_submission",
    "select doc_id as id, true as same, true as some_differ from documents where doc_id not in (select doc_id from labels)",
)
def l8(spark, d):
    """The written submission holds, for each test row, the score that the trees give when walked one by one."""
    model, _, rest = fitted(spark, d)
    path = scratch_path(spark, "submission")
    tables.write_csv(tables.submission(model.score(rest), "doc_id", "score", "quality", order="doc_id"), path)
    sent = tables.read_csv(spark, path, "id bigint, quality double")
    apart = ranking.settled(rest.select("doc_id", boosting.walked(model.model, "in_bits").alias("own")), "walked")
    differ = sent.agg((F.count_distinct("quality") > 2).alias("d")).scalar()
    return sent.join(apart, sent.id == apart.doc_id).select("id", (F.abs(F.col("quality") - F.col("own")) < 1e-9).alias("same"), differ.alias("some_differ"))


@query("l9_score_distribution", sql.histogram_of(f"select {sql.pseudo_score('doc_id::varchar')} as v from documents"))
def l9(spark, d):
    return rounded(labels.histogram(given_scores(spark, d), "score"), "low", "high")


@query(
    "l5_f8_stacked_scores",
    f"""with s as (select count(*) as n, count(*) // 3 as weak, count(*) // 4 as final_size from labels),
        pool as (select doc_id, weak, (n - final_size) // weak as k,
                        row_number() over (order by {sql.seeded('doc_id')}, doc_id) as r
                 from (select doc_id, row_number() over (order by doc_id) - 1 as i from labels), s where i < n - final_size)
        select doc_id, 2 as n_weak, true as in_unit, count(*) over () as n_rows, true as beats_chance, true as many_scores
        from labels left join pool using (doc_id) where r is null or r > k * weak""",
)
def l5(spark, d):
    """Two weak learners on disjoint rows, then a final model on their scores for the rows kept back."""
    rows = document_features(spark, d).where(F.col("quality").isNotNull()).drop("split", "weight")
    known = table(spark, d, "labels").select("doc_id")
    n, path = known.count(), scratch_path(spark, "allotment")
    tables.write_membership(rowsets.allot_learners(known, "doc_id", n // 3, n // 4), path, "doc_id", ["learner"])
    members = spark.read.parquet(path).withColumn("learner", F.col("learner").cast("string"))

    def with_split(learner: str) -> DataFrame:
        """Rows of one learner with split and weight; the row set is small and written before it is used twice."""
        ids = rowsets.split_train_val(members.where(F.col("learner") == learner).select("doc_id"), "doc_id")
        where = scratch_path(spark, f"learner-{learner}")
        tables.write_table(ids, where)
        return labels.with_class_weight(rows.join(spark.read.parquet(where), "doc_id"), "quality")

    k = labels.learner_count(n, n // 4, n // 3)
    with ThreadPoolExecutor(k) as pool:  # learners have rows of their own and are trained side by side
        weak = list(pool.map(lambda i: learning.train_rounds(with_split(str(i)), "quality", SMALL, "doc_id", "split", "weight")[0], range(k)))
    # each weak learner scores the final rows once
    final = ranking.settled(learning.stacked_features(weak, with_split(rowsets.FINAL)), "stacked")
    model, _ = learning.train_rounds(final, "quality", SMALL, "doc_id", "split", "weight")
    scored = ranking.settled(model.score(final).select("doc_id", "quality", "score", F.size("in_numbers").alias("n_weak")), "scored")
    many = scored.agg((F.count_distinct("score") > 4).alias("many_scores"))
    found = metrics.binary_metrics(scored, "score", "quality").select((F.col("n_pos") + F.col("n_neg")).alias("n_rows"), (F.col("roc_auc") > 0.6).alias("beats_chance"))
    # every row of the final model with its score's checks, beside the checks of them all
    each = scored.select("doc_id", "n_weak", in_unit("score").alias("in_unit"))
    return each.crossJoin(F.broadcast(found)).crossJoin(F.broadcast(many))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint, split, train, stop, score and evaluate the labelled documents: one row of validation metrics."""
    model, known, _ = fitted(spark, sf_dir)
    val = known.where(F.col("split") == "val")
    return metrics.binary_metrics(model.score(val), "score", "quality")
