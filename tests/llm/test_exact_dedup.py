from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import tallyfold.llm.exact_dedup as module
from tallyfold.llm.exact_dedup import drop_exact_duplicates, exact_classes, split_by_filter


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = True
        for i in ids:
            kept = i == keep and left
            left = left and not kept
            out.append((i, keep, len(ids), kept, sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("blocks", [1, 1 << 18])  # an overfull filter only shuffles more
def test_classes_equal_brute_force(spark, table, blocks):
    docs = table("documents").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id % 7 = 0").selectExpr("doc_id + 100000", "text"))
    want = brute([tuple(r) for r in docs.collect()])
    assert found(exact_classes(docs, max_blocks=blocks)) == want


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(exact_classes(odd_docs)) == brute(rows)
    assert exact_classes(no_docs).count() == 0


def test_drop_keeps_all_columns_and_one_row_a_group(odd_docs, no_docs):
    kept = drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = [(i, i) for i, _, _, k, _ in brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()]) if k]
    assert sorted(str(i) for i, _ in rows) == sorted(str(i) for i, _ in want)
    assert drop_exact_duplicates(no_docs).count() == 0


def test_only_possible_repeats_shuffle(spark):
    """One row of hashes per task and range is exchanged in the first pass, whatever the number of rows; then only repeats."""
    for n in (5_000, 50_000):
        docs = spark.range(0, n, 1, 4).selectExpr("id as doc_id", "concat('text ', if(id % 10 = 0, id div 20, id + 1000000)) as text")
        hashes = docs.select(F.xxhash64("text").alias("_h"))
        assert hashes.mapInPandas(module._dealt(1), "range bigint, hashes binary").count() == 4
        found = {r["_h"] for r in module.possible_repeats(hashes, n).collect()}
        twice = {r["_h"] for r in hashes.groupBy("_h").count().where("count > 1").collect()}
        assert twice <= found and len(found - twice) < 0.01 * n
        alone, repeats = split_by_filter(docs.selectExpr("doc_id", "text as _t"))
        assert repeats.count() < 0.11 * n and alone.count() + repeats.count() == n
        assert "Exchange hashpartitioning" not in alone._jdf.queryExecution().executedPlan().toString()


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(module, "RANGE", 1_000)
    hashes = spark.range(0, 20_000, 1, 3).select(F.xxhash64(F.expr("if(id < 7000, 5, id div 2)")).alias("_h"))
    packs = hashes.mapInPandas(module._dealt(20), "range bigint, hashes binary").cache()
    sizes = packs.groupBy("range").agg(F.sum(F.length("hashes") / 8).alias("n")).toPandas()
    assert len(sizes) == 20 and sizes["n"].max() < 1_500
    twice = {r["_h"] for r in hashes.groupBy("_h").count().where("count > 1").collect()}
    assert twice <= {r["_h"] for r in module.possible_repeats(hashes, 20_000).collect()}
    packs.unpersist()
