import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.llm.mixing import leaf_budgets, mix_documents, mix_plan

def levels():
    return {"domain": F.expr("substr(source, 1, 4)"), "lang": F.col("lang"), "source": F.col("source")}



def plain_budgets(tree, total, weights, epochs):
    """tree: path tuple -> tokens; shares by repeated filling of children that cannot hold theirs."""

    def weight(path):
        return weights.get("/".join("null" if x is None else x for x in path), 1)

    def cap(path):
        """What a node can hold, from its children up."""
        if not weight(path):
            return 0
        if path in tree:
            return tree[path] * epochs
        return sum(cap(c) for c in {p[: len(path) + 1] for p in tree if p[: len(path)] == path})

    out = {}

    def share(path, budget, depth):
        if depth == len(next(iter(tree))):
            out[path] = budget
            return
        children = sorted({p[: depth + 1] for p in tree if p[:depth] == path}, key=str)
        w = {c: weights.get("/".join("null" if x is None else x for x in c), 1) for c in children}
        room = {c: cap(c) if w[c] else 0 for c in children}
        got, open_, left = {}, set(children), budget
        while True:
            total_w = sum(w[c] for c in open_)
            full = [c for c in open_ if w[c] == 0 or left * w[c] // total_w >= room[c]]
            if not full:
                break
            for c in full:
                got[c] = room[c]
                open_.remove(c)
            left = budget - sum(got.values())
        for c in open_:
            got[c] = left * w[c] // total_w
        for c in children:
            share(c, got[c], depth + 1)

    share((), total, 0)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    tree = {(rng.choice("ab"), rng.choice([None, "x", "y"]), f"s{i}"): rng.choice([1, 5, 40, 1000]) for i in range(14)}
    names = {"/".join("null" if x is None else x for x in p[:d]) for p in tree for d in (1, 2, 3)}
    weights = {n: rng.randint(0, 5) for n in sorted(names) if rng.random() < 0.7}
    total = rng.choice([10, 700, 3000, 10**6])
    df = spark.createDataFrame([(*p, n) for p, n in tree.items()], "d string, l string, s string, tokens long")
    got = {(r["d"], r["l"], r["s"]): r["budget"] for r in leaf_budgets(df, ["d", "l", "s"], total, weights, 2).collect()}
    assert got == plain_budgets(tree, total, weights, 2)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    df = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "d string, s string, tokens long")
    got = {r["s"]: r["budget"] for r in leaf_budgets(df, ["d", "s"], 400).collect()}
    assert got == {"x": 10, "y": 190, "z": 200}  # x lacks 90, which y takes, not z
    got = {r["s"]: r["budget"] for r in leaf_budgets(df, ["d", "s"], 800, {"a/y": 0}).collect()}
    assert got == {"x": 10, "y": 0, "z": 790}  # what lies below a weight of 0 holds nothing
    with pytest.raises(ValueError):
        leaf_budgets(df, ["d", "s"], 400, {"a": -1})


def test_no_leaf_meets_in_one_task(spark, table):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mix_plan(table("documents"), levels(), share=0.6)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(_leaf" in line]
    # rows are dealt by bucket; by leaf and epoch alone come only the sums of the buckets
    assert any("_bucket" in line and "REPARTITION" in line for line in dealt)
    assert all("_bucket" in line or "epoch" in line for line in dealt)


def test_prefix_of_seeded_epochs(table):
    docs = table("documents")
    rows = mix_plan(docs, levels(), share=1.6, max_epochs=3, weights={"src0": 5}).collect()
    leaves = {}
    for r in docs.select("source", "lang", "doc_id", "text").collect():
        n = len((r["text"] or "").encode().split())
        if n:
            leaves.setdefault((r["source"][:4], r["lang"], r["source"]), []).append((r["doc_id"], n))
    tree = {leaf: sum(n for _, n in members) for leaf, members in leaves.items()}
    want = set()
    for leaf, budget in plain_budgets(tree, int(1.6 * sum(tree.values())), {"src0": 5}, 3).items():
        left, epoch = budget, 0
        while left > 0:
            at = 0
            for i, n in sorted(leaves[leaf], key=lambda x: (hashlib.md5(f"42:{epoch}:{x[0]}".encode()).hexdigest()[:15], x[0])):
                if left > 0:
                    want.add((i, epoch, at, min(n, left)))
                    at, left = at + n, left - min(n, left)
            epoch += 1
    assert {(r["doc_id"], r["epoch"], r["start"], r["taken"]) for r in rows} == want and len(rows) == len(want)


def test_documents_stay_whole(odd_docs, no_docs, table):
    kept = mix_documents(odd_docs, levels(), share=1.0)
    assert kept.columns == odd_docs.columns
    with_words = [r["doc_id"] for r in odd_docs.collect() if (r["text"] or "").split()]
    assert sorted(map(str, set(with_words))) == sorted(str(r["doc_id"]) for r in kept.collect())
    twice = mix_documents(table("documents"), levels(), share=2.0, max_epochs=2)
    assert twice.count() == 2 * sum(bool((r["text"] or "").split()) for r in table("documents").collect())
    assert mix_documents(no_docs, levels()).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_both_ways_to_leave_rows_out(table, monkeypatch, few):
    import tallyfold.llm.mixing as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", few)
    docs = table("documents")
    want = sorted(r["doc_id"] for r in mix_plan(docs, levels(), share=0.6).collect())
    assert sorted(r["doc_id"] for r in mix_documents(docs, levels(), share=0.6).collect()) == want
