import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import merkle
from tallyfold.llm.common import table
from tallyfold.llm.queries import MERKLE_COLUMNS, QUERIES

H = lambda *p: hashlib.sha256("".join(p).encode()).hexdigest()


def leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    """(left siblings, right siblings) per level."""
    out = []
    for level in tree[:-1]:
        start = i // 16 * 16
        out.append((level[start:i], level[i + 1 : start + 16]))
        i //= 16
    return out


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    """The contract by loops: rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            way = path(trees[s], i) + path(top, k)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf((*r[:4], lower(r[4]))) if changed else own
            for left, right in way:
                folded = H(*left, folded, *right)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], H(*(x for left, right in way for x in left + right)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def made(df):
    claims = merkle.tampered_leaf("doc_id", MERKLE_COLUMNS, "text", 5)
    found = merkle.manifest(df, "doc_id", MERKLE_COLUMNS, "source", claims)
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4097, 70_000])
def test_closed_forms_equal_an_append_log(n):
    log, counts = [], [0] * 9

    def complete(level):
        log.append((level, counts[level]))
        counts[level] += 1
        if level < merkle.height(n) and (counts[level] % 16 == 0 or counts[level] == merkle.width(level, n)):
            complete(level + 1)

    for _ in range(n):
        complete(0)
    assert len(log) == merkle.log_length(n)
    some = random.Random(n).sample(range(len(log)), min(len(log), 2000))
    assert all(merkle.position(*log[p], n) == p for p in some)


def test_siblings_stay_within_the_run():
    assert [list(x) for x in merkle.siblings(0, 18, 20)] == [[16, 17], [19]]
    assert [list(x) for x in merkle.siblings(1, 1, 20)] == [[0], []]


def test_equal_to_plain_trees(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["src0"] * 6 + ["a", "é", None, *map(str, range(30))]), None if i % 7 == 0 else "en", None if i % 9 == 0 else i, rng.choice([None, "", "Ab c", f"Text {i}", "tëxt"])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert made(df) == plain(rows)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd_docs.collect()]
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("tree", "idx", "digest", "n", "claim", "level", "block")})
    assert made(clash) == plain(rows)
    assert made(no_docs) == []


def test_log_holds_every_node_once_at_its_place(spark):
    leaves = spark.range(600).select(F.lit("t").alias("tree"), F.col("id").alias("idx"), F.lit(600).cast("bigint").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    log = merkle.append_log(leaves).collect()
    tree = levels([H(str(i)) for i in range(600)])
    assert {(r.level, r.idx): (r.pos, r.digest) for r in log} == {(k, i): (merkle.position(k, i, 600), d) for k in range(1, len(tree)) for i, d in enumerate(tree[k])}
    assert len(log) + 600 == merkle.log_length(600)
    assert [r.p for r in leaves.select(merkle.leaf_position(F.col("idx")).alias("p")).collect()] == [merkle.position(0, i, 600) for i in range(600)]


def test_query_over_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, d, "documents").select(*MERKLE_COLUMNS).collect()]
    got = QUERIES["op12_merkle_manifest"](spark, d)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
