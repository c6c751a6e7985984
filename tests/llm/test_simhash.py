import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.llm.components import connected_components
from tallyfold.llm.simhash import GrayIndex, drop_near_duplicates, fingerprints, gray_rank, hamming_links, near_classes, union_links


def plain_fingerprint(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    k = min(words, len(tokens))
    hashes = [xxhash.xxh64_intdigest(b" ".join(tokens[i : i + k]), seed=42) for i in range(len(tokens) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def test_gray_order_is_the_gray_code():
    n = np.arange(4096, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**10 - 1)), min_size=1, max_size=300, unique=True), st.integers(0, 4))
def test_index_finds_every_pair(rows, most):
    unit = np.array([u for u, _ in rows])
    fp = np.array([f for _, f in rows], np.uint64)
    order = np.lexsort((gray_rank(fp), unit))
    unit, fp = unit[order], fp[order]
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if unit[i] == unit[j] and int(fp[i] ^ fp[j]).bit_count() <= most}
    got = [(a, b) for x, y in GrayIndex(fp, unit).pairs(most, step=64) for a, b in zip(x.tolist(), y.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    roots = union_links(len(fp), GrayIndex(fp, unit).pairs(most))
    plain = plain_components(want, range(len(fp)))
    assert roots.tolist() == [plain[i] for i in range(len(fp))]


def test_links_of_a_crowded_unit_cut_into_blocks(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set()
    for b in base:
        for _ in range(40):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in signed], "node long, fp long").repartition(4)
    want = plain_components([(a, b) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and (fps[i] ^ fps[j]).bit_count() <= 3], signed)
    for block, spare in ((10_000, 1), (16, 1), (10_000, 2)):
        links = [(r["src"], r["dst"]) for r in hamming_links(nodes, 3, block, spare).collect()]
        assert plain_components(links, signed) == want


def test_fingerprints_and_classes_equal_brute_force(table, odd_docs, no_docs):
    for docs in (table("documents"), odd_docs):
        rows = docs.select("doc_id", "text").collect()
        want = {(r["doc_id"], plain_fingerprint(r["text"])) for r in rows if len(r["text"] or "") < 100_000}
        got = {(r["doc_id"], r["fp"] % (1 << 64)) for r in fingerprints(docs).collect()}
        assert want <= got
        fps = sorted({f for _, f in got})
        comp = plain_components([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3], fps)
        low = {}
        for i, f in got:
            if i is not None:
                low[comp[f]] = min(low.get(comp[f], i), i)
        found = {(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in near_classes(docs).collect()}
        assert found == {(i, f, low.get(comp[f])) for i, f in got}
    assert near_classes(odd_docs).count() == odd_docs.count()
    assert near_classes(no_docs).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_drop_keeps_the_smallest_id_of_each_class(table, odd_docs, no_docs, monkeypatch, few):
    import tallyfold.llm.simhash as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", few)
    docs = table("documents")
    assert sorted(r["doc_id"] for r in drop_near_duplicates(docs).collect()) == sorted({r["component_id"] for r in near_classes(docs).collect()})
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    classes = {r["component_id"] for r in near_classes(odd_docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)
    assert drop_near_duplicates(no_docs).count() == 0


def test_components_of_paths_stars_and_nothing(spark):
    rng = random.Random(1)
    path = list(range(1, 200))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1000, n) for n in range(1001, 1300)] + [(5000, 5000), (None, 3), (1001, 1002), (1001, 1002)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {**dict.fromkeys(path, 1), **dict.fromkeys(range(1000, 1300), 1000)}
    assert connected_components(df.where("src = -1")).count() == 0


def test_an_id_that_reads_null_is_not_a_null_id(spark):
    rows = [("null", "one two three"), (None, "one two three"), ("a", "four five six")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(2)
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == ["a", "null"]
