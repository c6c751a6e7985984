import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyfold.llm import fingerprint as fp
from tallyfold.llm.common import table
from tallyfold.llm.queries import QUERIES

MASK = (1 << 64) - 1


def plain_print(text):
    """128 bits of one text, as (hi, lo) unsigned."""
    words = [w for w in text.lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    votes, total = [0] * 128, 0
    for a, b in zip(words, [*words[1:], None]):
        weight = 1 + (len(a) > 3) + (b is not None and len(b) > 3)

        def h(seed):
            for part in (a, b):
                seed = seed if part is None else xxhash.xxh64_intdigest(part.encode(), seed)
            return seed

        total += weight
        for half, value in enumerate((h(42), h(xxhash.xxh64_intdigest(b"second", 42)))):
            for bit in range(64):
                votes[64 * half + bit] += weight * (value >> bit & 1)
    bits = [2 * v > total for v in votes]
    return tuple(sum(1 << i for i in range(64) if bits[64 * half + i]) for half in (0, 1))


def plain(docs):
    """doc -> (n_chars, edited sha, own print, edited print, next print), in descending order of ids, nulls last."""
    rows = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (d, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_print(text), plain_print(edited), plain_print(after)))
    return sorted(out, key=str)


def made(df):
    rows = fp.edited_fingerprints(df).collect()
    u = lambda *v: tuple(x & MASK for x in v)
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, u(r.hi, r.lo), u(r.edited_hi, r.edited_lo), u(r.next_hi, r.next_lo)) for r in rows), key=str)


def test_equal_to_plain_fingerprints(spark, monkeypatch):
    import tallyfold.operators.ranking as ranking

    monkeypatch.setattr(ranking, "BUCKET_ROWS", 20)  # several ranges of ids
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").limit(90)
    rows = [tuple(r) for r in docs.collect()]
    assert made(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == plain(rows)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    unique = list({r: None for r in rows})
    df = spark.createDataFrame(unique, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("bucket", "hash", "row", "own", "total")})
    assert made(df) == plain(unique)
    assert len(made(odd_docs)) == len(rows)  # repeated rows stay
    assert made(no_docs) == []
    one = spark.createDataFrame([(5, "alone in here")], "doc_id long, text string")
    assert made(one) == plain([(5, "alone in here")])


def test_long_texts_count_whole(spark):
    text = "aaaa " * 40_000 + "b c d " * 9_000  # more than three chunks
    df = spark.createDataFrame([(1, text)], "id long, t string")
    row = fp.text_fingerprints(df, ["id"], "t").first()
    assert (row.hi & MASK, row.lo & MASK) == plain_print(text)


@pytest.mark.parametrize("spare", [1, 2])
def test_finds_all_within_the_radius(spark, spare):
    rng = random.Random(4)
    prints = {(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(60)} | {(0, 0)}
    for hi, lo in list(prints):
        for n in (1, 3, 5, 6):
            flips = rng.sample(range(128), n)
            prints.add((hi ^ sum(1 << f for f in flips if f < 64), lo ^ sum(1 << (f - 64) for f in flips if f >= 64)))
    prints = sorted(prints)
    asked = prints[::3]
    s = lambda rows: spark.createDataFrame([(fp._signed(h), fp._signed(x)) for h, x in rows] + [(None, 1)], "hi long, lo long")
    found = fp.within_radius(s(asked), s(prints + prints[:9]), 5, spare).collect()
    got = [((r.q_hi & MASK, r.q_lo & MASK), (r.hi & MASK, r.lo & MASK), r.distance) for r in found]
    apart = lambda p, q: (p[0] ^ q[0]).bit_count() + (p[1] ^ q[1]).bit_count()
    assert sorted(got) == sorted((p, q, apart(p, q)) for p in asked for q in prints if apart(p, q) <= 5)
    assert fp.within_radius(s([]), s([])).count() == 0


def test_query_tells_edits_from_strangers(spark):
    rows = QUERIES["op11_document_fingerprints"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(len(r.fingerprint) == 32 for r in rows)
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)
    by_print = {}
    for r in rows:
        by_print.setdefault(r.fingerprint, []).append(r.doc_id)
    for r in rows:
        near = sum(len(ids) for p, ids in by_print.items() if (int(p, 16) ^ int(r.fingerprint, 16)).bit_count() <= 5) - 1
        assert r.n_near == (near if r.doc_id % 20 == 0 else None)


def test_no_python_on_the_way(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    plan = fp.edited_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    # texts move once, by their range
    assert sum("Exchange hashpartitioning(bucket" in line for line in plan.splitlines()) == 1
