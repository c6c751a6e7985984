import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyfold.llm import bpe
from tallyfold.llm.bpe import WordTokenizer
from tallyfold.llm.common import doc_batches
from tallyfold.llm.packing import PIECE_CHARS, best_fit_decreasing, pack_documents, plan_patterns

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(FILE)


def split(found):
    ids, sizes = found
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(" \n\t'stmdrevlaB19.,é日½ 　\x1ć")) | st.text(max_size=30), min_size=1, max_size=8))
def test_same_ids_as_the_tokenizer(plain, words, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert split(words.encode(texts)) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_same_ids_in_parts_with_added_tokens_and_after_a_fresh_start(plain, words, table, monkeypatch):
    texts = [r["text"] or "" for r in table("documents").select("text").collect()] + ["a <|endoftext|> b's", "", "x"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert split(words.encode(texts)) == want
    monkeypatch.setattr(bpe, "LONG", 500)
    assert split(words.encode(texts)) == want
    monkeypatch.setattr(bpe, "MAX_NAMES", 1000)
    assert split(words.encode(texts)) == want


def test_a_worker_tokenizes_in_small_parts(words, monkeypatch):
    frame = pd.DataFrame({"text": [" ".join(f"w{i:x}v{j}" for j in range(100)) for i in range(2_000)]})
    parts = list(doc_batches([frame], PIECE_CHARS))
    want = [split(words.encode(p["text"].tolist())) for p in parts]
    words.clear()
    asked = []

    class Watched:
        def encode(self, texts, **how):
            asked.append(len(texts))
            return inner.encode(texts, **how)

    inner = words.tokenizer
    monkeypatch.setattr(words, "tokenizer", Watched())
    tracemalloc.start()
    got = [split(words.encode(p["text"].tolist())) for p in parts]
    most = tracemalloc.get_traced_memory()[1] - sum(len(i) for p in got for i in p) * 36
    tracemalloc.stop()
    assert got == want and max(asked) <= bpe.LEARNED and most < 60e6
    monkeypatch.setattr(bpe, "MAX_IDS", 5_000)  # the table starts anew
    assert [split(words.encode(p["text"].tolist())) for p in parts] == want
    assert words.n_ids < 1_000_000


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(0, 40), min_size=1, max_size=60))
def test_plans_hold_every_piece_once(capacity, some):
    counts = np.zeros(capacity + 1, np.int64)
    counts[: len(some[: capacity + 1])] = some[: capacity + 1]
    counts[0] = 0
    for plan in (plan_patterns(counts, capacity), best_fit_decreasing(counts, capacity)):
        used = np.zeros(capacity + 1, np.int64)
        for sizes, n in plan:
            assert sum(sizes) <= capacity and n > 0
            for s in sizes:
                used[s] += n
        assert (used == counts).all()


def test_plans_are_nearly_full():
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(6.5, 0.8, 200_000).astype(int), 1, None) % 2048
    counts = np.bincount(lengths[lengths > 0], minlength=2049)
    made = sum(n for _, n in plan_patterns(counts, 2048))
    assert made <= 1.002 * np.ceil((counts * np.arange(2049)).sum() / 2048)


def check(docs, capacity, plain):
    rows = pack_documents(docs, FILE, capacity=capacity, with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        assert r["length"] == len(r["ids"]) <= capacity
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], tuple(r["ids"])))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for r in docs.select("doc_id", "text").collect():
        whole = tuple(plain.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)
        pieces = sorted(set(by_doc[r["doc_id"]]))
        if r["doc_id"] is not None:
            assert sum((p[2] for p in pieces), ()) == whole
            assert [p[0] for p in pieces] == list(range(-(-len(whole) // capacity)))
            assert all(len(p[2]) == capacity for p in pieces[1:])
    return rows


def test_round_trip(table, odd_docs, no_docs, plain):
    check(table("documents"), 2048, plain)
    rows = check(odd_docs, 64, plain)
    assert sum(r["doc_id"] == 7 for r in rows) == 2  # the repeated row has a place of its own
    assert pack_documents(no_docs, FILE).count() == 0
