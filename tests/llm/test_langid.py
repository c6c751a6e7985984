import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.llm.langid import Letters, LanguageModel, detect, fit_languages, held_out, viterbi, words_of


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(-9, 0), min_size=3, max_size=3), max_size=7), min_size=1, max_size=6), st.integers(0, 8))
def test_path_is_the_best_one(texts, switch):
    import itertools

    score = np.array([w for t in texts for w in t], float).reshape(-1, 3)
    path = viterbi(score, np.array([len(t) for t in texts]), switch)
    at = 0
    for t in texts:
        def worth(p):
            return sum(w[k] for w, k in zip(t, p)) - switch * sum(a != b for a, b in zip(p, p[1:]))

        got = path[at : at + len(t)].tolist()
        at += len(t)
        if t:
            assert worth(got) == max(worth(p) for p in itertools.product(range(3), repeat=len(t)))


def test_words_and_places():
    words = words_of(["Ab, çd!", "", "x\ny 12", "日本"], Letters.make())
    assert words.count.tolist() == [2, 0, 2, 1]
    assert list(zip(words.begin.tolist(), words.end.tolist())) == [(0, 2), (4, 6), (0, 1), (2, 3), (0, 2)]
    assert words.letters.tolist() == [2, 2, 1, 1, 2]
    assert words_of(["\u0301", "e\u0301"], Letters.make()).letters.tolist() == [0, 1]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(corpus):
    return fit_languages(corpus.where(~held_out()))


def test_held_out_accuracy(corpus, model):
    got = detect(corpus.where(held_out()), model, spans=False).select("doc.doc_id", "doc.lang", "lang_pred", "score").collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in corpus.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_spans_of_mixed_texts(spark, corpus, model):
    one = {r.lang: r.text[:400] for r in corpus.where("length(text) > 500").collect()}
    text = one["de"] + " \n " + one["fr"]
    got = detect(spark.createDataFrame([(text,)], "text string"), model).first()
    assert [s.lang for s in got.spans] == ["de", "fr"] and abs(got.spans[1].start - len(one["de"])) < 60
    assert 0.4 < got.score < 0.6


def test_scripts_narrow_the_choice(spark):
    rows = [("latin words here and there", "en"), ("кириллица слова тут и там", "ru"), ("слово ещё одно", "ru")] * 5
    found = fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    got = detect(spark.createDataFrame([("неизвестно",), ("unheard",), ("neu слова",), ("ελληνικά",)], "text string"), found).collect()
    assert [r.lang_pred for r in got[:2]] == ["ru", "en"] and [s.lang for s in got[2].spans] == ["en", "ru"]
    assert got[3].lang_pred in ("en", "ru")  # no language writes it: all are candidates


def test_odd_rows(odd_docs, no_docs, model):
    got = detect(odd_docs, model).select("doc.text", "doc.spans", "lang_pred", "score").collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert detect(no_docs, model).count() == 0
    nothing = fit_languages(no_docs)
    assert nothing.languages == [] and {r.lang_pred for r in detect(odd_docs, nothing).collect()} == {"und"}
    assert isinstance(fit_languages(odd_docs), LanguageModel)
