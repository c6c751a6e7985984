"""Language of texts and of spans inside them: script ranges, letter n-gram scores per word, Viterbi over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import doc_batches, text_of, worker_cached

#: Hashed letter trigrams.  Tasks receive a table of this width for each language.
WIDTH = 1 << 16
#: More languages than this in the training labels are an error: the table above must stay small.
MAX_LANGUAGES = 500
#: Cost of a change of language between two words, in nats, and the most that one word may speak against a language.
SWITCH, WORD_LIMIT = 12.0, 15.0
SMOOTHING = 0.5
#: A script belongs to a language that writes at least this share of its letters in it.
SCRIPT_SHARE = 0.01

#: First code points of script ranges (a range ends where the next begins; "" is any other script): fixed values.
SCRIPTS = [
    (0x0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xAA, "latin"), (0x250, ""), (0x370, "greek"), (0x400, "cyrillic"),
    (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, ""), (0x750, "arabic"), (0x780, ""), (0x8A0, "arabic"), (0x900, "devanagari"),
    (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, ""), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"),
    (0xD80, ""), (0xE00, "thai"), (0xE80, ""), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, ""), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB07, ""), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFF21, "latin"), (0xFF3B, ""), (0xFF41, "latin"), (0xFF5B, ""),
    (0xFF66, "kana"), (0xFFA0, ""), (0x20000, "han"), (0x32000, ""),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@dataclass
class Letters:
    """Per code point: is it part of a word, is it a letter, its lower case, its script."""

    word: np.ndarray
    letter: np.ndarray
    lower: np.ndarray
    script: np.ndarray

    @classmethod
    def make(cls) -> Letters:
        import unicodedata

        kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        letter = np.array([k == "L" for k in kind])
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in np.flatnonzero(letter):
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
        starts, names = np.array([s for s, _ in SCRIPTS]), np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])
        script = names[np.searchsorted(starts, np.arange(0x110000), "right") - 1].astype(np.uint8)
        return cls(np.array([k in "LM" for k in kind]), letter, lower, script)


def _letters() -> Letters:
    return worker_cached("letters", Letters.make)


@dataclass
class Words:
    """Words of a batch of texts, one after the other."""

    code: np.ndarray  # trigram of every letter
    first: np.ndarray  # of every word: its first letter's place in ``code``
    letters: np.ndarray  # of every word: its letters, without combining marks
    script: np.ndarray  # of every word
    begin: np.ndarray  # of every word: where it starts in its text, and where it ends
    end: np.ndarray
    count: np.ndarray  # words of every text


def words_of(texts: list[str], letters: Letters) -> Words:
    """Runs of letters (with their combining marks), no run crossing two texts."""
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    text_at = np.cumsum(size + 1) - (size + 1)
    inside = letters.word[cp]
    low = np.where(inside, letters.lower[cp], 0).astype(np.uint64)
    before, after = np.append(np.uint64(0), low[:-1]), np.append(low[1:], np.uint64(0))
    at = np.flatnonzero(inside)
    mixed = (before[at] * np.uint64(0x9E3779B97F4A7C15)) ^ (low[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after[at] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    code = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)) if len(at) else np.empty(0, np.int64)
    start = at[first]
    stop = at[np.append(first[1:], len(at)) - 1] + 1 if len(at) else start
    text = np.searchsorted(text_at, start, "right") - 1
    pure = np.add.reduceat(letters.letter[cp[at]].astype(np.int64), first) if len(at) else first
    return Words(code, first, pure, letters.script[cp[start]], start - text_at[text], stop - text_at[text], np.bincount(text, minlength=len(texts)))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # log-probability of a trigram, by trigram and language
    writes: np.ndarray  # by script and language: may it be written so?
    switch: float = SWITCH


def fit_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", switch: float = SWITCH) -> LanguageModel:
    """Trigram counts per language over all ``docs`` that have a text and a language; nothing is sampled.

    Every task sums its own letters by trigram before anything is shuffled, so a language that most texts have costs one
    row per trigram and task.  Without rows the model knows no language and answers "und".
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = _letters()
        for frame in doc_batches(frames, 4_000_000):
            for lang, part in frame.groupby("lang"):
                words = words_of(part["text"].tolist(), letters)
                sums = np.bincount(words.code, minlength=WIDTH)
                length = np.diff(np.append(words.first, len(words.code)))
                sums = np.append(sums, np.bincount(words.script, length, len(SCRIPT_NAMES)).astype(np.int64))
                some = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": lang, "code": some.astype(np.int32), "n": sums[some]})

    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sums = known.mapInPandas(count, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    if known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    got = sums.toPandas()  # at most languages times (WIDTH and scripts) rows
    languages = sorted(got["lang"].unique())
    full = np.zeros((WIDTH + len(SCRIPT_NAMES), len(languages)))
    full[got["code"], [languages.index(x) for x in got["lang"]] if len(got) else []] = got["n"]
    grams, scripts = full[:WIDTH], full[WIDTH:]
    table = np.log(grams + SMOOTHING) - np.log(grams.sum(0) + SMOOTHING * WIDTH)
    writes = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0))
    return LanguageModel(languages, table.astype(np.float32), writes & (scripts > 0), switch)


def viterbi(score: np.ndarray, count: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word; all texts advance one word at a time together."""
    n, width = score.shape
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    sorted_count = count[order]
    steps = int(sorted_count[0]) if len(count) else 0
    active = len(count) - np.searchsorted(sorted_count[::-1], np.arange(steps), "right")
    stay = np.ones((n, width), bool)
    origin = np.zeros(n, np.int16)
    value = np.zeros((len(count), width))
    place = first[order]
    for t in range(steps):
        k = active[t]
        at = place[:k] + t
        v = value[:k]
        if t:
            best = v.argmax(1)
            jump = v[np.arange(k), best][:, None] - switch
            stay[at] = v >= jump
            origin[at] = best
            v = np.maximum(v, jump)
        value[:k] = v + score[at]
    path = np.zeros(n, np.int16)
    now = value.argmax(1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = place[:k] + t
        path[at] = now[:k]
        kept = stay[at, now[:k]]
        now[:k] = np.where(kept, now[:k], origin[at])
    return path


def detect(docs: DataFrame, model: LanguageModel, text_col: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` in a column ``doc`` with lang_pred, score and, if wanted, spans (start, end, lang) in characters.

    Scripts narrow a word's candidates to the languages written in them (all, if none is).  Word scores are trigram
    log-probabilities; the best path through the words pays ``switch`` for every change.  Neighbouring words of one
    language form a span.  lang_pred is the language of most letters and score their share.  Null texts and texts
    without letters are "und" with score 0 and no spans; so is everything if the model knows no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> tuple:
        model, letters = shared.value, _letters()
        words = words_of(texts.tolist(), letters)
        width = len(model.languages)
        if not len(words.first) or not width:
            return ["und"] * len(texts), [0.0] * len(texts), [[]] * len(texts)
        score = np.empty((len(words.first), width))
        for k in range(width):
            score[:, k] = np.add.reduceat(model.table[words.code, k].astype(np.float64), words.first)
        may = model.writes[words.script]
        may[~may.any(1)] = True
        score -= score.max(1, where=may, initial=-np.inf, keepdims=True)
        score = np.where(may, np.maximum(score, -WORD_LIMIT), -2 * WORD_LIMIT)
        path = viterbi(score, words.count, model.switch)
        text = np.repeat(np.arange(len(texts)), words.count)
        share = np.bincount(text * width + path, words.letters, len(texts) * width).reshape(-1, width)
        total = share.sum(1)
        best = share.argmax(1)
        names = np.array(model.languages, object)
        lang = np.where(total > 0, names[best], "und")
        part = share[np.arange(len(texts)), best] / np.maximum(total, 1)
        found: list[list] = [[] for _ in range(len(texts))]
        if spans:
            fresh = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (text[1:] != text[:-1])))
            stop = np.append(fresh[1:], len(path)) - 1
            for t, a, b, k in zip(text[fresh].tolist(), words.begin[fresh].tolist(), words.end[stop].tolist(), path[fresh].tolist()):
                found[t].append((a, b, model.languages[k]))
        return lang, part, found

    @F.pandas_udf("lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    def label(texts: pd.Series) -> pd.DataFrame:
        lang, score, found = [], [], []
        for frame in doc_batches([texts.to_frame("text")], 4_000_000):
            a, b, c = run(frame["text"])
            lang.extend(a), score.extend(b), found.extend(c)
        return pd.DataFrame({"lang_pred": lang, "score": score, "spans": found})

    rows = docs.select(F.struct("*").alias("doc"), label(text_of(text_col)).alias("_p"))
    return rows.select("doc", "_p.lang_pred", "_p.score", *([F.col("_p.spans")] if spans else []))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """The fold of an id that no model may learn from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)) == 0
