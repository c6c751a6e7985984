"""Severity of toxic language: cumulative-link ordinal regression over hashed words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import staged, text_of, within

#: Hashed feature space; weights of this size are what tasks receive.
WIDTH = 1 << 18
#: Labelled rows the regression is fitted on, about: a hash of the id picks them if there are more.
MAX_LABELLED = 20_000


def word_features(text: Column, width: int = WIDTH) -> Column:
    """Distinct words of a whole text (runs of letters and digits, lower case), hashed; null and empty texts have none."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_of(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return within(words, lambda w: F.array_distinct(F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(width)).cast("int"))))


@dataclass
class SeverityModel:
    """P(grade >= k) = sigmoid(w.x - threshold_k): one weight per word for all grades, ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def _scores(words: list, weights: np.ndarray) -> np.ndarray:
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.concatenate([np.empty(0, np.int64), *words]).astype(np.int64) if len(words) else np.empty(0, np.int64)
    total = np.append(0.0, np.cumsum(weights[flat], dtype=np.float64))
    stop = np.cumsum(size)
    return total[stop] - total[stop - size]


#: A word takes part if its share of texts above grade 0 lies this many standard errors from the average, in at least
#: LEAST_TEXTS texts: invented and rare words would otherwise remember single texts.
LEAST_Z, LEAST_TEXTS = 3.0, 3
FOLDS = 4


def fit_ordinal(words: list, grade: np.ndarray, n_grades: int, width: int = WIDTH, l2: float = 1.0, seed: int = 3) -> SeverityModel:
    """Maximum likelihood of the cumulative-link model with an L2 penalty.

    The cutoff on P(grade >= 1) is the one with the best F1 over texts that were left out of the fit in turn, in the
    middle of the gap between the scores beside it.  Without rows, or with one grade only, the answer is the base rate.
    """
    n = len(grade)
    size = np.fromiter(map(len, words), np.int64, n)
    flat = np.concatenate([np.empty(0, np.int64), *words]).astype(np.int64)
    row = np.repeat(np.arange(n), size)
    model = SeverityModel(*_fit_rows(flat, row, grade, n_grades, width, l2), 0.5)
    if n >= 2 * FOLDS and (grade > 0).any():
        fold = np.random.default_rng(seed).permutation(n) % FOLDS
        left_out = np.empty(n)
        for k in range(FOLDS):
            rows = np.flatnonzero(fold != k)
            place = np.full(n, -1)
            place[rows] = np.arange(len(rows))
            part = place[row] >= 0
            weights, thresholds = _fit_rows(flat[part], place[row[part]], grade[rows], n_grades, width, l2)
            score = np.bincount(row, weights[flat], n)
            left_out[fold == k] = SeverityModel(weights, thresholds, 0.5).probabilities(score[fold == k])[:, 0]
        model.cutoff = _best_cutoff(left_out, grade > 0)
    return model


def _fit_rows(flat: np.ndarray, row: np.ndarray, grade: np.ndarray, n_grades: int, width: int, l2: float, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds, by Adam over all rows."""
    n = len(grade)
    w = np.zeros(width)
    share = [(np.sum(grade >= k) + 0.5) / (n + 1.0) for k in range(1, n_grades)]
    cut = np.array([-np.log(s / (1 - s)) for s in share])
    # thresholds stay ordered: the first, then logarithms of the gaps
    free = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])
    if n and len(np.unique(grade)) > 1:
        base = np.mean(grade > 0)
        seen, above = np.bincount(flat, minlength=width), np.bincount(flat[grade[row] > 0], minlength=width)
        z = (above - seen * base) / np.sqrt(np.maximum(seen * base * (1 - base), 1e-9))
        use = ((np.abs(z) >= LEAST_Z) & (seen >= LEAST_TEXTS))[flat]
        flat, row = flat[use], row[use]
        moment = [np.zeros(width), np.zeros(width), np.zeros_like(free), np.zeros_like(free)]
        for step in range(1, rounds + 1):
            cut = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
            score = np.bincount(row, w[flat], n)
            edge = np.concatenate([[-np.inf], cut, [np.inf]])
            up = 1 / (1 + np.exp(-np.clip(edge[grade + 1] - score, -40, 40)))  # P(at most this grade)
            low = 1 / (1 + np.exp(-np.clip(edge[grade] - score, -40, 40)))  # P(at most the grade below)
            up, low = np.where(grade == n_grades - 1, 1.0, up), np.where(grade == 0, 0.0, low)
            p = np.maximum(up - low, 1e-9)
            du, dl = up * (1 - up) / p, low * (1 - low) / p
            g = np.bincount(flat, (du - dl)[row], width) + l2 * w
            by_cut = np.array([np.sum(dl[grade == k + 1]) - np.sum(du[grade == k]) for k in range(n_grades - 1)])
            by_free = np.array([by_cut.sum(), *(by_cut[i:].sum() * np.exp(free[i]) for i in range(1, n_grades - 1))])
            for value, grad, a, b, rate in ((w, g, 0, 1, 0.1), (free, by_free, 2, 3, 0.05)):
                moment[a] += 0.1 * (grad - moment[a])
                moment[b] += 0.01 * (grad * grad - moment[b])
                value -= rate * (moment[a] / (1 - 0.9**step)) / (np.sqrt(moment[b] / (1 - 0.99**step)) + 1e-8)
            free[1:] = np.clip(free[1:], -5, 3)  # a grade that no text has must not run away
    return w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def _best_cutoff(p: np.ndarray, truth: np.ndarray) -> float:
    order = np.argsort(-p)
    p, truth = p[order], truth[order]
    hit = np.cumsum(truth)
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + max(1, truth.sum()))
    ends = np.append(p[1:] < p[:-1], True)  # equal scores fall on one side
    at = int(np.argmax(np.where(ends, f1, -1)))
    return float(np.clip((p[at] + (p[at + 1] if at + 1 < len(p) else 0)) / 2, 0.02, 0.98))


def fit_severity(docs: DataFrame, grades: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, l2: float = 1.0) -> SeverityModel:
    """Fit on the texts of ``docs`` whose id has a grade (0 .. n_grades - 1) in ``grades`` (id_col, grade).

    Rows without a grade, text or id take no part.  Equal texts count once, with their highest grade, so a hot copy does
    not outweigh the rest.  If there are more than ``max_labelled`` grades, a hash of the id picks about that many; only
    the hashes of their texts' words that stand out reach the driver.
    """
    known = grades.select(F.col(id_col).alias("_id"), F.col("grade").cast("int").alias("grade")).where("_id is not null and grade is not null")
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("_id", F.lit("labelled")), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    # about max_labelled rows: a broadcast, so that no other text moves
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_t is not null")
    grade = F.greatest(F.lit(0), F.least("grade", F.lit(n_grades - 1))).alias("grade")
    labelled = texts.join(F.broadcast(known), "_id").select(F.xxhash64("_t").alias("_h"), grade, word_features(F.col("_t")).alias("words"))
    rows = staged(labelled.groupBy("_h").agg(F.max("grade").alias("grade"), F.first("words").alias("words")), "labelled")
    # only words that stand out a little reach the driver; the fit asks for more within each of its folds
    above = (F.col("grade") > 0).cast("double")
    base = rows.agg(F.avg(above)).first()[0] or 0.0
    each = rows.select("_h", "grade", F.explode_outer("words").alias("word"))
    seen = each.groupBy("word").agg(F.count("*").alias("n"), F.sum(above).alias("m"))
    z = (F.col("m") - F.col("n") * base) / F.sqrt(F.greatest(F.col("n") * base * (1 - base), F.lit(1e-9)))
    telling = seen.where((F.col("n") >= LEAST_TEXTS) & (F.abs(z) >= LEAST_Z - 1)).select(F.col("word").alias("told"))
    kept = each.join(F.broadcast(telling), F.col("word") == F.col("told"), "left").groupBy("_h", "grade").agg(F.array_sort(F.collect_list("told")).alias("words"))
    got = kept.orderBy("_h").toArrow()
    lists = got["words"].combine_chunks()
    words = np.split(np.asarray(lists.values), np.asarray(lists.offsets)[1:-1]) if len(lists) else []
    return fit_ordinal(words, np.asarray(got["grade"], np.int64), n_grades, l2=l2)


def score_severity(docs: DataFrame, model: SeverityModel, text_col: str = "text") -> DataFrame:
    """``docs`` in a column ``doc`` (all its columns as they are), with severity, p_toxic and toxic.

    severity is the expected grade, p_toxic is P(grade >= 1), toxic says whether that reaches the model's cutoff.  Texts
    without words, null ones too, get the base rate and are never called toxic.  Repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    @F.pandas_udf("severity double, p_toxic double")
    def grade(words: pd.Series) -> pd.DataFrame:
        weights, thresholds = shared.value
        p = 1 / (1 + np.exp(np.clip(thresholds[None, :] - _scores(list(words), weights)[:, None], -60, 60)))
        return pd.DataFrame({"severity": p.sum(1), "p_toxic": p[:, 0]})

    rows = docs.select(F.struct("*").alias("doc"), word_features(F.col(text_col)).alias("_w"))
    rows = rows.select("doc", (F.size("_w") > 0).alias("_any"), grade("_w").alias("_g"))
    return rows.select("doc", "_g.severity", "_g.p_toxic", (F.col("_any") & (F.col("_g.p_toxic") >= model.cutoff)).alias("toxic"))


def label_grades(labels: DataFrame) -> DataFrame:
    """Grades of the ``labels`` table: 0 not toxic, 1 toxic, 2 toxic and of low quality.  Null toxic: no grade."""
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).when(F.col("toxic") == 1, 1).alias("grade"))
