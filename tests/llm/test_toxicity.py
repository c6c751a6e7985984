import numpy as np
from pyspark.sql import functions as F

from tallyfold.llm.toxicity import _best_cutoff, fit_ordinal, fit_severity, label_grades, score_severity

CLEAN = [f"w{i}" for i in range(300)]


def made(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        grade = int(rng.choice(3, p=[0.8, 0.12, 0.08]))
        words = list(rng.choice(CLEAN, 30)) + (["rude", "mean"][: rng.integers(1, 3)] if grade else []) + (["vile"] if grade == 2 else [])
        rows.append((i, " ".join(rng.permutation(words)), grade))
    return rows


def test_orders_the_grades(spark):
    rows = spark.createDataFrame(made(1500, 1), "doc_id int, text string, grade int")
    model = fit_severity(rows.drop("grade"), rows, 3)
    assert (np.diff(model.thresholds) > 0).all()
    fresh = spark.createDataFrame(made(600, 2), "doc_id int, text string, grade int")
    got = score_severity(fresh, model).select("doc.grade", "severity", "p_toxic", "toxic").toPandas()
    mean = got.groupby("grade")["severity"].mean()
    assert mean[0] < 0.3 < mean[1] < mean[2]
    assert (got["toxic"] == (got["grade"] > 0)).mean() > 0.98
    assert ((got["severity"] >= got["p_toxic"]) & (got["severity"] <= 2 * got["p_toxic"] + 1e-9)).all()


def test_held_out_documents(table, spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    grades = label_grades(labels)
    # copies of a text must not stand on both sides
    side = F.pmod(F.xxhash64("text"), F.lit(3)) > 0
    model = fit_severity(docs.where(side), grades, 3)
    got = score_severity(docs.where(~side), model).select("doc.doc_id", "toxic").join(labels.withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    assert got["toxic"][got["label"] == 1].mean() > 0.75
    assert got["toxic"][got["label"] == 0].mean() < 0.02


def test_odd_rows(spark, odd_docs, no_docs):
    grades = spark.createDataFrame([(0, 1), (1, None), (None, 2), (5, 9), (6, 0), (99, 1)], "doc_id long, grade int")
    model = fit_severity(odd_docs, grades, 3)
    got = score_severity(odd_docs, model)
    rows = got.select("doc.doc_id", "doc.text", "doc.grade", "severity", "toxic").collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.severity <= 2 for r in rows)
    assert not any(r.toxic for r in rows if not (r.text or "").strip())
    assert score_severity(no_docs, model).count() == 0
    empty = fit_severity(no_docs, grades.where("doc_id = -5"), 3)
    assert score_severity(odd_docs, empty).where("severity is null").count() == 0


def test_one_grade_answers_with_the_base_rate():
    model = fit_ordinal([np.array([1, 2])] * 20, np.zeros(20, np.int64), 3)
    assert not model.weights.any() and model.probabilities(np.zeros(1))[0, 0] < 0.05


def test_labels_to_grades(spark):
    rows = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0), (5, None, 1), (6, 1, None)]
    got = label_grades(spark.createDataFrame(rows, "doc_id int, quality int, toxic int")).collect()
    assert [r.grade for r in sorted(got)] == [0, 1, 2, 0, 1, None]


def test_cutoff_lies_between_the_classes():
    assert 0.3 < _best_cutoff(np.array([0.1, 0.2, 0.3, 0.7, 0.9]), np.array([0, 0, 0, 1, 1]) > 0) < 0.7
