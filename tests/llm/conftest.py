import pytest

#: Texts that every operator must take: null, empty, blank, no letters, one word, repeated, very long, odd characters.
ODD = [None, "", "  \n ", "12 !!", "word", "word", "Word", "a b c d e f", "ä ß 日本語 \u0000 \U0001f44d", "long words " * 60_000]


@pytest.fixture
def odd_docs(spark):
    """Odd texts under distinct ids, one id null, one row repeated whole, and columns whose names operators use inside."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else f"src{i}", i) for i, t in enumerate(ODD)]
    rows += [(None, "word", "en", "src1", 1), (7, "a b c d e f", None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    clash = {c: "1" for c in ("words", "hash", "id", "_row", "fp", "_t", "kind", "spans", "row", "score", "key", "length", "epoch", "tokens", "grade", "head")}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in clash.items()})


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")
