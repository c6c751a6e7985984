import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm.simhash import near_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.staged(stage(spark, tables[-1], SF), f"test-{name}"))
    return tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert set(rows(df)) <= set(rows(stages[0]))


def test_each_stage_decides_on_its_own_input(stages):
    docs, calm, exact, near, mixed, packed = stages
    assert 0 < calm.count() < docs.count()
    by_text = {}
    for r in calm.collect():
        by_text[r.text or ""] = max(by_text.get(r.text or "", -1), r.doc_id)
    assert {r.doc_id for r in exact.collect()} == set(by_text.values())
    assert {r.doc_id for r in near.collect()} == {r.component_id for r in near_classes(exact).collect()}
    words = near.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    left = mixed.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    # a leaf keeps the whole document at the end of its budget, and leaves are small here
    assert 0.89 * words < left < words
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}


def test_run_gives_the_last_table(spark, stages):
    assert rows(corpus_pipeline.run(spark, SF).drop("sequence_id", "offset")) == rows(stages[-1].drop("sequence_id", "offset"))


def test_odd_documents_pass_every_stage(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= 0
        assert docs is odd_docs or out.count() == 0


def test_the_rest_works_without_this_subpackage():
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[:2] == ['tallyfold', 'llm'] or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not [q for q in e.queries() if q.startswith('op1_') or q == 'pipeline']\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
