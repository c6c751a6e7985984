"""Corpus pipeline: documents in, packed token sequences out, one stored table between any two stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import exact_dedup, mixing, packing, simhash, toxicity
from tallyfold.llm.common import staged, table
from tallyfold.llm.queries import MIX_SEED, MIX_WEIGHTS, mix_levels, tokenizer_file

#: Share of the tokens that reach the mixing stage which it keeps; no document is taken twice here, as the two stages
#: before have just removed copies.
MIX_SHARE = 0.9


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not call toxic."""
    grades = toxicity.label_grades(table(spark, sf_dir, "labels"))
    model = toxicity.fit_severity(docs, grades, n_grades=3)
    return toxicity.score_severity(docs, model).where("not toxic").select("doc.*")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose fingerprints link, that with the smallest id."""
    return simhash.drop_near_duplicates(docs, words=3, most=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their leaf's token budget."""
    return mixing.mix_documents(docs, mix_levels(), share=MIX_SHARE, weights=MIX_WEIGHTS, max_epochs=1, seed=MIX_SEED)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifier, fingerprints and tokenizer have no SQL; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
