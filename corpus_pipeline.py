"""A training corpus from raw documents: toxicity, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the rows it keeps with the columns
of ``documents``; the last returns the packed pieces. ``run`` writes each stage as Parquet into the shared folder and
reads it back as the next one's input, so a stage is never computed twice and has no lineage behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import decontaminate, jaccard, linededup, pack, toxicity
from panelwright.llm.shared import table, written
from panelwright.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the rows it is given."""
    ship(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    ship(spark)
    return jaccard.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of sentences that came earlier go; what is left of a text is its text from here on."""
    ship(spark)
    return linededup.without_repeated_units(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into sequences of 4096 tokens."""
    ship(spark)
    return pack.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_benchmark),
    ("best_fit_packing", pack_sequences),
]

#: A fitted classifier and a tokenizer are no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
