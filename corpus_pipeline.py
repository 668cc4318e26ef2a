"""The corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Each stage takes the session, the documents that its predecessor kept and the folder
of the tables, and returns a DataFrame; ``run`` writes each result to the shared folder
and reads it back as the next stage's documents. All stages but the last return rows
of ``documents`` with their columns; the last returns the pieces of the packed
sequences. Stage by stage, nulls, empty texts, repeated rows and empty tables are
treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fiscalflow.llm import packing, quality_rules, simhash, toxicity
from fiscalflow.llm.common import materialize
from fiscalflow.llm.queries import learnt_labels
from fiscalflow.sources.parquet import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a lexicon learned from the labelled
    documents of the corpus."""
    corpus = read_table(spark, sf_dir, "documents")
    return toxicity.keep(docs, toxicity.learn(corpus, learnt_labels(spark, sf_dir)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("packing", packing_stage),
]

# A learned lexicon and a tokenizer have no SQL form; tests hold the pipeline against
# a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
