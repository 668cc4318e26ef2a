"""The registered queries of the operators: each applies its operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalflow.llm import (
    ann, bpe, fingerprints, hard_negatives, html_extract, kn_quality, lexical_search, packing, quality_rules, simhash,
    token_counts, token_file, toxicity,
)
from fiscalflow.llm.common import in_fold
from fiscalflow.llm.sql import ORACLE  # noqa: F401 - registered with the queries
from fiscalflow.sources.parquet import read_table

Query = Callable[[SparkSession, str], DataFrame]
FOLDS, HELD_OUT = 4, 2
QUERY_DIVISOR = 100
SHIFTED_DIVISOR, LABELS = 7, 10


def learnt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out fold."""
    return read_table(spark, sf_dir, "labels").filter(~in_fold("doc_id", FOLDS, [HELD_OUT]))


def op1_ann(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.search(vectors, F.col("vec_id") % QUERY_DIVISOR == 0)


def op2_token_counts(spark, sf_dir):
    return token_counts.count_sections(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score_rows(docs, toxicity.learn(docs, learnt_labels(spark, sf_dir)))
    return scored.select(
        "doc_id",
        F.coalesce(in_fold("doc_id", FOLDS, [HELD_OUT]), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "n_matches",
    )


def op4_kn_quality(spark, sf_dir):
    return kn_quality.classify(read_table(spark, sf_dir, "documents"), learnt_labels(spark, sf_dir))


def op5_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op6_token_file(spark, sf_dir):
    return token_file.write_and_read(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.judge(read_table(spark, sf_dir, "documents")).drop("rejected_by")


def op8_simhash(spark, sf_dir):
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_html_extract(spark, sf_dir):
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op10_bpe(spark, sf_dir):
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op11_fingerprints(spark, sf_dir):
    found = fingerprints.against_edited(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprints.text_of(F.col("sketch")).alias("fingerprint"),
        fingerprints.text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op12_lexical_search(spark, sf_dir):
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark, sf_dir):
    vec_id, label = F.col("vec_id"), F.col("label")
    shifted = F.when(vec_id % SHIFTED_DIVISOR == 0, (label + 1) % LABELS).otherwise(label)
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), vec_id % QUERY_DIVISOR == 0, shifted)


QUERIES: dict[str, Query] = {
    "op1_ann": op1_ann,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_kn_quality": op4_kn_quality,
    "op5_packing": op5_packing,
    "op6_token_file": op6_token_file,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_html_extract": op9_html_extract,
    "op10_bpe": op10_bpe,
    "op11_fingerprints": op11_fingerprints,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}
