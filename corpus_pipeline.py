"""A training corpus from ``documents``: five stages, each written as Parquet and reread by the next.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and returns what it keeps of
``docs``, with the columns of ``documents``; the last returns the mix, a row per repetition.  The
classifier learns from the labelled rows of the whole ``documents`` table (a bounded sample outside the
held-out fold), not from what the rules left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provena.llm import decontaminate, mixing, quality, rules, simhash
from provena.llm.common import read_table
from provena.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the base rule or a risk-controlled rule rejects go."""
    return rules.keep_good(docs, read_table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that score below 0.3 go."""
    model = quality.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, threshold=0.3)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of every group of near duplicates the document of the smallest id stays."""
    return simhash.keep_one(docs, shingle=3, max_distance=2, seed=42)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents in which a benchmark item occurs go."""
    return decontaminate.without_benchmarks(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the sources mixed to their target weights, a row per repetition of a document."""
    return mixing.mix(docs, mixing.cyclic_weights(docs), share=1.5, max_epochs=2.0)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: The classifier's trees and the SimHash fingerprints are beyond SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
