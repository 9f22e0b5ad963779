"""Texts that are no UTF-8: no operator stops, and each reads them as the same text with U+FFFD."""

import pytest
from pyspark.sql import functions as F

from provena.llm import decontaminate, language_model, lexical, licenses, mixing, quality, rules, simhash, tokens, toxicity
from provena.llm.common import text_batches, valid_text
from tests.llm import helpers as H

ITEM = "The quick brown fox jumps over the lazy dog again and again"


@pytest.fixture(scope="module")
def tables(spark):
    broken = H.malformed(H.docs(spark)).repartition(3)
    return broken, broken.withColumn("text", F.when(F.col("text").isNotNull(), valid_text(F.col("text"))))


def _labels(spark):
    return H.labels(spark, [(i, i % 2, i % 2) for i in range(12)])


OPERATORS = {
    "simhash": lambda d: simhash.near_duplicates(d),
    "keep_one": lambda d: simhash.keep_one(d).drop("text"),
    "tokens": lambda d: tokens.token_counts(d),
    "fields": lambda d: tokens.token_counts(d.withColumn("both", tokens.field_sections(["lang", "text"])[0]), tokens.field_sections(["lang", "text"])[1], text_col="both"),
    "quality": lambda d: quality.quality_scores(d, _labels(d.sparkSession)),
    "quality_kept": lambda d: quality.keep_good(d, quality.train(d, _labels(d.sparkSession)), threshold=0.5).drop("text"),
    "toxicity": lambda d: toxicity.toxicity(d, _labels(d.sparkSession)),
    "decontaminate": lambda d: decontaminate.benchmark_hits(d, d.select(F.col("doc_id").alias("item_id"), "text").filter("length(text) < 500")),
    "without": lambda d: decontaminate.without_benchmarks(d, d.sparkSession.createDataFrame([(1, ITEM)], "item_id long, text string")).drop("text"),
    "licenses": lambda d: licenses.license_scan(d),
    "lexical": lambda d: lexical.search(d, d.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id IN (1, 8)").distinct(), k=3).drop("score"),
    "language_model": lambda d: language_model.lm_scores(d, order=2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_as_replacement_characters(tables, name):
    broken, valid = tables
    run = OPERATORS[name]
    as_rows = lambda df: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    got = as_rows(run(broken))
    assert got == as_rows(run(valid)) and (got or name == "decontaminate")


def test_native_operators_go_on(tables):
    broken, _ = tables
    assert rules.quality_rules(broken, _labels(broken.sparkSession)).count() == broken.count()
    assert mixing.mix_report(broken, mixing.cyclic_weights(broken), share=1.5, max_epochs=2.0).count() == broken.count()


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    text_batches(spark)

    def rows(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})
    long = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("a"), 3_000_000).alias("text"))
    short = spark.range(0, 1000, 1, 1).select(F.lit("a").alias("text"))
    assert max(r.n for r in long.mapInArrow(rows, "n long").collect()) <= 23
    assert max(r.n for r in short.mapInArrow(rows, "n long").collect()) <= 256
