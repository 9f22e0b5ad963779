"""Ranked search: NRA against full sums, the query against SQL, awkward rows, blocks and shards."""

import random

import numpy as np
import pyarrow as pa
import pytest

from provena.llm import lexical, oracle
from tests.llm import helpers as H

ITEMS = "item_id long, text string"


def random_lists(rng, size):
    lists = []
    for _ in range(rng.randrange(0, 9)):
        docs = np.array(rng.sample(range(size), rng.randrange(0, size + 1)), np.int64)
        top = rng.choice([1, 5, 10**6])
        gains = np.array(sorted((rng.randrange(1, top + 1) for _ in docs), reverse=True), np.int64)
        if len(docs):
            lists.append((docs, gains))
    return lists


def test_nra_equals_full_sums():
    rng = random.Random(5)
    for _ in range(2000):
        size, k = rng.randrange(1, 60), rng.randrange(1, 12)
        lists = random_lists(rng, size)
        full = np.zeros(size, np.int64)
        for docs, gains in lists:
            full[docs] += gains
        found, scores = lexical.nra(lists, size, k)
        assert (full[found] == scores).all() and len(set(found.tolist())) == len(found)
        held = np.flatnonzero(full)
        last = np.sort(full[held])[::-1][min(k, len(held)) - 1] if len(held) else 1
        assert set(np.flatnonzero(full >= max(last, 1)).tolist()) == set(found.tolist())


def test_weights_and_norms():
    assert lexical.weight(3, 1) == 980 and lexical.weight(1, 1) == 287
    n = np.array([1, 10, 10**9])
    assert lexical.length_norms(n, 10, 50).tolist() == [28, 190, 10 + 90 * 10**9 * 10 // 50]
    assert lexical.length_norms(n, 10**12, 10**13).tolist() == [19, 100, 10 + 9 * 10**9]


@pytest.mark.parametrize("block_terms", [10**6, 3])
def test_awkward_rows_equal_sql(spark, block_terms):
    docs = H.docs(spark, [*H.ROWS, (9, "THE the The fox-fox_fox 9 xé lazy", "en", "a"), (10, "brown", "en", "a"), (11, "--- !!", "en", "a")], extra=True)
    items = spark.createDataFrame([(1, "The lazy FOX, the brown dog!"), (2, None), (3, ""), (4, "zzz unknown"), (5, "lorem ipsum 9"), (None, "straße 中文"),
                                   (5, "no words here"), (6, "another text of the same id"), (6, "another text of the same id"), (7, "?!")], ITEMS)
    items = items.selectExpr("*", "'x' AS id", "2 AS term", "3 AS rank", "4 AS score")
    got = lexical.search(docs, items, block_terms=block_terms).toPandas()
    want = H.sql(oracle.lexical_sql(), documents=docs, benchmark=items)
    assert H.same(got, want) and len(got)
    top = got[got["item_id"] == 1].sort_values("rank")
    assert top["rank"].tolist() == [*range(1, len(top) + 1)] and len(top) >= 5


def test_ties_go_by_id_with_null_last(spark):
    docs = H.docs(spark, [(i, "alpha beta", "en", "s") for i in [*range(30, 0, -1), None]] + [(99, "gamma", "en", "s")])
    items = spark.createDataFrame([(1, "alpha")], ITEMS)
    assert [r.doc_id for r in lexical.search(docs, items).orderBy("rank").collect()] == [*range(1, 11)]
    few = H.docs(spark, [(None, "alpha", "en", "s"), (3, "alpha", "en", "s"), (2, "beta", "en", "s"), (1, "beta", "en", "s")])
    assert [r.doc_id for r in lexical.search(few, items).orderBy("rank").collect()] == [3, None]


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha")], ITEMS)
    assert lexical.search(H.empty(spark), items).count() == 0
    assert lexical.search(H.docs(spark), items.limit(0)).count() == 0
    assert lexical.search(H.empty(spark), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_malformed_text(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'616c706861ff41' AS string) AS text UNION ALL SELECT 2L, 'alpha beta' UNION ALL SELECT 3L, 'gamma'")
    items = spark.sql("SELECT 1L AS item_id, cast(X'616c706861ff61' AS string) AS text UNION ALL SELECT 2L, 'alpha'")
    assert {(r.item_id, r.doc_id) for r in lexical.search(docs, items).collect()} == {(1, 1), (2, 2)}


def test_random_corpus_in_shards_equals_sql(spark):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    docs = H.docs(spark, [(i % 350, " ".join(rng.choices(words, k=rng.randrange(0, 60))), "en", "s") for i in range(400)]).repartition(7)
    items = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(1, 20)))) for i in range(25)], ITEMS)
    got = lexical.search(docs, items).toPandas()
    want = H.sql(oracle.lexical_sql(), documents=docs, benchmark=items)
    assert H.same(got, want)


def test_shard_returns_ids_in_order():
    docs = pa.array([5, 3, None, 4])
    n = np.array([2, 2, 2, 2])
    got = lexical._shard(docs, n, np.zeros(4, np.int64), np.ones(4, np.int64), np.ones(4, np.int64), np.array([287]), [np.array([0])], (4, 8), 3)
    assert [docs[i].as_py() for i in got[1]] == [3, 4, 5]
