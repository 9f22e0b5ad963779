"""The registered queries on driver tables: names, columns, plans, oracles, and the pipeline against brute force."""

import os
import random
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from provena.llm import decontaminate, mixing, oracle, quality, queries, rules
from provena.llm.common import read_table
from tests.llm import helpers as H
from tests.llm.test_decontaminate import distance
from tests.llm.test_rules import brute as brute_rules
from tests.llm.test_simhash import brute_fingerprint, brute_roots

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: {"doc_id", "fingerprint", "component_id"}, 2: {"doc_id", "size", "source_size", "target", "taken"}, 3: {"doc_id", "n_tokens"},
    4: {"doc_id", "held_out", "score", "predicted"}, 5: {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    6: {"page_id", "host", "path", "rule", "verdict"}, 7: {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    8: {"doc_id", "held_out", "score", "predicted"}, 9: {"doc_id", "item_id"}, 10: {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    11: {"item_id", "rank", "doc_id", "score"}, 12: {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
    13: {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
}


def by_number(n):
    return next(k for k in queries.QUERIES if k.startswith(f"op{n}_"))


def test_all_are_registered():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries()) and set(queries.ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("n", range(1, 14))
def test_columns_and_rows(spark, n):
    df = queries.QUERIES[by_number(n)](spark, SF)
    assert COLUMNS[n] <= set(df.columns)
    rows = df.count()
    if n in (1, 2, 4, 5, 8, 10, 13):
        assert rows == read_table(spark, SF, "documents").count()


@pytest.mark.parametrize("n", [2, 5, 6, 7])
def test_native_operators_plan_no_python(spark, n):
    plan = queries.QUERIES[by_number(n)](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|Cartesian", plan)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert H.same(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df())


def nearest(pattern, text):
    """Sellers' table, a row at a time: least edits of the pattern to any stretch."""
    x = np.array([*map(ord, text)], np.int64)
    place = np.arange(len(x) + 1)
    row = np.zeros(len(x) + 1, np.int64)
    for c in pattern:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (x != ord(c)))
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


def test_nearest_equals_the_table():
    rng = random.Random(0)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, 30))) for a in (1, 0))
        assert nearest(p, t) == distance(p, t)


def test_pipeline_equals_brute_force(spark):
    docs = [r.asDict() for r in read_table(spark, SF, "documents").collect()]
    labels = read_table(spark, SF, "labels")
    # 5: with so few labels no calibrated rule is active, which the operator's own tests cover
    assert rules.quality_rules(read_table(spark, SF, "documents"), labels).filter("failed_rule IS NOT NULL").count() == 0
    docs = [d for d in docs if not brute_rules(d["text"])[-1]]
    # 4
    model = quality.train(read_table(spark, SF, "documents"), labels)
    docs = [d for d in docs if model.probability(np.array([quality.statistics(d["text"])]))[0] >= 0.3]
    # 1
    prints = {d["doc_id"]: brute_fingerprint(d["text"]) for d in docs}
    roots = brute_roots(sorted(set(prints.values())), 2)
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(roots[p], i)
    docs = [d for d in docs if d["doc_id"] in least.values()]
    # 9
    items = [decontaminate.normalise(r.text) for r in read_table(spark, SF, "benchmark").collect()]
    docs = [d for d in docs if not any(nearest(i, decontaminate.normalise(d["text"])) <= int(decontaminate.ERROR_RATE * len(i)) for i in items if i)]
    # 2
    frame = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in docs], H.SCHEMA)
    mixed = H.sql(oracle.mixing_sql(), documents=frame).merge(frame.toPandas()[["doc_id"]], on="doc_id")
    want = {int(r.doc_id): int(r.taken) // int(r.size) for r in mixed.itertuples() if r.size and r.taken}
    got = {}
    df = corpus_pipeline.run(spark, SF)
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "repetition"]
    for r in df.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want


def test_pipeline_on_edited_items_near_copies_and_an_active_rule(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda n: [rng.choice("abcdefghij") + "%d" % rng.randrange(4000) for _ in range(n)]
    texts = [" ".join(prose(rng.randint(55, 65))) for _ in range(3200)]
    marks = [1] * len(texts)
    texts += [" ".join(x + "***" for x in prose(60)) for _ in range(100)]
    marks += [0] * 100
    items = [" ".join(prose(24)) for _ in range(3)]
    edits = {}
    for item in items:
        budget = int(decontaminate.ERROR_RATE * len(item))
        for k in (1, budget, budget + 4):
            changed = [*item]
            for at in range(k):
                changed[at * len(item) // k + 1] = "~"
            edits[len(texts)] = k <= budget
            texts.append(" ".join([*prose(50), "".join(changed), *prose(5)]))
    copies = {}
    for bits in (1, 2, 3):
        words = prose(200)
        own = brute_fingerprint(" ".join(words))
        while True:
            other = [*words]
            other[rng.randrange(len(other))] = prose(1)[0]
            if (own ^ brute_fingerprint(" ".join(other))).bit_count() == bits:
                break
        copies[len(texts) + 1] = bits
        texts += [" ".join(words), " ".join(other)]
    docs = H.docs(spark, [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)])
    labels = H.labels(spark, [(i, m, 0) for i, m in enumerate(marks)])
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        table.write.parquet(os.fspath(tmp_path / f"{name}.parquet"))
    docs, labels = (read_table(spark, os.fspath(tmp_path), t) for t in ("documents", "labels"))
    judged = H.sql(oracle.rules_sql(), documents=docs, labels=labels)
    assert (~judged["kept"] & ~judged["base_failed"]).sum() >= 100
    kept = sorted(int(i) for i in judged[judged["kept"]]["doc_id"])
    p = quality.train(docs, labels).probability(np.array([quality.statistics(texts[i]) for i in kept]))
    kept = [i for i, x in zip(kept, p) if x >= 0.3]
    assert {*edits, *copies} <= {*kept}
    prints = {i: brute_fingerprint(texts[i]) for i in kept}
    roots, least = brute_roots(sorted(set(prints.values())), 2), {}
    for i in kept:
        least.setdefault(roots[prints[i]], i)
    kept = sorted(least.values())
    assert {i: i not in kept for i in copies} == {i: bits <= 2 for i, bits in copies.items()}
    held = {i for i in kept if any(nearest(t, texts[i]) <= int(decontaminate.ERROR_RATE * len(t)) for t in items)}
    assert held == {i for i, found in edits.items() if found}
    left = docs.filter(docs["doc_id"].isin([i for i in kept if i not in held]))
    mixed = H.sql(oracle.mixing_sql(), documents=left)
    want = {int(r.doc_id): int(r.taken) // int(r.size) for r in mixed.itertuples() if r.taken}
    got = {}
    for r in corpus_pipeline.run(spark, os.fspath(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want


def test_stages_on_awkward_rows(spark, tmp_path):
    for name, table in (("labels", H.labels(spark, [(1, 1, 0)])), ("benchmark", spark.createDataFrame([], "item_id long, text string")), ("documents", H.docs(spark))):
        table.write.parquet(os.fspath(tmp_path / f"{name}.parquet"))
    long = "The many words of this text differ: " + " ".join(f"word{i}" for i in range(80))
    for rows in (H.ROWS + [(20, long, "en", "s"), (20, long, "en", "s"), (None, long + " x", None, None)], []):
        df = H.docs(spark, rows, extra=True)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, os.fspath(tmp_path))
            assert out.columns == df.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, df, os.fspath(tmp_path)).count()


def test_mixing_module_names_match():
    assert mixing.SEED in oracle.mixing_sql()
