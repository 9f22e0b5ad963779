"""Deleted interpolation against a plain version with dictionaries; chunks, buckets and awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.llm import language_model as L
from provena.llm.common import read_table
from tests.llm import helpers as H


def tokens_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def remainder(i):
    return 2 if i is None else zlib.crc32(str(i).encode()) % 7


def counts(docs, order):
    grams = [Counter() for _ in range(order + 1)]
    contexts = [Counter() for _ in range(order + 1)]
    for words in docs:
        padded = ["^"] * (order - 1) + words
        for at in range(order - 1, len(padded)):
            for k in range(1, order + 1):
                g = tuple(padded[at - k + 1:at + 1])
                grams[k][g] += 1
                contexts[k][g[:-1]] += 1
    return grams, contexts


def components(grams, contexts, padded, at, order):
    parts, level = [], 0
    for k in range(1, order + 1):
        g = tuple(padded[at - k + 1:at + 1])
        seen = contexts[k][g[:-1]]
        parts.append(grams[k][g] / seen if seen else 0.0)
        if seen:
            level = k * 64 + int(math.log2(seen))
    return parts, level


def brute(rows, tuning, order):
    """Scores with weights from exact events (no cells)."""
    docs = [(i, t, tokens_of(t)) for i, t in rows]
    train = [w for i, _, w in docs if remainder(i) != 2]
    kept = [w for i, _, w in docs if remainder(i) != 2 and i not in tuning]
    full, kept = counts(train, order), counts(kept, order)
    n, v = sum(full[0][1].values()), len(full[0][1])
    events = {}
    for i, _, words in docs:
        if i in tuning and remainder(i) != 2:
            padded = ["^"] * (order - 1) + words
            for at in range(order - 1, len(padded)):
                parts, level = components(*kept, padded, at, order)
                events.setdefault(level, []).append([1 / (v + 1), *parts])
    weights = {}
    for level, e in events.items():
        active = level // 64
        w = np.full(active + 1, 1 / (active + 1))
        e = np.array(e)[:, :active + 1]
        for _ in range(100):
            joint = w * e
            expected = (joint / joint.sum(axis=1, keepdims=True)).sum(axis=0) + 1
            w = expected / expected.sum()
        weights[level] = [*w, *[0.0] * (order - active)]
    out = []
    for i, t, words in docs:
        padded = ["^"] * (order - 1) + words
        score = base = 0.0
        for at in range(order - 1, len(padded)):
            parts, level = components(*full, padded, at, order)
            w = weights.get(level, [1 / (level // 64 + 1)] * (level // 64 + 1) + [0.0] * (order - level // 64))
            score += math.log10(sum(a * b for a, b in zip(w, [1 / (v + 1), *parts])))
            base += math.log10((full[0][1][(padded[at],)] + 1) / (n + v + 1))
        out.append((i, remainder(i) == 2, len(words), sum(full[0][1][(w,)] > 0 for w in words), n, base, score))
    return out


def check(spark, docs, order, rows=None, **parameters):
    rows = rows or [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    ids = sorted({i for i, _ in rows if i is not None})
    marked = spark.createDataFrame([(i,) for i in ids] or [(0,)], "i long").filter(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(10)) == 0)
    want = sorted(brute(rows, {r.i for r in marked.collect()}, order), key=str)
    got = sorted(([*map(r.__getitem__, ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))]
                  for r in L.lm_scores(docs, order=order, **parameters).collect()), key=str)
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [list(r[:5]) for r in want]
    for a, b in zip(got, want):
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(a[6], b[6], rel_tol=0.01, abs_tol=0.02)
    return got


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"W{int(rng.paretovariate(0.6)) % 500}" for _ in range(3000)]
    follow = {w: rng.choices(words, k=4) for w in set(words)}
    rows = []
    for i in range(n):
        text = [rng.choice(words)]
        while rng.random() > 0.03:
            text.append(rng.choice(follow[text[-1]]) if rng.random() < 0.7 else rng.choice(words))
        rows.append((i, " ".join(text), "en", "s"))
    return rows


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_plain_version(spark, order):
    rows = corpus(400, 3)
    got = check(spark, H.docs(spark, rows), order)
    if order > 1:
        held = [r for r in got if r[1]]
        assert sum(r[6] for r in held) > sum(r[5] for r in held) + 100  # the model beats its own base on unseen texts


@pytest.mark.parametrize("order", [2, 3])
def test_chunks_and_buckets_change_nothing(spark, order):
    docs = H.docs(spark, corpus(120, 4)).repartition(3)
    cols = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    whole = sorted(map(tuple, L.lm_scores(docs, order=order).select(cols).collect()))
    cut = sorted(map(tuple, L.lm_scores(docs, order=order, chunk_tokens=37, bucket_keys=64).select(cols).collect()))
    for a, b in zip(whole, cut, strict=True):
        assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-9)


def test_awkward_rows(spark):
    check(spark, H.docs(spark, extra=True), 2)
    check(spark, H.docs(spark, extra=True), 2, chunk_tokens=5)
    assert L.lm_scores(H.empty(spark)).count() == 0


def test_no_training_row(spark):
    only = [(i, "a b", "en", "s") for i in range(200) if remainder(i) == 2][:3] + [(None, None, None, None)]
    rows = L.lm_scores(H.docs(spark, only)).collect()
    assert all((r.held_out, r.train_tokens, r.n_known, r.base_score, r.score) == (True, 0, 0, 0.0, 0.0) for r in rows) and len(rows) == 4


def test_malformed_text(spark):
    df = spark.sql("SELECT id AS doc_id, cast(X'6162ff2063' AS string) AS text FROM range(30)")
    assert {(r.n_tokens, r.n_known) for r in L.lm_scores(df).collect()} == {(3, 3)}


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(0)
    shapes = rng.dirichlet(np.ones(50) * 0.3, 3)
    true = np.array([0.2, 0.5, 0.3])
    n = rng.multinomial(200_000, true @ shapes)
    got = L.expectation_maximisation(n.astype(float), shapes, rounds=500)
    assert np.allclose(got, true, atol=0.02)


def test_probabilities_sum_to_one(spark):
    """Over all one-word continuations of a context, an unknown word standing for all unknown ones."""
    rows = corpus(150, 6)
    train = [tokens_of(t) for i, t, *_ in rows if remainder(i) != 2]
    words = sorted({w for d in train for w in d if w})
    # A text (w) has the tokens w, end; the probability of its first token is that of the text over that of its end.
    held = [i for i in range(10_000, 200_000) if remainder(i) == 2][:len(words) + 2]
    probes = [(i, w, "en", "p") for i, w in zip(held, [*words, "never-seen", ""])]
    scores = {r.doc_id: r.score for r in L.lm_scores(H.docs(spark, rows + probes), order=1).collect()}
    end = 10 ** scores[held[-1]]
    assert math.isclose(sum(10 ** scores[i] / end for i, w, *_ in probes if w) + end, 1, rel_tol=1e-6)


def test_whole_table_counts(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    check(spark, docs, 2)
