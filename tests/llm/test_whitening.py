"""Whitening: the spectrum against numpy's, the query against a brute-force version, awkward vectors."""

import numpy as np
import pytest

from provena.llm import whitening as W
from provena.llm.common import read_table

SCHEMA = "vec_id long, embedding array<float>, label int"


def matrices():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 40):
        x = rng.standard_normal((3 * n, n))
        yield x.T @ x
        yield (x + 1e3).T @ (x + 1e3)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    for values in ([1.0] * 12, [0.0] * 12, [5.0] * 6 + [1.0] * 6, [2.0 ** -i for i in range(12)], [10.0 ** (-i) for i in range(12)],
                   [1, 1 + 1e-13, 1 - 1e-13, *range(2, 11)], [-1.0, 0, 1] * 4, [7.0] + [0.0] * 11):
        yield q @ np.diag(values) @ q.T


@pytest.mark.parametrize("i", range(18))
def test_spectrum_equals_numpy(i):
    a = [*matrices()][i]
    a = (a + a.T) / 2
    values, vectors = W.spectrum(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-13 * len(a) * size, rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-13 * len(a))
    assert np.allclose(a @ vectors, vectors * values, atol=3e-13 * len(a) * size)


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((9, 9)))
    values = np.array([3.0, 1e-9, 2, 8, -1e-8, -5, -1e3, -2, -1])
    u = W.polar_factor(q @ np.diag(values) @ q.T)
    assert np.allclose(u, q @ np.diag(np.sign(values)) @ q.T, atol=1e-5)
    assert np.allclose(u @ u, np.eye(9), atol=1e-12)


def brute(rows, components):
    usable = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in usable], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = np.array([[float(n * int(e) - int(t)) / n for e, t in zip(r, s)] for r in x])
    v = y.T @ y / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for k in range(min(components, len(values))):
        z = y @ axes[:, k] / np.sqrt(values[k])
        for (i, _), r, w in zip(usable, x, z):
            out.setdefault((i, k + 1), []).append((n, sum((n * int(e) - int(t)) ** 2 for e, t in zip(r, s)), w, values[k] / np.trace(v)))
    return out


def check(df, want):
    got = {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, r.whitened, r.explained, r.identity_error))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    signs = {}
    for key in want:
        for a, b in zip(sorted(got[key], key=lambda t: abs(t[2])), sorted(want[key], key=lambda t: abs(t[2]))):
            assert a[:2] == b[:2] and abs(a[3] / b[3] - 1) < 1e-9 and a[4] < 1e-9
            assert abs(abs(a[2]) - abs(b[2])) < 1e-7
            if abs(b[2]) > 1e-3:
                signs.setdefault(key[1], set()).add(a[2] * b[2] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_query_table_equals_brute_force(spark):
    table = read_table(spark, "/root/testdata/sf0.001", "embeddings")
    check(W.whiten(table), brute([(r.vec_id, r.embedding) for r in table.collect()], 32))


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.standard_normal(5)], 0) for i in range(30)]
    rows += [rows[0], (1, rows[2][1], 0), (None, rows[3][1], None)]
    bad = [(90, None, 0), (91, [1.0, None, 2.0, 3.0, 4.0], 0), (92, [float("nan")] * 5, 0), (93, [float("inf"), 0.0, 0.0, 0.0, 0.0], 0),
           (94, [], 0), (95, [1.0], 0), (96, [1.0] * 6, 0)]
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "1 AS id", "2 AS vector", "3 AS n", "4 AS component", "'x' AS whitened")
    check(W.whiten(df), brute([(i, v) for i, v, _ in rows], 32))


def test_large_counts_keep_deviations_exact():
    centre = W.Centre(10**9, [10**15 + 7, 10**15 - 3])
    x = np.array([[1_000_000, 1_000_500], [1_000_123, 999_000]])
    assert centre.deviations(x) == [sum((10**9 * int(e) - s) ** 2 for e, s in zip(r, (10**15 + 7, 10**15 - 3))) for r in x]


def test_tables_without_a_spectrum(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [float("nan"), 1.0], 0)], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(4)], SCHEMA)).count() == 0
    line = W.whiten(spark.createDataFrame([(i, [float(i), 5.0, 2.0 * i], 0) for i in range(6)], SCHEMA)).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
