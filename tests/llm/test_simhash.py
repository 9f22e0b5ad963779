import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from provena.llm import components, simhash
from tests.llm import helpers as H


def brute_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i:i + 3] for i in range(len(w) - 2)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(points, d):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for i, p in enumerate(points):
        for q in points[:i]:
            if (p ^ q).bit_count() <= d:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: find(p) for p in points}


@pytest.mark.parametrize("text", [r[1] for r in H.ROWS] + ["A b", "É É É é", "x " * 5 + "X"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("d", [0, 1, 2, 3, 4])
def test_signatures_hit_every_pair_within_distance(d):
    rng = random.Random(d)
    masks = [m & (1 << 64) - 1 for m in simhash.signature_masks(d)]
    for _ in range(300):
        a, b = rng.getrandbits(64), 0
        b = a
        for p in rng.sample(range(64), rng.randint(0, d)):
            b ^= 1 << p
        assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("d,cap", [(2, 8), (2, 2), (3, 3), (1, 1)])
def test_components_equal_brute_force_with_crowded_buckets(spark, d, cap):
    rng = random.Random(7)
    points = {rng.getrandbits(64) for _ in range(30)}
    for centre in [0, rng.getrandbits(64)]:  # crowds: chains of close points
        p = centre
        for _ in range(60):
            points.add(p)
            p ^= 1 << rng.randrange(64)
            points.add(centre ^ (1 << rng.randrange(64)))
    points = sorted(points)
    signed = [simhash._signed(p) for p in points]
    ids = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.groups(ids, d, cap).collect()}
    want = brute_roots(points, d)
    least = {}
    for i, p in enumerate(points):
        least.setdefault(want[p], i)
    assert got == {s: least[want[p]] for s, p in zip(signed, points)}


def test_near_duplicates_on_awkward_rows(spark):
    got = simhash.near_duplicates(H.docs(spark, extra=True)).collect()
    assert len(got) == len(H.ROWS)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[(3, "0" * 16)] == by[(4, "0" * 16)] == by[(5, "0" * 16)] == by[(None, "0" * 16)] == 3
    fp = f"{brute_fingerprint(H.ROWS[0][1]):016x}"
    assert by[(1, fp)] == by[(2, fp)] == 1
    assert by[(None, f"{brute_fingerprint('no id here at all'):016x}")] is None
    assert simhash.near_duplicates(H.empty(spark)).collect() == []


def test_keep_one(spark):
    df = H.docs(spark, extra=True)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    rows = sorted(((r.doc_id or -1, r.text) for r in kept.collect()), key=str)
    want = [(1, H.ROWS[0][1]), (3, None), (-1, "no id here at all"), (6, H.LONG), (7, "one"), (7, "another text of the same id"), (8, H.ROWS[-1][1])]
    assert rows == sorted(want, key=str)
    assert simhash.keep_one(H.empty(spark)).count() == 0


def test_connected_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(500, 500), (None, 3), (601, 600), (600, 601)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 300)}, 600: 600, 601: 600}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_pair_explosion_in_a_crowd(spark):
    ids = spark.range(1500).select(F.col("id").alias("fp"))  # many points share signatures
    n = simhash.links(ids, 1500, 2).count()
    assert n < 40 * 1500


def test_crowds_grow_with_chance_only():
    masks = simhash.signature_masks(2)
    assert [simhash.crowd_size(n, masks, 8) for n in (0, 1500, 2**31, 10 * 2**31)] == [8, 8, 8, 40]
    assert simhash.crowd_size(2**30, simhash.signature_masks(4), 8) == 4 * 2**10


def test_no_exploded_side_is_broadcast(spark, monkeypatch):
    """Beyond the counted bound every join is a merge join: signatures and edges are taken for less than they are."""
    from provena.llm import common as C
    plans, keep = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    for module in (simhash, components):
        monkeypatch.setattr(module, "bounded_broadcast", lambda df: C.bounded_broadcast(df, 0), raising=False)
    rng = random.Random(5)
    points = [rng.getrandbits(63) for _ in range(200)]
    ids = spark.createDataFrame([(i, p ^ (1 << i % 64 if i % 2 and i % 64 < 63 else 0)) for i, p in enumerate(points * 2)], "doc_id long, fp long")
    named = simhash.groups(ids, 2)
    assert named.count() > 200 and sum("SortMergeJoin" in p for p in plans) >= 4
    assert not [p for p in plans if "BroadcastHashJoin" in p]
