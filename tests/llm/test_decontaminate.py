import random

import pytest

from provena.llm import decontaminate as D
from provena.session import cut_lineage
from tests.llm import helpers as H


def distance(pattern, text):
    """Sellers' table: least edits of the pattern to any stretch."""
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        cur = [i]
        for j, x in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != x)))
        prev = cur
    return min(prev)


def prose(rng, n):
    return " ".join(rng.choice(["the", "on", "er", "and", "ing"]) + rng.choice(["th", "re", "at", "ou", ""]) for _ in range(n))


def edited(rng, t, k):
    s = list(t)
    for _ in range(k):
        p = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[p] = rng.choice("xyz")
        elif kind == 1:
            del s[p]
        else:
            s.insert(p, rng.choice("xyz"))
    return "".join(s)


def test_myers_equals_the_table():
    rng = random.Random(0)
    for _ in range(600):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, 70))) for a in (1, 0))
        best, end = D.myers(p, t)
        assert best == distance(p, t) and (best == len(p) or distance(p, t[:end]) == best)


def test_all_occurrences_within_budget_and_no_others(spark):
    rng = random.Random(1)
    items = [(i, prose(rng, rng.randint(8, 60)).capitalize()) for i in range(12)] + [(90, "tiny item"), (91, ""), (92, None), (93, " \n ")]
    rows = []
    for i in range(150):
        t = prose(rng, rng.randint(0, 80))
        if rng.random() < 0.6:
            item = D.normalise(items[rng.randrange(12)][1])
            t += "\n" + edited(rng, item, rng.randint(0, int(0.12 * len(item)))).upper() + "  " + prose(rng, 5)
        if rng.random() < 0.1:
            t += rng.choice([" Tiny  Item.", " a tiny\nitem here"])
        rows.append((i, t, "en", "s"))
    docs, table = H.docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t, *_ in rows:
        for j, raw in items[:12]:
            e = distance(D.normalise(raw), D.normalise(t))
            if e <= int(D.ERROR_RATE * len(D.normalise(raw))):
                want[i, j] = e
        if " tiny item " in f" {D.normalise(t)} ":
            want[i, 90] = 0
    for block in (10**6, 500):
        got = D.benchmark_hits(docs, table, block_chars=block).collect()
        assert {(r.doc_id, r.item_id): r.edits for r in got} == want and len(got) == len(want)
    texts = {i: D.normalise(t) for i, t, *_ in rows}
    assert all(distance(D.normalise(dict(items)[r.item_id]), texts[r.doc_id][r.from_char:r.to_char]) == r.edits for r in got)
    clean = D.without_benchmarks(docs, table)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, *_ in rows} - {d for d, _ in want}


def test_a_tenth_of_edits_is_found():
    rng = random.Random(2)
    for n in (8, 20, 60):
        item = D.normalise(prose(rng, n))
        for share in (0.09, 0.1):
            k = int(share * len(item))
            text = list(item)
            for p in rng.sample(range(len(text)), k):
                text[p] = "0"
            found = D.Matcher([(1, item)]).find("before it " + "".join(text) + " after")
            assert [h[:3] for h in found] == [(1, len(item), k)]


def test_short_items_on_both_sides_of_the_border():
    """19 characters: no edits, whole words; 20 characters: two edits, also inside a word."""
    short, long = "abcde fghij klm nop", "abcde fghij klm nopq"
    assert (len(short), len(long)) == (D.MIN_CHARS - 1, D.MIN_CHARS)
    found = lambda item, text: [h[2] for h in D.Matcher([(1, item)]).find(text)]
    assert found(short, f"so {short} it") == found(short, short) == [0]
    assert found(short, f"so {short}s it") == found(short, "so abcde fghij kl nop it") == []
    assert found(long, f"so {long}s it") == [0] and found(long, "so abcde fghij kl nop it") == [2]
    assert found(long, "so abcde fgij kl nop it") == []


def test_blocks_are_on_the_driver_one_at_a_time(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} " * 6) for i in range(60)], "item_id long, text string")
    rows = [(i, f"so item number {i} " + f"item number {i} " * 5 if i % 3 else "clean text", "en", "s") for i in range(90)]
    docs = H.docs(spark, rows, extra=True)
    written = []
    monkeypatch.setattr(D, "cut_lineage", lambda df: written.append(df) or cut_lineage(df))
    blocks = [(len(b), last) for b, last in D.item_blocks(items, block_chars=1500)]
    assert len(blocks) >= 4 and sum(n for n, _ in blocks) == 60 and [last for _, last in blocks] == [False] * (len(blocks) - 1) + [True]
    got = {(r.doc_id, r.item_id) for r in D.benchmark_hits(docs, items, block_chars=1500).collect()}
    assert got == {(r.doc_id, r.item_id) for r in D.benchmark_hits(docs, items).collect()} and {(i, i) for i in range(60) if i % 3} <= got
    left = D.without_benchmarks(docs, items, block_chars=1500)
    assert len(written) == 2 * (len(blocks) - 1)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("any_item") == 1  # the blocks before are done with
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, *_ in rows} - {d for d, _ in got}


@pytest.mark.parametrize("place", ["{}", "{} and more", "before {}", "{0}{0}"])
def test_items_at_the_borders_of_a_text(place):
    item = prose(random.Random(3), 30)
    assert D.Matcher([(1, item)]).find(place.format(item))[0][:3] == (1, len(item), 0)


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again and again"), (2, "the QUICK brown fox  jumps over the lazy dog again and again")],
                                  "item_id long, text string")
    df = H.docs(spark, extra=True)
    got = sorted((r.doc_id, r.item_id) for r in D.benchmark_hits(df, items).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert D.without_benchmarks(df, items).count() == len(H.ROWS) - 3
    for kind in ("int", "string"):
        odd = items.selectExpr(f"CAST(if(item_id = 1, NULL, item_id) AS {kind}) AS item_id", "text")
        assert {r.item_id for r in D.benchmark_hits(df.selectExpr("CAST(doc_id AS string) AS doc_id", "text"), odd).collect()} == {None, 2 if kind == "int" else "2"}
    none = items.filter("item_id < 0")
    assert D.benchmark_hits(df, none).collect() == [] and D.without_benchmarks(df, none).count() == len(H.ROWS)
    assert D.benchmark_hits(H.empty(spark), items).collect() == []
