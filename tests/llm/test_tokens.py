import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provena.llm import tokens
from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def brute(ids, widths, text, sections, rule):
    """Every byte's section, then every token's bytes."""
    starts = [len(text[:i].encode()) for i in range(len(text) + 1)]
    owner = [-1] * starts[-1]
    for i in sorted(range(len(sections)), key=lambda i: (*sections[i], i)):
        a, b = (min(max(x, 0), len(text)) for x in sections[i])
        for p in range(starts[a], starts[max(a, b)]):
            owner[p] = i if owner[p] == -1 else owner[p]
    out, at = {}, 0
    for w in widths:
        mine = owner[at:at + w]
        at += w
        if rule == "start":
            out[mine[0]] = out.get(mine[0], 0) + 1
        elif rule == "share":
            for s in mine:
                out[s] = out.get(s, 0) + 1 / w
        else:
            best = max(dict.fromkeys(mine), key=lambda s: (mine.count(s), -mine.index(s)))
            out[best] = out.get(best, 0) + 1
    return out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution_equals_brute_force(rule):
    enc = tokens.encoder(tokens.default_vocabulary(), tokens.default_pattern())
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["the ", "é", "\n", "中文", "hello", " ", "  \n", "\U0001f600", "x1"]) for _ in range(rng.randint(1, 40)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 6)))
        sections = [(a, b) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8] + ([(2, 5)] if rng.random() < 0.3 else [])
        widths = enc.width[enc.encode(text)]
        counts, outside, _ = tokens.attribute(widths, sections, tokens.char_starts(text), rule)
        want = brute(None, widths.tolist(), text, sections, rule)
        assert counts.tolist() == pytest.approx([want.get(i, 0) for i in range(len(sections))])
        assert outside == pytest.approx(want.get(-1, 0))
        assert counts.sum() + outside == pytest.approx(len(widths))


def test_ids_equal_an_independent_encoder(other):
    enc = tokens.encoder(tokens.default_vocabulary(), tokens.default_pattern())
    for t in ["<|endoftext|> a", "a" + " " * 9000 + "b", "a" + "\n" * 5000, " " * 4097 + "\tb", "".join(chr(c) for c in range(32, 900))]:
        assert enc.encode(t).tolist() == other.encode(t, add_special_tokens=False).ids


def test_whole_table(spark, other):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    for r in tokens.token_counts(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        rows = sorted(got[d.doc_id], key=lambda r: r.section)
        n = len(other.encode(d.text, add_special_tokens=False).ids)
        assert sum(r.n_tokens for r in rows) == n == rows[0].doc_tokens
        assert "".join(d.text[r.from_char:r.to_char] for r in rows) == d.text and len(rows) == d.text.count("\n") + (not d.text.endswith("\n"))


def test_fields_of_a_row(spark, other):
    rows = [(1, "A title", "and a body\nof two lines", "é中"), (2, None, "", "x"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, title string, body string, tail string")
    text, spans = tokens.field_sections(["title", "body", "tail"], separator=" | ")
    got = {}
    for r in tokens.token_counts(df.withColumn("text", text), spans, rule="share").collect():
        got.setdefault(r.doc_id, {})[r.section] = r
    for i, *fields in rows:
        whole = " | ".join(f or "" for f in fields)
        assert sum(r.n_tokens for r in got[i].values()) == pytest.approx(len(other.encode(whole, add_special_tokens=False).ids))
        assert [whole[got[i][k].from_char:got[i][k].to_char] for k in range(3)] == [f or "" for f in fields]
        assert got[i][-1].n_tokens > 0  # the separators


def test_awkward_rows(spark):
    got = tokens.token_counts(H.docs(spark, extra=True)).collect()
    assert sum(1 for r in got if r.doc_id == 2) == 2
    assert [(r.section, r.n_tokens, r.doc_tokens) for r in got if r.doc_id == 3] == [(0, 0.0, 0)]
    none = tokens.token_counts(H.docs(spark), F.lit(None).cast("array<struct<a: long, b: long>>")).collect()
    assert len(none) == len(H.ROWS) and all(r.section == -1 and r.n_tokens == r.doc_tokens for r in none)
    given = F.array(F.struct(F.lit(4).alias("a"), F.lit(9).alias("b")), F.struct(F.lit(-3).alias("a"), F.lit(2).alias("b")))
    assert tokens.token_counts(H.docs(spark), given, rule="share").filter("section = 0").count() == len(H.ROWS)
    assert tokens.token_counts(H.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        tokens.attribute(tokens.np.array([1]), [], tokens.char_starts("a"), "other")
