import random
import re

import pytest

from provena.llm import licenses as L
from tests.llm import helpers as H

SF = "/root/testdata/sf0.01"


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    w = brute_words(text)
    places = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics_equal_brute_force(seed):
    rng = random.Random(seed)
    templates = [[rng.randrange(4) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 6))] + [[0, 0, 0, 0], [0, 0]]
    a = L.Automaton.of(templates)
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    assert len(a.link) <= 2 * sum(map(len, templates)) + 1
    seq = [rng.randrange(-1, 5) for _ in range(300)]
    lengths, states = a.statistics(seq)
    for i, n in enumerate(lengths):
        assert n == max((k for k in range(1, i + 2) if tuple(seq[i + 1 - k:i + 1]) in runs), default=0)
        run = seq[i + 1 - n:i + 1]
        if n:
            assert len(a.ends(states[i])) == len(set(a.ends(states[i])))
            assert set(a.ends(states[i])) == {(t, e) for t, words in enumerate(templates) for e in range(n, len(words) + 1) if words[e - n:e] == run}


@pytest.mark.parametrize("seed", range(4))
def test_matches_of_every_template_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = {f"t{k}": " ".join(rng.choice("abcd") for _ in range(rng.randint(2, 12))) for k in range(5)}
    s = L.Scanner(texts, {}, min_run=3)
    seq = [rng.choice("abcdx") for _ in range(200)]
    got = {}
    for end, n, t, e in s.matches(L.np.array([s.number.get(w.encode(), -1) for w in seq])):
        got.setdefault((end, t), set()).add((n, e))
    want = {}
    for t, words in enumerate(x.split() for x in texts.values()):
        for end in range(1, len(seq) + 1):
            for n in range(min(end, len(words)), min(3, len(words)) - 1, -1):
                at = {(n, e) for e in range(n, len(words) + 1) if words[e - n:e] == seq[end - n:end]}
                if at:
                    want[end, t] = at
                    break
    assert got == want


def test_whole_table_base_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in L.license_scan(docs).collect()}
    for d in docs.collect():
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(d.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates_are_found_with_changes():
    s = L.Scanner()
    for label, text in L.TEMPLATES.items():
        assert label in s.scan("before it " + text.upper() + " after")[5].split(",")
    w = L.TEMPLATES["mit"].split()
    changed = " ".join(x if i % 12 else "changed" for i, x in enumerate(w))
    got = s.scan("x " * 50 + changed)
    span = next(x for x in got[7] if x[0] == "mit")
    assert "mit" in got[5].split(",") and 50 <= span[1] <= 52 and span[2] <= 50 + len(brute_words(changed)) and 0.8 < span[3] < 1
    assert s.scan("Licensed under CC BY-NC 4.0.")[5] == "cc-by,cc-by-nc"
    assert {"gpl-notice", "gpl-short", "gpl"} <= set(s.scan(L.TEMPLATES["gpl-notice"])[5].split(","))
    assert s.scan("Permission is hereby granted to nobody, and the rest is prose")[5] == ""


def test_awkward_rows(spark):
    texts = ["CC-BY", "cc by cc by", "all rights reservedx", "All Rights Reserved", None, "", "general public license all rights reserved ccé by", L.TEMPLATES["mit"] * 40,
             "the above copyright notice and " * 3000]
    df = H.docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, "All Rights Reserved", "en", "s")], extra=True)
    got = L.license_scan(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
    assert L.license_scan(H.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        L.Scanner({"big": "a " * (L.MAX_TEMPLATE_WORDS + 1)})


def test_places_of_a_repetitive_template_are_stored_once():
    a = L.Automaton.of([[0] * 4000, [0] * 10 + [1], [0] * 10 + [1]])
    assert len(a.places) == 4000 + 2 * 11 == len(set(a.places))
    state = a.statistics([0] * 10)[1][-1]
    assert sorted(a.ends(state)) == [*((0, e) for e in range(10, 4001)), (1, 10), (2, 10)]
    s = L.Scanner({"many": "very " * 4000, "none": "", "odd": "very odd"}, {})
    got = covers(s, ["very"] * 30 + ["odd"])
    assert got["many"] == 30 / 4000 and got["odd"] == 1 and "none" not in got
    assert L.Scanner({}, {}).scan("any text")[:2] == (2, 0)


def test_short_templates_need_all_their_words():
    s = L.Scanner()
    assert "mit-short" in s.scan("It is released under the MIT license today")[5].split(",")
    for prose in ("not under the MIT License", "released under the MIT", "a work licensed under CC BY 4", "GNU general public"):
        assert not {"mit-short", "cc-by-4.0", "gpl-short"} & set(s.scan(prose)[5].split(",")), prose
    assert s.scan("not under the MIT License")[6] == pytest.approx(0.8)  # the score still tells how much is there


def brute_cover(s, t, template, text):
    """The best chain of maximal runs over all diagonals, by trying every order of ends; overlaps count once."""
    runs = []
    for shift in range(-len(template), len(text)):
        n = 0
        for e in range(len(template) + 1):
            same = e < len(template) and 0 <= e + shift < len(text) and template[e] == text[e + shift]
            if not same and n >= min(s.min_run, s.sizes[t]):
                runs.append((e + shift, e, n))
            n = n + 1 if same else 0
    top = {}
    for b, e, n in sorted(runs):
        top[b, e] = n
        for (pb, pe), c in list(top.items()):
            shared = max(0, pb - (b - n), pe - (e - n))
            if pb < b and pe < e and max(b - n + shared - pb, e - n + shared - pe) <= s.max_gap:
                top[b, e] = max(top[b, e], c + n - shared)
    return max(top.values(), default=0) / len(template)


def covers(s, text):
    return {x[0]: x[3] for x in s.scan(" ".join(text))[7]}


def test_one_doubled_word_or_deleted_stretch_anywhere():
    s = L.Scanner()
    for t, (label, notice) in enumerate(L.TEMPLATES.items()):
        w = brute_words(notice)
        for i in range(len(w)):
            for gone in (0, 1, 3, 5, 12):  # none: the word is doubled instead
                text = w[:i] + w[i + gone:] if gone else w[:i + 1] + w[i:]
                got = covers(s, text).get(label, 0.0)
                assert got == pytest.approx(brute_cover(s, t, w, text)), (label, i, gone)
                assert got >= (len(w) - gone - 2 * (s.min_run - 1)) / len(w), (label, i, gone)


def test_a_run_inside_a_longer_one_at_another_place_is_chained():
    s, w = L.Scanner(), brute_words(L.TEMPLATES["bsd"])
    at = w.index("reproduce")
    text = w[:at] + ["retain"] + w[at + 1:]  # as in the sentence before, which makes its run there the longer one
    text[text.index("in", at)] = "x"
    assert covers(s, text)["bsd"] == pytest.approx(brute_cover(s, [*L.TEMPLATES].index("bsd"), w, text))
    assert covers(s, text)["bsd"] == pytest.approx(1 - 2 / len(w))


@pytest.mark.parametrize("seed", range(30))
def test_chains_equal_brute_force(seed):
    rng = random.Random(seed)
    template = [rng.choice("abc") for _ in range(rng.randint(3, 40))]
    s = L.Scanner({"t": " ".join(template)}, {}, min_run=rng.choice([2, 3, 4]), max_gap=rng.choice([0, 2, 12]))
    for _ in range(20):
        text = [w for w in template for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 2]))]
        text += [rng.choice("abcx") for _ in range(rng.randint(0, 30))]
        assert covers(s, text).get("t", 0.0) == pytest.approx(brute_cover(s, 0, template, text))
