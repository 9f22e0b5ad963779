import hashlib
import json

import pytest
from pyspark.sql import functions as F

from provena.llm import chat, oracle
from provena.llm.queries import PROBE
from tests.llm import helpers as H

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["".join(chat.CONTROL), "<<s>", "[[INST]INST]", "\\", "\\\\<|end|>\\", "<|<|end|>end|>", "a\nb", "", "\U0001f600</s>", "<\\|end|>", "$1 \\$0"]


def paths_of(v, at=()):
    if isinstance(v, dict):
        return {p for k, x in v.items() for p in paths_of(x, (*at, k))}
    if isinstance(v, list):
        return {p for x in v for p in paths_of(x, (*at, "[]"))} or {(*at, "[]")}
    return {at}


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"content": "yo", "role": "assistant"}]}, [("user", "hi"), ("assistant", "yo")]),
    ({"messages": [{"role": "user", "content": None}]}, [("user", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}, [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": None}, [("user", "p"), ("assistant", "")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": 42}, [("user", "q"), ("assistant", "42")]),
    ({"role": "user", "text": "flat"}, [("user", "flat")]),
    ({"unknown": {"deep": [1, {"x": "y"}]}}, []),
    ([], []),
    ("just text", []),
]


def records(spark, values):
    df = spark.createDataFrame([(i, None if v is None else json.dumps(v)) for i, v in enumerate(values)], "conv_id long, j string")
    return df.select("conv_id", F.parse_json("j").alias("record"))


def test_layouts_are_recognised_and_converted(spark):
    df = records(spark, [r for r, _ in RECORDS] + [None])
    got = {}
    for r in sorted(chat.canonical_turns(df).collect(), key=lambda r: r.item):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {i: want for i, (_, want) in enumerate(RECORDS) if want}
    assert chat.unmapped(df).agg(F.sum("records")).first()[0] == 4


def test_field_paths_equal_brute_force(spark):
    values = [r for r, _ in RECORDS if isinstance(r, dict)] + [{"a": {"b": {"c": 1.5, "d": True}}, "z": "s", "n": None}, {"odd name": 1, "x-y": {"k": "v"}}]
    df = records(spark, values).select("conv_id", chat.field_paths(F.schema_of_variant("record")).alias("p"))
    for r in df.collect():
        if r.conv_id != 11:  # a list of mixed kinds has no common schema below it
            assert r.p == sorted({".".join(p) for p in paths_of(values[r.conv_id])}), values[r.conv_id]


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.t == r.u and not any(c in r.e for c in chat.CONTROL)


def test_control_strings_can_be_broken_one_after_the_other():
    for s in chat.CONTROL:
        assert chat.ESCAPE not in s and not any(s[:i] == s[-i:] for i in range(1, len(s)))


def turns(spark, rows):
    rec = spark.createDataFrame(rows, SCHEMA).select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    return chat.canonical_turns(rec, order_col="turn")


def conversation_rows():
    rows = [(1, i, ("user", "assistant", "system", None)[i % 4], t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "assistant", None), (2, 0, "assistant", None), (2, None, "user", "first"), (3, 5, "user", "same"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same")]
    return rows + [(None, 0, "assistant", "no id"), (4, 0, "user", "x" * 300_000), (-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]


def test_round_trip_and_loss_mask(spark):
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns(spark, conversation_rows()))).collect()}
    want = {}
    for c, t, role, text in sorted(conversation_rows(), key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in out.items()} == want
    assert {c: r.loss_text for c, r in out.items()} == {c: "".join(t for role, t in v if role == "assistant") for c, v in want.items()}


def test_digests_match_sql(spark):
    rows = [r for r in conversation_rows() if r[0] != -7]
    got = chat.digests(chat.format_turns(turns(spark, conversation_rows()))).toPandas()
    assert H.same(got, H.sql(oracle.chat_sql(PROBE), conversations=spark.createDataFrame(rows, SCHEMA)))
    probe = got[got["conv_id"] == -7].iloc[0]
    assert probe["turns_sha256"] == hashlib.sha256(f"user\n{PROBE}\nassistant\n{PROBE}\n".encode()).hexdigest() and probe["loss_chars"] == len(PROBE)


def test_empty(spark):
    assert chat.digests(chat.format_turns(turns(spark, []))).collect() == []


@pytest.mark.parametrize("m", chat.MAPPINGS)
def test_mappings_have_fingerprints_of_their_own(m):
    assert sum(o.fingerprint == m.fingerprint for o in chat.MAPPINGS) == 1
