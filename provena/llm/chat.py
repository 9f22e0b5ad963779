"""Chat formatting: schema fingerprints select the mapping of a record to canonical turns; a reversible template; a loss mask.

A record (a variant) is recognised by a hash of its nested field paths, which selects a declarative mapping
to turns ``(role, text)``.  Formatting marks every turn and escapes control strings inside roles and texts;
the loss mask lists the places of assistant texts.  ``read_back`` undoes it.  All of it is DataFrame functions;
rows of a conversation meet in one shuffle on its id, as its formatted text has to.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template: TURN role TEXT text END, turn after turn.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that must not appear inside a formatted role or text (fixed values: the template's marks and common chat formats' control strings).
CONTROL = (TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"


def escape(c: Column) -> Column:
    """The escape character is doubled, then one is put behind the first character of every control string.

    Control strings are broken one after the other, so overlapping ones are too; nothing new arises, as no
    control string holds the escape character or a beginning of its own at its end.
    """
    out = F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(s[0] + ESCAPE + s[1:]))
    return out


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


# --- records to canonical turns ---------------------------------------------------------------------------------

#: Names that other layouts have for the roles (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths of its leaves (``[]``: elements of a list), and either the list with its role and
    text fields or the single turns as (role, paths joined by a blank line; empty ones are left out)."""

    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "content"
    rename: bool = False

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()


MAPPINGS = (
    Mapping(("role", "text"), items="", role="role", text="text"),
    Mapping(("messages.[].role", "messages.[].content"), items="messages"),
    Mapping(("conversations.[].from", "conversations.[].value"), items="conversations", role="from", text="value", rename=True),
    Mapping(("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("instruction", "input", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("system", "prompt", "response"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("question", "answer"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
)


def field_paths(schema: Column) -> Column:
    """The sorted leaf paths of a variant's schema text, e.g. ``messages.[].role``.

    Walks the names and brackets of ``OBJECT<a: STRING, b: ARRAY<OBJECT<c: STRING>>>`` with a stack of open
    names; leaf types don't matter, so a null or a number in a field changes nothing.
    """
    tokens = F.regexp_extract_all(schema, F.lit(r"(`(?:[^`]|``)*`(?=: )|[A-Za-z_0-9]+(?=: )|OBJECT<|ARRAY<|>|[A-Z][A-Z_]*(?:\([0-9, ]*\))?)"), 1)

    def step(a, t):
        # "at" holds the open steps; a name waits in "name" until its value opens or ends.
        name = F.regexp_replace(F.regexp_replace(t, "^`|`$", ""), "``", "`")
        opens, closes, leaf = t.isin("OBJECT<", "ARRAY<"), t == ">", t.rlike(r"^[A-Z][A-Z_]*(\([0-9, ]*\))?$") & a["value"]
        held = F.when(a["name"].isNotNull(), F.concat(a["at"], F.array(a["name"]))).otherwise(F.concat(a["at"], F.array(F.lit(""))))
        under = F.array_join(F.filter(F.concat(a["at"], F.array(F.coalesce(a["name"], F.lit("")))), lambda s: s != ""), ".")
        none = F.lit(None).cast("string")
        return F.struct(
            F.when(opens, held).when(closes, F.slice(a["at"], 1, F.size(a["at"]) - 1)).otherwise(a["at"]).alias("at"),
            F.when(t == "ARRAY<", F.lit("[]")).when(opens | closes | leaf, none).otherwise(name).alias("name"),
            (~(closes | leaf | (t == "OBJECT<")) | (t == "ARRAY<")).alias("value"),
            F.when(leaf, F.concat(a["paths"], F.array(under))).otherwise(a["paths"]).alias("paths"))

    none = F.lit(None).cast("string")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("at"), none.alias("name"), F.lit(True).alias("value"),
                     F.expr("cast(array() as array<string>)").alias("paths"))
    return F.aggregate(tokens, start, step, lambda a: F.array_sort(F.array_distinct(a["paths"])))


def schema_fingerprint(record: Column) -> Column:
    return F.sha2(F.array_join(field_paths(F.schema_of_variant(record)), "\n"), 256)


def _turn_list(m: Mapping, record: Column) -> Column:
    """The record's turns as array<struct<role, text>> under this mapping."""
    get = lambda v, path: F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path.split(".")), "string")
    blank = F.lit("")
    if m.items == "":
        return F.array(F.struct(F.coalesce(get(record, m.role), blank).alias("role"), F.coalesce(get(record, m.text), blank).alias("text")))
    if m.items:
        items = F.try_variant_get(record, f"$['{m.items}']", "array<variant>")
        role = lambda v: F.coalesce(get(v, m.role), blank)
        named = (lambda v: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), role(v)), role(v))) if m.rename else role
        return F.transform(F.coalesce(items, F.expr("cast(array() as array<variant>)")),
                           lambda v: F.struct(named(v).alias("role"), F.coalesce(get(v, m.text), blank).alias("text")))
    parts = []
    for r, paths in m.turns:
        text = F.array_join(F.filter(F.array(*[F.coalesce(get(record, p), blank) for p in paths]), lambda s: s != ""), "\n\n")
        parts.append(F.struct(F.lit(r).alias("role"), text.alias("text")))
    return F.array(*parts)


def canonical_turns(records: DataFrame, *, id_col: str = "conv_id", order_col: str | None = None, record_col: str = "record",
                    mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``(conv_id, turn, item, role, text)``: the turns of every record whose fingerprint a mapping has.

    Records of one conversation follow each other by ``order_col`` (null first), items by their place.  A null
    record and one of an unknown layout has no turns (``unmapped`` lists those); null texts and roles are empty.
    """
    rec = records.select(F.col(id_col).alias("conv_id"), (F.col(order_col) if order_col else F.lit(0)).cast("long").alias("turn"),
                         F.col(record_col).alias("record")).withColumn("print", schema_fingerprint(F.col("record")))
    turns = F.coalesce(*[F.when(F.col("print") == m.fingerprint, _turn_list(m, F.col("record"))) for m in mappings])
    return rec.select("conv_id", "turn", F.posexplode(turns).alias("item", "e")).select("conv_id", "turn", "item", "e.role", "e.text")


def unmapped(records: DataFrame, *, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``(fingerprint, paths, records)`` of the layouts that no mapping has."""
    s = records.select(field_paths(F.schema_of_variant(F.col(record_col))).alias("paths"))
    return (s.groupBy(F.sha2(F.array_join("paths", "\n"), 256).alias("fingerprint"), "paths").agg(F.count("*").alias("records"))
            .filter(~F.coalesce(F.col("fingerprint").isin([m.fingerprint for m in mappings]), F.lit(False))))


# --- formatting and reading back --------------------------------------------------------------------------------

def format_turns(turns: DataFrame, *, learnt_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_mask)``: one row per conversation; the mask has (start, length) of every
    assistant text in code points from 0.  Equal places are ordered by role and text."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    piece = turns.select("conv_id", "turn", "item", "role", "text", role.alias("r"), text.alias("t")).select(
        "conv_id", F.struct("turn", "item", "role", "text").alias("place"), (F.col("role") == learnt_role).alias("learnt"),
        F.concat(F.lit(TURN), "r", F.lit(TEXT), "t", F.lit(END)).alias("piece"), (F.length("r") + len(TURN) + len(TEXT)).alias("lead"), F.length("t").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("place")
    run = piece.select("conv_id", "piece", "learnt", "lead", "n", F.row_number().over(w).alias("nth"),
                       (F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")).alias("from"))
    got = run.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", "piece"))).alias("p"),
        F.array_sort(F.collect_list(F.when(F.col("learnt"), F.struct((F.col("from") + F.col("lead")).alias("start"), F.col("n").cast("long").alias("length"))))).alias("loss_mask"))
    return got.select("conv_id", F.array_join(F.col("p.piece"), "").alias("formatted"), "loss_mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss_text, formatted)`` from ``formatted`` and ``loss_mask`` alone, everything unescaped."""
    parts = F.filter(F.split("formatted", r"\Q" + END + r"\E"), lambda s: s != "")
    cut = F.transform(parts, lambda s: F.split(F.substr(s, F.lit(len(TURN) + 1)), r"\Q" + TEXT + r"\E"))
    turns = F.transform(cut, lambda p: F.struct(unescape(F.get(p, 0)).alias("role"), unescape(F.get(p, 1)).alias("text")))
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def digests(formatted: DataFrame) -> DataFrame:
    r = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                    F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))
