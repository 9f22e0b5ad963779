"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets: the wanted total is dealt out by weight; sources above ``max_epochs`` times their size are
clamped there and the excess goes to the others by weight, until none is above.  Only two sums per round
come to the driver.

Repetitions: every document of a source is taken ``floor(target / size)`` times, and a seeded part once
more: documents stand in the order of a hash, and those before the point where the running size reaches
the remaining words are taken.  That point is found by sums over 256 hash ranges, then 256 parts of the
one range it lies in, then document by document in that part (1/65536 of the source), so no window ever
holds a whole source.  A mix misses a source's target by half a document at most.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import bounded_broadcast, columns_of, word_count
from provena.session import cut_lineage

SEED = "mix-1"


def cyclic_weights(docs: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), source_col: str = "source") -> DataFrame:
    """``(source, weight)``: the sources in code point order, null last, weigh ``cycle`` over and over.

    The sources are sorted over many tasks; one's place is that within its sorted part plus the sizes of the
    parts before, so there may be any number of sources.  The one window holds a row per part."""
    names = docs.select(F.col(source_col).alias("source")).distinct().orderBy(F.asc_nulls_last("source"))
    placed = cut_lineage(names.withColumn("mid", F.monotonically_increasing_id()))
    part, within = F.shiftright("mid", 33), F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nth = F.col("before") + within
    return placed.withColumn("part", part).join(F.broadcast(before), "part").select(
        "source", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (nth % len(cycle) + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``sources`` (``source, source_size, weight``) plus ``target``.  Weights null, zero or below get nothing."""
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    s = sources.withColumn("w", F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(0.0))
    level = None
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("w") > cap
        clamped, free = s.agg(F.coalesce(F.sum(F.when(above & (F.col("w") > 0), cap)), F.lit(0.0)),
                              F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0))).first()
        nxt = (total - clamped) / free if free > 0 else level
        if nxt == level or nxt is None:
            break
        level = nxt
    return s.withColumn("target", F.least(F.lit(level or 0.0) * F.col("w"), cap)).drop("w")


def _order(seed: str, doc_id: Column, text: Column) -> Column:
    """A place in 0 .. 2**48 - 1 from the seed, the id and the text."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long")


def _reached(parts: DataFrame, by: list[str], part: str, need: DataFrame) -> DataFrame:
    """Of each source the first part at which the running size reaches what is needed, and the size before it."""
    w = Window.partitionBy(*by).orderBy(part)
    run = need.join(parts, [need[c].eqNullSafe(parts[c]) for c in by]).select(*[need[c] for c in need.columns], part, "words")
    run = run.withColumn("upto", F.col("before") + F.sum("words").over(w))
    first = run.filter(F.col("upto") >= F.col("need")).groupBy(*need.columns).agg(F.min(F.struct(part, "words", "upto")).alias("f"))
    return first.select(*[c for c in need.columns if c != "before"], F.col(f"f.{part}").alias(part),
                        (F.col("f.upto") - F.col("f.words")).alias("before"))


def repetitions(docs: DataFrame, keep: list[Column], weights: DataFrame, *, share: float = 1.5, max_epochs: float = 2.0,
                seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``keep`` plus ``source, size, source_size, target, reps`` for every row of ``docs``."""
    text = F.col(text_col)
    base = cut_lineage(docs.select(
        *keep, F.col(source_col).alias("source"), word_count(text).alias("size"), F.col(id_col).alias("tie"),
        _order(seed, F.col(id_col), text).alias("at")).withColumn("hi", F.shiftright("at", 40)).withColumn("lo", F.shiftright("at", 32).bitwiseAND(F.lit(255).cast("long"))))
    names = [c for c in base.columns if c not in ("source", "size", "tie", "at", "hi", "lo")]
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    wts = weights.select(F.col("source").alias("ws"), "weight")
    sources = cut_lineage(sizes.join(wts, F.col("source").eqNullSafe(F.col("ws")), "left").drop("ws"))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    filled = water_fill(sources, total, max_epochs).drop("weight")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = cut_lineage(filled.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    need = plan.filter("need > 0").select("source", "need", F.lit(0).cast("long").alias("before"))
    hi = _reached(base.groupBy("source", "hi").agg(F.sum("size").alias("words")), ["source"], "hi", need)
    inside = base.join(bounded_broadcast(h := cut_lineage(hi)).select(F.col("source").alias("hs"), F.col("hi").alias("hh")),
                       F.col("source").eqNullSafe(F.col("hs")) & (F.col("hi") == F.col("hh")))
    lo = _reached(inside.groupBy("source", "hi", "lo").agg(F.sum("size").alias("words")), ["source", "hi"], "lo", h.select("source", "need", "hi", "before"))
    cuts = cut_lineage(plan.select(F.col("source").alias("ps"), "source_size", "target", "whole").join(
        lo.select(F.col("source").alias("ls"), "need", F.col("hi").alias("cut_hi"), F.col("lo").alias("cut_lo"), "before"),
        F.col("ps").eqNullSafe(F.col("ls")), "left").drop("ls"))
    placed = base.join(bounded_broadcast(cuts), F.col("source").eqNullSafe(F.col("ps")))
    edge = F.coalesce((F.col("hi") == F.col("cut_hi")) & (F.col("lo") == F.col("cut_lo")), F.lit(False))
    inner = F.coalesce((F.col("hi") < F.col("cut_hi")) | ((F.col("hi") == F.col("cut_hi")) & (F.col("lo") < F.col("cut_lo"))), F.lit(False))
    w = Window.partitionBy("source", "hi", "lo").orderBy("at", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(w), F.lit(0))
    out = [*names, "source", "size", "source_size", "target"]
    sure = placed.filter(~edge).select(*out, (F.col("whole") + inner.cast("long")).alias("reps"))
    near = placed.filter(edge).withColumn("start", start).select(
        *out, (F.col("whole") + (F.col("start") + F.col("size") * 0.5 <= F.col("need")).cast("long")).alias("reps"))
    return sure.unionByName(near)


def mix_report(docs: DataFrame, weights: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """A row per input row: ``doc_id, source, size, source_size, target, reps, taken`` (words, repeats counted).

    Null texts have size 0, null sources are a source of their own, repeated rows and ids keep a row
    each (fully equal rows share one hash and stand next to each other), an empty table gives an empty result.
    """
    r = repetitions(docs, [F.col(id_col).alias("doc_id")], weights, id_col=id_col, **options)
    return r.withColumn("taken", F.col("reps") * F.col("size"))


def mix(docs: DataFrame, weights: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` once per repetition, with its number ``repetition`` from 1.

    An input column called ``repetition`` is replaced.
    """
    r = repetitions(docs, [F.struct(*columns_of(docs)).alias("row")], weights, **options).filter("reps > 0")
    cols = [c for c in columns_of(docs, "row")]
    return r.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "reps")).alias("nth")).select(*cols, "nth").drop("repetition").withColumnRenamed("nth", "repetition")
