"""Near-duplicate groups by SimHash with deletion-variant signatures.

Two fingerprints within ``d`` bits, cut into ``d // 2 + 1`` segments, have a segment in which they
differ by at most one bit.  Each fingerprint is therefore indexed under every segment with one bit
wildcarded; an equality join on those signatures gives candidates and the bit distance verifies them.
(For an even ``d`` the last segment needs no wildcard: if no other segment is within one bit, it is equal.)

Scale: exact copies collapse to one fingerprint before anything is indexed.  A signature shared by
more than ``bucket_cap`` different fingerprints (four times the members that chance puts under a signature,
if that is more) is not paired up.  Its members go an exact linear way
instead: within ``d`` bits there is a midpoint, at most ``ceil(d / 2)`` bits from one and ``d // 2``
from the other, so members are keyed by the points around them and linked, per point, to one member.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import bounded_broadcast, columns_of, settled, tasks_for, text_batches, valid_text
from provena.llm.components import connected_components
from provena.session import cut_lineage

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of one text: lower-cased A-Z, words between ASCII white space, word shingles with repeats."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    xx = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return xx(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    votes = np.zeros(BITS, np.int64)
    step = 1 << 16  # bounds the unpacked bits of a very long text
    for i in range(0, n, step):
        j = min(i + step, n)
        h = np.array([xx(joined[s:e], seed) for s, e in zip(starts[i:j].tolist(), ends[i + shingle - 1:j + shingle - 1].tolist())],
                     dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a signed long (the same 64 bits); null and word-less texts give 0, malformed UTF-8 counts as U+FFFD."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64))

    # Never null, and declared so: a join on it would otherwise filter nulls first, with a second run of the function.
    return F.coalesce(fp(valid_text(text)), F.lit(0).cast("long"))


def hex_column(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def signature_masks(max_distance: int) -> list[int]:
    """For each signature slot the bits it keeps: a segment, less one wildcard bit (the last one whole for an even distance)."""
    m = max_distance // 2 + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    out = []
    for i in range(m):
        seg = (1 << cuts[i + 1]) - (1 << cuts[i])
        if i == m - 1 and max_distance % 2 == 0:
            out.append(seg)
        else:
            out += [seg & ~(1 << p) for p in range(cuts[i], cuts[i + 1])]
    return [_signed(x) for x in out]


def crowd_size(rows: int, masks: list[int], bucket_cap: int) -> int:
    """The most members a signature may have to be paired up: chance alone fills one of ``k`` kept bits with
    ``rows / 2**k``, and four times that is still no crowd."""
    kept = min((m & (1 << BITS) - 1).bit_count() for m in masks)
    return max(bucket_cap, 4 * rows >> kept)


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _distance(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def _around(fps: DataFrame, radius: int) -> DataFrame:
    flips = [sum(1 << p for p in c) for r in range(radius + 1) for c in combinations(range(BITS), r)]
    return fps.select("fp", F.explode(_longs([_signed(x) for x in flips])).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))


def _crowded_links(fps: DataFrame, max_distance: int) -> DataFrame:
    """Links with the components of "within max_distance bits" over ``fps``, without pairing members up."""
    near, far = max_distance // 2, max_distance - max_distance // 2
    hub = _around(fps, near).groupBy("point").agg(F.min("fp").alias("hub"))
    return _around(fps, far).hint("merge").join(hub, "point").filter(F.col("fp") != F.col("hub")).select(
        F.col("fp").alias("x"), F.col("hub").alias("y"))


def links(fps: DataFrame, rows: int, max_distance: int = 2, bucket_cap: int = 8) -> DataFrame:
    """``(x, y)`` links over distinct fingerprints (column ``fp``, ``rows`` of them) whose components are those of
    "within ``max_distance`` bits"."""
    if not 0 <= max_distance <= 4:
        raise ValueError("max_distance must be between 0 and 4")
    masks = signature_masks(max_distance)
    # One fingerprint makes dozens of signatures: a few bytes of input are work for many tasks.
    signatures = rows * len(masks)
    cap = crowd_size(rows, masks, bucket_cap)
    keys = fps.repartition(tasks_for(signatures, 1_000_000)).select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("slot")).select(
        "fp", "slot", F.col("fp").bitwiseAND(F.element_at(_longs(masks), F.col("slot") + 1)).alias("sig"))
    # Spark takes exploded keys for as few bytes as the fingerprints: without a hint it broadcasts them.  The sizes are written, so
    # that a hot signature's join can be split.
    sizes = bounded_broadcast(settled(keys.groupBy("slot", "sig").agg(F.count("*").alias("size")).filter(F.col("size") > 1), signatures, 500_000))
    shared = settled(keys.join(sizes, ["slot", "sig"]), signatures, 500_000)
    a = shared.filter(F.col("size") <= cap)
    pairs = (a.select("slot", "sig", F.col("fp").alias("x")).hint("merge").join(a.select("slot", "sig", F.col("fp").alias("y")), ["slot", "sig"])
             .filter((F.col("x") < F.col("y")) & (_distance("x", "y") <= max_distance)).select("x", "y"))
    crowded = shared.filter(F.col("size") > cap).select("fp").distinct()
    return pairs.unionByName(_crowded_links(crowded, max_distance)).distinct()


def groups(ids: DataFrame, max_distance: int = 2, bucket_cap: int = 8) -> DataFrame:
    """For rows ``(doc_id, fp)``: one row per distinct ``fp`` with ``component_id`` (smallest doc_id of its
    group) and the group's representative ``(keep_id, keep_fp)``.  Null ids count after all others."""
    one = settled(ids.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")), ids.count())
    rows = one.count()
    comp = connected_components(links(one.select("fp"), rows, max_distance, bucket_cap), rows=rows)
    rooted = settled(one.hint("merge").join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), rows)
    best = bounded_broadcast(settled(rooted.groupBy("root").agg(F.min(F.struct("first.none", "first.doc_id", "fp")).alias("best")), rows))
    return settled(rooted.join(best, "root").select(
        "fp", F.col("best.doc_id").alias("component_id"), F.col("best.doc_id").alias("keep_id"), F.col("best.fp").alias("keep_fp")), rows)


def near_duplicates(docs: DataFrame, *, shingle: int = 3, max_distance: int = 2, seed: int = 42, bucket_cap: int = 8,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: a row per input row.

    Null and word-less texts have fingerprint zero and are linked like any other.  Repeated rows and
    repeated ids each keep their row.  A null id is returned as null and names a group only if the group
    has no other id.  An empty table gives an empty result; other columns are not read.
    """
    text_batches(docs.sparkSession)
    ids = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle, seed).alias("fp")))
    named = groups(ids, max_distance, bucket_cap)
    return ids.join(bounded_broadcast(named), "fp").select("doc_id", hex_column(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 3, max_distance: int = 2, seed: int = 42, bucket_cap: int = 8,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns with one row of each near-duplicate group: that of the smallest id.

    Of rows that repeat this id, the one whose columns have the smallest hash stays.  Null ids count last.
    """
    text_batches(docs.sparkSession)
    fp = fingerprint_column(F.col(text_col), shingle, seed).alias("fp")
    named = groups(cut_lineage(docs.select(F.col(id_col).alias("doc_id"), fp)), max_distance, bucket_cap)
    kind = docs.select(id_col).schema[0].dataType
    # Null ids as a pair of plain columns, so that the join's partitioning also serves the window: texts move once.
    key = lambda c: (F.coalesce(c, F.lit(0).cast(kind)).alias("key"), c.isNull().alias("none"))
    stays = named.filter(F.col("fp") == F.col("keep_fp")).select(*key(F.col("keep_id")), "fp")
    # Fingerprints are made again next to the rows: that costs less than a table of all texts with them.
    row = docs.select(F.struct(*columns_of(docs)).alias("row"), *key(F.col(id_col)), fp)
    repeats = Window.partitionBy("key", "none", "fp").orderBy(F.xxhash64("row"))
    return row.join(bounded_broadcast(stays), ["key", "none", "fp"]).withColumn("nth", F.row_number().over(repeats)).filter("nth = 1").select(*columns_of(docs, "row"))
