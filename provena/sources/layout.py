"""Storage layout of the cleaned referrals (F4): files that hold neighbours in space and time.

Rows are range-partitioned on an interleaved (Z-order) key of latitude, longitude and date, so a file covers a small box
of all three and its parquet statistics let scans with a radius or a window skip it.  A plain sort by date only helps
windows; rows of one city would lie in every file.
"""

from __future__ import annotations

import functools
import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.geo import MILES_PER_DEGREE_LOW

#: Bits per dimension: 3 x 16 fit a long, and 65,536 steps of a column's range are finer than any file.
BITS = 16


def interleaved(steps: list[Column], bits: int = BITS) -> Column:
    """One long from the bits of several (the first column's bit first).

    A byte's bits are put in their places by a table of 256 longs: nothing is interpreted per bit.
    """
    n = len(steps)
    spread = F.expr("array(" + ", ".join(f"{sum((x >> b & 1) << b * n for b in range(8))}L" for x in range(256)) + ")")

    def placed(step: Column, i: int) -> Column:
        step = step.cast("bigint")
        parts = [F.shiftleft(F.get(spread, F.shiftright(step, low).bitwiseAND(F.lit(255)).cast("int")), low * n + n - 1 - i) for low in range(0, bits, 8)]
        return functools.reduce(Column.bitwiseOR, parts)

    return functools.reduce(Column.bitwiseOR, [placed(s, i) for i, s in enumerate(steps)])


def _step(value: Column, cuts: list[float], below: Column, bits: int = BITS) -> Column:
    """A value's place among quantile cuts, inside its interval by distance, so that skewed values (a city) spread over
    all steps; null is 0.  ``below``: how many distinct cuts lie at or below the value."""
    distinct = sorted(set(cuts))
    edges, size, slots = F.array(*[F.lit(float(e)) for e in distinct]), 1 << bits, max(1, len(distinct) - 1)
    if len(distinct) < 2:
        return F.lit(0).cast("bigint")
    i = F.least(below.cast("int"), F.lit(len(distinct)))
    low, high = F.get(edges, i - 1), F.get(edges, i)
    place = F.when(value.isNull() | (i == 0), F.lit(0.0)).when(i == len(distinct), F.lit(float(slots))).otherwise((i - 1) + (value - low) / (high - low))
    step = F.floor(place * F.lit(size / slots)).cast("bigint")
    return F.coalesce(F.least(step, F.lit(size - 1).cast("bigint")), F.lit(0).cast("bigint"))


def z_ordered(df: DataFrame, lat: str = "latitude", lon: str = "longitude", date: str = "date_of_intake", files: int | None = None) -> DataFrame:
    """``df`` dealt to ``files`` ranges of the interleaved key (as many as Spark chooses, if None) and sorted in each.

    The key's steps follow approximate quantiles of the three columns, for which they are read once more.
    """
    axes = [F.col(lat).cast("double"), F.col(lon).cast("double"), F.unix_date(F.col(date).cast("date")).cast("double")]
    plain = df.select(*[a.alias(f"a{i}") for i, a in enumerate(axes)])
    cuts = plain.approxQuantile([f"a{i}" for i in range(3)], [i / 64 for i in range(65)], 1 / 256)
    splits = [[-math.inf, *sorted(set(c)), math.inf] for c in cuts]
    names = [f"_{kind}{i}" for kind in ("axis", "below") for i in range(3)]
    ranged = df.withColumns(dict(zip(names[:3], axes)))
    usable = [i for i in range(3) if len(splits[i]) > 3]
    if usable:
        ranged = Bucketizer(splitsArray=[splits[i] for i in usable], inputCols=[names[i] for i in usable],
                            outputCols=[names[3 + i] for i in usable], handleInvalid="keep").transform(ranged)
    keyed = ranged.withColumn("_z", interleaved([_step(F.col(names[i]), cuts[i], F.col(names[3 + i]) if i in usable else F.lit(0))
                                                 for i in range(3)])).drop(*names)
    dealt = keyed.repartitionByRange(files, "_z") if files else keyed.repartitionByRange("_z")
    return dealt.sortWithinPartitions("_z").drop("_z")


def in_box(lat: float, lon: float, radius_miles: float, lat_col: str = "latitude", lon_col: str = "longitude") -> Column:
    """A box around a circle as plain comparisons, which parquet statistics can judge (put the exact distance behind it).

    Near a pole, or where the box crosses the antimeridian, only the latitudes bound it.
    """
    d = radius_miles / MILES_PER_DEGREE_LOW
    out = F.col(lat_col).between(lat - d, lat + d)
    if abs(lat) + d < 90:
        w = math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(lat)))))
        if -180 <= lon - w and lon + w <= 180:
            out = out & F.col(lon_col).between(lon - w, lon + w)
    return out
