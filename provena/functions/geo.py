"""Coordinate cleaning, great-circle distance and the grid cells used by the radius join."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.functions.common import try_cast

from provena.schema import EARTH_RADIUS_MILES, GEOCODE_ABS_MAX

# Miles per degree of great-circle arc is 69.0933; dividing by 69.09 makes
# the search box a hair larger than needed, so it can never miss a pair.
MILES_PER_DEGREE_LOW = 69.09
MIN_CELL_DEGREES = 0.01


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def clean_geocode(c, bound: float = GEOCODE_ABS_MAX) -> Column:
    """Text or number → double; ``--`` read as ``-``; outside ±bound or NaN → null."""
    c = _c(c)
    v = try_cast(F.replace(c.cast("string"), F.lit("--"), F.lit("-")), "double")
    return F.when(v.isNull() | F.isnan(v) | (v < -bound) | (v > bound),
                  F.lit(None).cast("double")).otherwise(v)


def safe_double(c, default: float = 0.0, data_type=None) -> Column:
    """Non-numeric or null → ``default`` (NaN counts as missing).

    Numeric columns are only widened; text goes through ``try_cast``.
    """
    from pyspark.sql import types as T
    if isinstance(data_type, T.NumericType):
        v = _c(c).cast("double")
    else:
        v = try_cast(_c(c).cast("string"), "double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(v)


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in miles; null when any coordinate is null."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = p2 - p1
    dlmb = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    root = F.sqrt(a)
    # Clamp rounding overshoot to 1 without ``least`` (which would turn a null into 1).
    clamped = F.when(root > 1.0, F.lit(1.0)).otherwise(root)
    return F.lit(2 * EARTH_RADIUS_MILES) * F.asin(clamped)


class Grid:
    """Equal-angle grid sized for one search radius.

    Cell height ``g >= d`` (the radius in degrees), so a point's neighbours
    lie in at most three latitude rows; longitudes use ``n`` columns that
    wrap at the antimeridian.
    """

    def __init__(self, radius_miles: float, max_lon_cells: int = 64):
        self.d = float(radius_miles) / MILES_PER_DEGREE_LOW
        self.g = max(self.d, MIN_CELL_DEGREES)
        self.n = max(1, int(math.floor(360.0 / self.g)))
        self.w = 360.0 / self.n
        self.max_lon_cells = max_lon_cells

    def lat_cell(self, lat) -> Column:
        return F.floor(_c(lat) / F.lit(self.g)).cast("bigint")

    def lon_cell(self, lon) -> Column:
        return F.pmod(F.floor((_c(lon) + F.lit(180.0)) / F.lit(self.w)).cast("bigint"), F.lit(self.n))

    def sub_cell(self, lat, lon, lat_cell: Column, lon_cell: Column, depth: Column) -> Column:
        """Number of the leaf inside a cell that is divided ``2**depth`` times each way."""
        side = F.call_function("shiftleft", F.lit(1).cast("bigint"), depth)
        down = F.floor((_c(lat) / F.lit(self.g) - lat_cell) * side).cast("bigint")
        along = (_c(lon) + F.lit(180.0)) / F.lit(self.w)
        across = F.floor((along - F.floor(along)) * side).cast("bigint")
        inner = lambda x: F.least(F.greatest(x, F.lit(0).cast("bigint")), side - 1)
        return inner(down) * side + inner(across)

    def lat_cells(self, lat) -> Column:
        """Latitude rows a client must probe."""
        lat = _c(lat)
        return F.sequence(F.floor((lat - F.lit(self.d)) / F.lit(self.g)).cast("bigint"),
                          F.floor((lat + F.lit(self.d)) / F.lit(self.g)).cast("bigint"))

    def lon_span(self, lat, lon) -> tuple[Column, Column, Column]:
        """(first column, last column, wraps-everything flag) for a client."""
        lat, lon = _c(lat), _c(lon)
        sin_d = math.sin(math.radians(self.d)) if self.d < 90 else 1.0
        ratio = F.lit(sin_d) / F.cos(F.radians(lat))
        hw = F.degrees(F.asin(F.least(F.lit(1.0), F.abs(ratio))))
        lo = F.floor((lon - hw + F.lit(180.0)) / F.lit(self.w)).cast("bigint")
        hi = F.floor((lon + hw + F.lit(180.0)) / F.lit(self.w)).cast("bigint")
        everything = ((F.abs(lat) + F.lit(self.d)) >= F.lit(90.0)) | ((hi - lo + 1) >= F.lit(self.n))
        return lo, hi, everything

    def lon_cell_count(self, lat, lon) -> Column:
        lo, hi, everything = self.lon_span(lat, lon)
        return F.when(everything, F.lit(self.n)).otherwise(hi - lo + 1)

    def lon_cells(self, lat, lon) -> Column:
        """Distinct longitude columns a client must probe (wrapped with pmod)."""
        lo, hi, everything = self.lon_span(lat, lon)
        wrapped = F.array_distinct(F.transform(F.sequence(lo, hi), lambda x: F.pmod(x, F.lit(self.n))))
        return F.when(everything, F.sequence(F.lit(0).cast("bigint"), F.lit(self.n - 1).cast("bigint"))
                      ).otherwise(wrapped)
