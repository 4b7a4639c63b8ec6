"""Distances, boxes and grid cells as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.pin import pin
from .fixed import EARTH_A, EARTH_F, EARTH_MEAN

# Grid levels for the cell joins. A query area uses the finest level on which it
# touches at most CELLS cells, whatever its size and shape, so long thin boxes do
# not fall back to cells of their length; the coarsest level covers the whole globe.
LEVEL_SIZES = [0.01 * 4**k for k in range(-2, 8)]
#: Level of the cells of 0.01 degrees; boxes are not cut any finer.
STREET = 2
#: Coordinates beyond this lie in no cell, as their numbers would be those of other cells.
ON_GRID = 320.0
CELLS = 64
_ROW = 1 << 20
LEVEL_BITS = 42
_LEVEL = 1 << LEVEL_BITS

# Length of one degree of latitude at the equator, the shortest one, in km;
# one percent is taken off so that boxes around circles always err outwards.
KM_PER_DEGREE = 110.574 * 0.99


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance on the mean sphere, metres."""
    dp = F.sin(F.radians(lat2 - lat1) / 2)
    dl = F.sin(F.radians(lng2 - lng1) / 2)
    h = dp * dp + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dl * dl
    return 2 * EARTH_MEAN * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def with_ellipsoid_m(df: DataFrame, name: str, lat1, lng1, lat2, lng2) -> DataFrame:
    """Adds the ellipsoidal distance by Lambert's closed formula, metres.

    Written with sin/cos of the reduced latitudes so that the half-angle terms
    of the textbook form become plain products:
    sin P cos Q = (sin b1 + sin b2)/2 and cos P sin Q = (sin b2 - sin b1)/2.
    The steps are pinned, so each is computed once per row.
    """

    def sine(lat):
        return F.sin(F.atan(F.tan(F.radians(lat)) * (1 - EARTH_F)))

    def cosine(lat):
        return F.cos(F.atan(F.tan(F.radians(lat)) * (1 - EARTH_F)))

    df = pin(df, _s1=sine(lat1), _c1=cosine(lat1), _s2=sine(lat2), _c2=cosine(lat2))
    s1, c1, s2, c2 = (F.col(c) for c in ("_s1", "_c1", "_s2", "_c2"))
    # chord form of the haversine of the central angle, stable for near points
    chord = (F.pow(s2 - s1, F.lit(2.0)) + F.pow(c2 - c1, F.lit(2.0))) / 4
    side = c1 * c2 * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    df = pin(df, _h=F.least(F.lit(1.0), chord + side))
    df = pin(df, **{name: _lambert(F.col("_h"), s1 + s2, s2 - s1)})
    return df.drop("_s1", "_c1", "_s2", "_c2", "_h")


def _lambert(h, sm, ds) -> Column:
    sigma = 2 * F.asin(F.sqrt(h))
    sin_sigma = 2 * F.sqrt(h * (1 - h))
    x = (sigma - sin_sigma) * sm * sm / (4 * (1 - h))
    y = (sigma + sin_sigma) * ds * ds / (4 * h)
    d = EARTH_A * (sigma - (EARTH_F / 2) * (x + y))
    return F.when(h <= 0, F.lit(0.0)).when(h >= 1, EARTH_A * sigma).otherwise(d)


def in_box(lat, lng, min_lng, min_lat, max_lng, max_lat) -> Column:
    return (lng >= min_lng) & (lng <= max_lng) & (lat >= min_lat) & (lat <= max_lat)


def circle_margins(lat, radius_km) -> tuple[Column, Column]:
    """Half height and half width, in degrees, of a box around a circle."""
    dlat = radius_km / F.lit(KM_PER_DEGREE)
    edge = F.abs(lat) + dlat
    dlng = F.when(edge >= 89.9, F.lit(180.0)).otherwise(
        F.least(F.lit(180.0), dlat / F.cos(F.radians(F.least(edge, F.lit(89.9)))))
    )
    return dlat, dlng


def circle_box(lat: float, lng: float, radius_km: float) -> tuple[tuple, list[tuple]]:
    """Plain numbers of a box around one circle: (lat range, lng ranges).

    A circle across the date line gives two longitude ranges.
    """
    dlat = radius_km / KM_PER_DEGREE
    edge = abs(lat) + dlat
    dlng = 180.0 if edge >= 89.9 else min(180.0, dlat / math.cos(math.radians(edge)))
    lats = (lat - dlat, lat + dlat)
    if dlng >= 180.0:
        return lats, [(-180.0, 180.0)]
    lo, hi = lng - dlng, lng + dlng
    if lo < -180.0:
        return lats, [(-180.0, hi), (lo + 360.0, 180.0)]
    if hi > 180.0:
        return lats, [(lo, 180.0), (-180.0, hi - 360.0)]
    return lats, [(lo, hi)]


def lng_near(lng1, lng2, dlng) -> Column:
    """Longitudes at most ``dlng`` apart, across the date line too."""
    d = F.abs(lng1 - lng2)
    return F.least(d, 360.0 - d) <= dlng


def _axis(v, size: float, offset: float) -> Column:
    return F.floor((v + F.lit(offset)) / F.lit(size))


def cell_at(level: int, lat, lng) -> Column:
    """Cell number of a point on one level (level, row and column packed)."""
    size = LEVEL_SIZES[level]
    cell = F.lit(level * _LEVEL) + _axis(lat, size, 90.0) * F.lit(_ROW) + _axis(lng, size, 180.0)
    return F.when((F.abs(lat) <= ON_GRID) & (F.abs(lng) <= ON_GRID), cell.cast("bigint"))


def point_cells(lat, lng, levels: list[int] | None = None) -> Column:
    """The point's (level, cell) on every level, or on the ``levels``."""
    return F.array(
        *[
            F.struct(F.lit(k).alias("level"), cell_at(k, lat, lng).alias("cell"))
            for k in (range(len(LEVEL_SIZES)) if levels is None else levels)
        ]
    )


def coarser_cells(cell, finest: int, levels: list[int]) -> Column:
    """(level, cell) on the ``levels`` of the cells that hold a cell of the level ``finest``."""
    row, col = row_and_col(cell)

    def on(k: int) -> Column:
        up = 2 * (k - finest)
        return (F.lit(k * _LEVEL) + F.shiftright(row, up) * F.lit(_ROW) + F.shiftright(col, up)).cast("bigint")

    return F.array(*[F.struct(F.lit(k).alias("level"), on(k).alias("cell")) for k in levels])


def box_level(min_lng, min_lat, max_lng, max_lat) -> Column:
    def fits(k: int) -> Column:
        # a span of n cells touches at most n + 1 of them, rounded up
        wide, high = ((d / LEVEL_SIZES[k] + 2) for d in (max_lng - min_lng, max_lat - min_lat))
        return wide * high <= CELLS

    out = F.when(fits(0), F.lit(0))
    for k in range(1, len(LEVEL_SIZES) - 1):
        out = out.when(fits(k), F.lit(k))
    return out.otherwise(F.lit(len(LEVEL_SIZES) - 1))


def box_cells(level, min_lng, min_lat, max_lng, max_lat) -> Column:
    """Numbers of the cells a box touches on its level."""
    size = size_of(level)

    def axis(v, offset):
        return F.floor((v + F.lit(offset)) / size)

    rows = F.sequence(axis(min_lat, 90.0), axis(max_lat, 90.0))
    cols = F.sequence(axis(min_lng, 180.0), axis(max_lng, 180.0))
    base = level.cast("bigint") * F.lit(_LEVEL)
    return F.flatten(
        F.transform(rows, lambda r: F.transform(cols, lambda c: base + r * F.lit(_ROW) + c))
    )


def cells_around(lat, lng, reach: int, widest) -> Column:
    """(level, cell) of the cells at most ``reach`` cells from the point's own, on every level
    whose cells are up to ``widest`` degrees wide. Cells across the date line are left out."""
    levels = F.filter(F.array(*[F.lit(k) for k in range(len(LEVEL_SIZES))]), lambda k: size_of(k) <= widest)
    steps = F.array(*[F.lit(i).cast("bigint") for i in range(-reach, reach + 1)])

    def on(k):
        row, col = F.floor((lat + 90.0) / size_of(k)), F.floor((lng + 180.0) / size_of(k))
        cells = F.transform(steps, lambda r: F.transform(steps, lambda c: F.when(
            (row + r >= 0) & (col + c >= 0) & ((col + c) * size_of(k) < 360.0),
            F.struct(k.alias("level"), (k.cast("bigint") * F.lit(_LEVEL) + (row + r) * F.lit(_ROW) + col + c).alias("cell")),
        )))
        return F.filter(F.flatten(cells), lambda x: x.isNotNull())

    return F.flatten(F.transform(levels, on))


def size_of(level) -> Column:
    # whole powers of two, so the same number as in LEVEL_SIZES
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (level * 2).cast("int")) * F.lit(LEVEL_SIZES[0])


def cell_box(level, cell) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north edge of a cell, but for rounding."""
    size = size_of(level)
    place = F.pmod(cell, F.lit(_LEVEL))
    row, col = F.floor(place / F.lit(_ROW)), F.pmod(place, F.lit(_ROW))
    w, s = col * size - 180.0, row * size - 90.0
    return w, s, w + size, s + size


def row_and_col(cell) -> tuple[Column, Column]:
    """Row and column of a cell on its level."""
    place = F.pmod(cell, F.lit(_LEVEL))
    return F.shiftright(place, 20), place.bitwiseAND(F.lit(_ROW - 1))


def with_parts(cells: DataFrame) -> DataFrame:
    """Instead of each cell the 16 of ``cell_parts``; short code for many rows."""
    others = [c for c in cells.columns if c not in ("level", "cell")]
    row, col = row_and_col(F.col("cell"))
    df = cells.select(*others, (F.col("level") - 1).cast("int").alias("level"), (row * 4).alias("_row"), (col * 4).alias("_col"), F.explode(F.array(*[F.lit(i) for i in range(16)])).alias("_k"))
    cell = F.col("level").cast("bigint") * F.lit(_LEVEL) + (F.col("_row") + F.shiftright("_k", 2)) * F.lit(_ROW) + F.col("_col") + F.col("_k").bitwiseAND(F.lit(3))
    return df.select(*others, "level", cell.cast("bigint").alias("cell"))


def cell_parts(level, cell) -> Column:
    """(level, cell) of the 16 cells of the next finer level that make up a cell. Sizes differ by
    a power of two, so every point of the cell lies in one of them, rounding included."""
    place = F.pmod(cell, F.lit(_LEVEL))
    row, col = F.floor(place / F.lit(_ROW)) * 4, F.pmod(place, F.lit(_ROW)) * 4
    base = (level.cast("bigint") - 1) * F.lit(_LEVEL)
    return F.array(*[
        F.struct((level - 1).cast("int").alias("level"), (base + (row + r) * F.lit(_ROW) + col + c).cast("bigint").alias("cell"))
        for r in range(4) for c in range(4)
    ])


def zoom_cell_size(zoom) -> Column:
    """Side in degrees of a 50-pixel square at a web-map zoom."""
    return F.lit(50.0 * 360.0 / 256.0) / F.pow(F.lit(2.0), zoom)


def _spread(v: Column) -> Column:
    """Bits of a whole number below 2**32, each followed by a zero bit."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def curve_key(lat, lng, zoom: int) -> Column:
    """Place of a point on the Z-curve over the squares of a web-map zoom. The square of a
    smaller zoom is a range of keys: it shares all but the last two bits per zoom."""
    size = zoom_cell_size(F.lit(float(zoom)))
    gx, gy = (F.floor((v + F.lit(o)) / size).cast("bigint") for v, o in ((lng, 180.0), (lat, 90.0)))
    return _spread(gx).bitwiseOR(F.shiftleft(_spread(gy), 1))


def curve_prefix(key: Column, from_zoom: int, zoom: Column) -> Column:
    """Key of the square of a smaller zoom that holds the key of ``from_zoom``."""
    return F.call_function("shiftright", key, (F.lit(from_zoom) - zoom) * 2)
