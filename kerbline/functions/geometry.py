"""Tile grids, box overlap, crop windows, crack units, and geographic arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.vocab import EARTH_RADIUS_TRACK_M


def tile_boxes(width: Column, height: Column, cols: int = 3, rows: int | None = None, region: str = "lower_half") -> Column:
    """`array<struct<tile, left, upper, right, lower>>`, row-major, half-even edges."""
    if region not in ("lower_half", "full"):
        raise ValueError(f"unknown region {region}")
    rows = rows or (3 if region == "full" else 2)
    if cols <= 0 or rows <= 0:
        raise ValueError("cols and rows must be positive")
    top = F.lit(0) if region == "full" else F.floor(height / 2)
    step_x = width / F.lit(cols)
    step_y = (height - top) / F.lit(rows)

    def edge(value: Column) -> Column:
        return F.rint(value.cast("double")).cast("int")

    boxes = [
        F.struct(
            F.lit(f"tile_{r * cols + c}").alias("tile"),
            edge(c * step_x).alias("left"),
            edge(top + r * step_y).alias("upper"),
            edge((c + 1) * step_x).alias("right"),
            edge(top + (r + 1) * step_y).alias("lower"),
        )
        for r in range(rows)
        for c in range(cols)
    ]
    return F.array(*boxes)


def center_box_to_corner(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct((x - w / 2).alias("x"), (y - h / 2).alias("y"), w.alias("w"), h.alias("h"))


def overlap_share(tile: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Share of the tile covered by the box `x, y, w, h`."""
    dx = F.least(tile["right"].cast("double"), x + w) - F.greatest(tile["left"].cast("double"), x)
    dy = F.least(tile["lower"].cast("double"), y + h) - F.greatest(tile["upper"].cast("double"), y)
    area = F.greatest(F.lit(1.0), ((tile["right"] - tile["left"]) * (tile["lower"] - tile["upper"])).cast("double"))
    return F.when((dx > 0) & (dy > 0), dx * dy / area).otherwise(F.lit(0.0))


def window_starts(size: Column, tile: int, stride: int, clamp: bool = True) -> Column:
    """Sliding starts plus a flush-right one; `clamp` returns [0] when size <= tile."""
    last = size - F.lit(tile)
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    starts = F.array_union(regular, F.array(last))
    return F.when(size <= tile, F.array(F.lit(0))).otherwise(starts) if clamp else starts


def fill_length_mm(mm: Column, px: Column, mm_per_pixel: float | None) -> Column:
    return mm if mm_per_pixel is None else F.coalesce(mm, px * F.lit(float(mm_per_pixel)))


def fill_area_mm2(mm2: Column, px: Column, mm_per_pixel: float | None) -> Column:
    return mm2 if mm_per_pixel is None else F.coalesce(mm2, px * F.lit(float(mm_per_pixel) ** 2))


def crack_width_band(width_mm: Column) -> Column:
    return F.when(width_mm < 1.6, "narrow").when(width_mm <= 3.2, "moderate").when(width_mm.isNotNull(), "wide")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_m: float) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2))
    return F.lit(2.0 * radius_m) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def has_fix(lat: Column, lon: Column) -> Column:
    """Both coordinates present and finite."""
    inf = F.lit(float("inf"))
    ok = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) != inf) & (F.abs(lon) != inf)
    return F.coalesce(ok, F.lit(False))


def valid_fix(lat: Column, lon: Column) -> Column:
    """Finite, inside the coordinate range, and not the null island."""
    inside = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    island = (F.abs(lat) < 1e-12) & (F.abs(lon) < 1e-12)
    return has_fix(lat, lon) & F.coalesce(inside & ~island, F.lit(False))


def enu_to_lat(lat0: Column, north_m: Column) -> Column:
    return lat0 + north_m / F.lit(EARTH_RADIUS_TRACK_M) * F.lit(180.0 / math.pi)


def enu_to_lon(lat0: Column, lon0: Column, east_m: Column) -> Column:
    squeeze = F.greatest(F.cos(F.radians(lat0)), F.lit(1e-9))
    return lon0 + east_m / (F.lit(EARTH_RADIUS_TRACK_M) * squeeze) * F.lit(180.0 / math.pi)


def fold_degrees(delta: Column) -> Column:
    """Difference of two headings folded to (-180, 180]."""
    folded = F.pmod(delta + 180.0, F.lit(360.0)) - 180.0
    return F.when((folded == -180.0) & (delta > 0), F.lit(180.0)).otherwise(folded)


def hann_weight(offset: Column, size: int, floor: float = 1e-3) -> Column:
    """Hann window value at `offset` of a window of `size` cells, floored."""
    wave = 0.5 - 0.5 * F.cos(F.lit(2.0 * math.pi) * offset / F.lit(size - 1))
    return F.greatest(wave, F.lit(floor))
