"""Projections, tiles and boxes as column expressions: spherical Mercator and the usual tile pyramid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
HALF = math.pi * RADIUS
WORLD = 2 * HALF
EARTH = 6371008.8  # mean radius, for distances
EXTENT = 4096
TILE_PIXELS = 256
MOST_LAT = 85.0511287798066  # where the square of the projection ends


def col(x: Column | str | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * RADIUS


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def lon_of(x: Column) -> Column:
    return F.degrees(x / RADIUS)


def lat_of(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y / RADIUS)))


def tile_width(z: Column | int) -> Column:
    return F.lit(WORLD) / F.pow(F.lit(2.0), col(z))


def tile_bounds(z: Column | int, x: Column | int, y: Column | int) -> Column:
    """xmin, ymin, xmax, ymax in metres."""
    u = tile_width(z)
    xmin, ymax = F.lit(-HALF) + col(x) * u, F.lit(HALF) - col(y) * u
    return F.struct(xmin.alias("xmin"), (ymax - u).alias("ymin"), (xmin + u).alias("xmax"), ymax.alias("ymax"))


def tile_of_east(east: Column, z: Column | int) -> Column:
    """The column of tiles so many degrees east of the antimeridian."""
    return F.floor(east / 360 * F.pow(F.lit(2.0), col(z))).cast("int")


def tile_x(lon: Column, z: Column | int) -> Column:
    return tile_of_east(lon + 180, z)


def tile_y(lat: Column, z: Column | int) -> Column:
    return F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * F.pow(F.lit(2.0), col(z))).cast("int")


def valid_tile(z: Column, x: Column, y: Column) -> Column:
    side = F.pow(F.lit(2.0), z)
    return (z >= 0) & (x >= 0) & (y >= 0) & (x < side) & (y < side)


def tile_to_mercator_x(px: Column, z: Column | int, x: Column | int, extent: Column | int = EXTENT) -> Column:
    return F.lit(-HALF) + (col(x) + px / col(extent)) * tile_width(z)


def tile_to_mercator_y(py: Column, z: Column | int, y: Column | int, extent: Column | int = EXTENT) -> Column:
    return F.lit(HALF) - (col(y) + py / col(extent)) * tile_width(z)


def quantize_x(mx: Column, z: Column | int, x: Column | int, extent: int = EXTENT) -> Column:
    """Metres to whole tile units, towards zero."""
    return (((mx + HALF) / tile_width(z) - col(x)) * extent).cast("bigint")


def quantize_y(my: Column, z: Column | int, y: Column | int, extent: int = EXTENT) -> Column:
    return (((F.lit(HALF) - my) / tile_width(z) - col(y)) * extent).cast("bigint")


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 31))


def unzigzag(n: Column) -> Column:
    return F.shiftright(n, 1).bitwiseXOR(-(n.bitwiseAND(1)))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * radius)


def box(xmin: Column | float, ymin: Column | float, xmax: Column | float, ymax: Column | float) -> Column:
    return F.struct(col(xmin).alias("xmin"), col(ymin).alias("ymin"), col(xmax).alias("xmax"), col(ymax).alias("ymax"))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])


def box_union(a: Column, b: Column) -> Column:
    return box(F.least(a["xmin"], b["xmin"]), F.least(a["ymin"], b["ymin"]), F.greatest(a["xmax"], b["xmax"]), F.greatest(a["ymax"], b["ymax"]))


def box_expanded(a: Column, by: Column | float) -> Column:
    return box(a["xmin"] - by, a["ymin"] - by, a["xmax"] + by, a["ymax"] + by)


def box_clamped(a: Column, b: Column) -> Column:
    return box(F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"]), F.least(a["xmax"], b["xmax"]), F.least(a["ymax"], b["ymax"]))


def point_box(x: float, y: float, tolerance: float, srid: int) -> tuple[float, float, float, float]:
    """The square around a point: metres for 3857 and 4326 (there by cos(lat)), tile units for 0; clamped to the world."""
    t = abs(tolerance)
    if srid == 4326:
        dy = math.degrees(t / RADIUS)
        dx = dy / max(math.cos(math.radians(y)), 1e-12)
        return max(x - dx, -180.0), max(y - dy, -90.0), min(x + dx, 180.0), min(y + dy, 90.0)
    if srid == 3857:
        return max(x - t, -HALF), max(y - t, -HALF), min(x + t, HALF), min(y + t, HALF)
    return x - t, y - t, x + t, y + t


def minimal_tile(xmin: float, ymin: float, xmax: float, ymax: float, max_zoom: int = 14) -> tuple[int, int, int]:
    """The deepest tile, ``max_zoom`` at most, that holds a box of degrees."""
    for z in range(max_zoom, 0, -1):
        tiles = [tile_at(x, y, z) for x, y in ((xmin, ymax), (xmax, ymin))]
        if tiles[0] == tiles[1]:
            return z, *tiles[0]
    return 0, 0, 0


def least_tile(xmin: Column, ymin: Column, xmax: Column | None, ymax: Column, max_zoom: int = 14, width: Column | float | None = None) -> Column:
    """The same as a column: struct z, x, y. A box given by its ``width`` has its east edge counted from the antimeridian in one addition, as the sum
    xmin + width, rounded before 180 is added, can come to lie on a tile's edge that the box ends short of."""

    def at(east: Column, lat: Column, z: Column) -> tuple[Column, Column]:
        side = F.pow(F.lit(2.0), z).cast("int")
        lat = F.greatest(F.least(lat, F.lit(MOST_LAT)), F.lit(-MOST_LAT))
        return tuple(F.greatest(F.least(v, side - 1), F.lit(0)) for v in (tile_of_east(east, z), tile_y(lat, z)))

    ends = xmax + 180 if width is None else xmin + (180 + col(width))

    def tile(z: Column) -> Column:
        (x, y), (right, low) = at(xmin + 180, ymax, z), at(ends, ymin, z)
        return F.when((x == right) & (y == low), F.struct(z.alias("z"), x.alias("x"), y.alias("y")))

    zooms = F.array(*map(F.lit, range(max_zoom, -1, -1)))
    return F.get(F.array_compact(F.transform(zooms, tile)), F.lit(0))


def tile_at(lon: float, lat: float, z: int) -> tuple[int, int]:
    n = 1 << z
    lat = max(min(lat, MOST_LAT), -MOST_LAT)
    x = math.floor((lon + 180) / 360 * n)
    y = math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)
    return min(max(x, 0), n - 1), min(max(y, 0), n - 1)


def bounds_of_tile(z: int, x: int, y: int, srid: int) -> tuple[float, float, float, float]:
    """Of a valid tile; always 0..4096 without a projection."""
    if not (z >= 0 and 0 <= x < 1 << z and 0 <= y < 1 << z):
        raise ValueError(f"no tile {z}/{x}/{y}")
    if srid == 0:
        return 0.0, 0.0, float(EXTENT), float(EXTENT)
    u = WORLD / (1 << z)
    box3857 = (-HALF + x * u, HALF - (y + 1) * u, -HALF + (x + 1) * u, HALF - y * u)
    if srid == 3857:
        return box3857
    return unproject(*box3857[:2]) + unproject(*box3857[2:])


def project(lon: float, lat: float) -> tuple[float, float]:
    return math.radians(lon) * RADIUS, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * RADIUS


def unproject(x: float, y: float) -> tuple[float, float]:
    return math.degrees(x / RADIUS), math.degrees(math.atan(math.sinh(y / RADIUS)))
