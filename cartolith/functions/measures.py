"""Boxes and centroids of geometries as folds over their vertices, on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolith.schema import GEOMETRY_TYPES


def _segments(ring: Column) -> Column:
    """Structs a, b of neighbouring vertices of a run."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _ring_segments(ring: Column) -> Column:
    """The same, with the one from the last vertex to the first."""
    return F.concat(_segments(ring), F.when(F.size(ring) > 0, F.array(F.struct(F.element_at(ring, -1).alias("a"), F.element_at(ring, 1).alias("b")))).otherwise(F.slice(_segments(ring), 1, 0)))


def _inside(p: Column, box: Column) -> Column:
    return (p["x"] >= box["xmin"]) & (p["x"] <= box["xmax"]) & (p["y"] >= box["ymin"]) & (p["y"] <= box["ymax"])


def _crosses(s: Column, box: Column) -> Column:
    """Whether a segment and a box have a point in common: their extents meet, and the box's corners aren't all on one side of it."""
    a, b = s["a"], s["b"]
    meet = (F.least(a["x"], b["x"]) <= box["xmax"]) & (F.greatest(a["x"], b["x"]) >= box["xmin"]) & (F.least(a["y"], b["y"]) <= box["ymax"]) & (F.greatest(a["y"], b["y"]) >= box["ymin"])
    sides = [(b["x"] - a["x"]) * (box[y] - a["y"]) - (b["y"] - a["y"]) * (box[x] - a["x"]) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    return meet & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _holds(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings of a polygon."""

    def over(odd: Column, s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        right = a["x"] + (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) * (b["x"] - a["x"]) > x
        return F.when(spans & F.coalesce(right, F.lit(False)), ~odd).otherwise(odd)

    return F.aggregate(F.flatten(F.transform(rings, _ring_segments)), F.lit(False), over)


def meets_box(kind: Column, parts: Column, box: Column) -> Column:
    """Whether a geometry and a box have a point in common."""
    lines, polygons = kind.isin("LineString", "MultiLineString"), kind.isin("Polygon", "MultiPolygon")
    vertex = F.exists(F.flatten(F.flatten(parts)), lambda p: _inside(p, box))
    edge = F.exists(F.flatten(parts), lambda r: F.exists(_segments(r), lambda s: _crosses(s, box)))
    middle = F.exists(parts, lambda p: _holds(p, (box["xmin"] + box["xmax"]) / 2, (box["ymin"] + box["ymax"]) / 2))
    return F.coalesce(vertex | ((lines | polygons) & edge) | (polygons & middle), F.lit(False))


#: Vertices of a line or ring whose coordinates become columns: as many as a closed rectangle has.
SHORT = 5


def short_run(kind: Column, parts: Column) -> Column:
    """The vertices of a line, or a polygon's ring, if it has ``SHORT`` at most and is the only one; else null."""
    drawn = kind.isin("LineString", "MultiLineString", "Polygon", "MultiPolygon")
    only = F.get(F.get(parts, F.lit(0)), F.lit(0))
    return F.when(drawn & (F.size(parts) == 1) & (F.size(F.get(parts, F.lit(0))) == 1) & (F.size(only) <= SHORT), only)


def places(run: str) -> list[Column]:
    """Its coordinates as columns x0, y0, x1 and so on, null after the end."""
    return [F.get(F.col(run), F.lit(i))[a].alias(f"{a}{i}") for i in range(SHORT) for a in "xy"]


def unsettled(kind: Column, parts: Column, run: Column) -> Column:
    """The parts where these columns may not settle whether a shape meets a box: not those of short lines, nor of single points."""
    return F.when((kind != "Point") & (run.isNull() | kind.isin("Polygon", "MultiPolygon")), parts)


def short_meets_box(box: Column) -> Column:
    """Whether a vertex or an edge of the run in these columns has a point in common with a box. Comparisons alone, compiled as such."""
    v = [{a: F.col(f"{a}{i}") for a in "xy"} for i in range(SHORT)]
    met = _inside(v[0], box)
    for p in v[1:]:
        met = met | _inside(p, box)
    for a, b in zip(v, v[1:]):
        met = met | _crosses({"a": a, "b": b}, box)
    return F.coalesce(met, F.lit(False))


def _sum(items: Column, weight, value) -> Column:
    """w, x, y: sums of weights and of weighted vertices."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(t: Column, i: Column) -> Column:
        w, (x, y) = weight(i), value(i)
        return F.struct((t["w"] + w).alias("w"), (t["x"] + x * w).alias("x"), (t["y"] + y * w).alias("y"))

    return F.aggregate(items, zero, add)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value evaluated once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mean(total: Column) -> Column:
    return let(total, lambda t: F.when(t["w"] != 0, F.struct((t["x"] / t["w"]).alias("x"), (t["y"] / t["w"]).alias("y"))))


def _polygon_sum(rings: Column, origin: Column) -> Column:
    """Signed area and its moments: the first ring counts, the others are taken away, however they wind."""

    def cross(s: Column) -> Column:
        return (s["a"]["x"] - origin["x"]) * (s["b"]["y"] - origin["y"]) - (s["b"]["x"] - origin["x"]) * (s["a"]["y"] - origin["y"])

    def ring(r: Column, i: Column) -> Column:
        t = _sum(_ring_segments(r), lambda s: cross(s) / 2, lambda s: ((s["a"]["x"] + s["b"]["x"] - 2 * origin["x"]) / 3, (s["a"]["y"] + s["b"]["y"] - 2 * origin["y"]) / 3))
        sign = F.signum(t["w"]) * F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        return F.struct((t["w"] * sign).alias("w"), (t["x"] * sign).alias("x"), (t["y"] * sign).alias("y"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(F.transform(rings, ring), zero, lambda t, r: F.struct(*((t[n] + r[n]).alias(n) for n in "wxy")))


def centroid(kind: Column, parts: Column) -> Column:
    """Mean of points, length-weighted middle of lines, area centroid of polygons; of lesser dimension where that is nil."""
    points = F.flatten(F.flatten(parts))
    origin = F.get(points, F.lit(0))
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    area = _mean(F.aggregate(F.transform(parts, lambda p: _polygon_sum(p, origin)), zero, lambda t, r: F.struct(*((t[n] + r[n]).alias(n) for n in "wxy"))))
    area = let(area, lambda a: F.when(a.isNotNull(), F.struct((a["x"] + origin["x"]).alias("x"), (a["y"] + origin["y"]).alias("y"))))

    def length(s: Column) -> Column:
        return F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])

    line = _mean(_sum(F.flatten(F.transform(F.flatten(parts), _segments)), length, lambda s: ((s["a"]["x"] + s["b"]["x"]) / 2, (s["a"]["y"] + s["b"]["y"]) / 2)))
    mean = _mean(_sum(points, lambda p: F.lit(1.0), lambda p: (p["x"], p["y"])))
    found = F.when(kind.isin("Polygon", "MultiPolygon"), F.coalesce(area, line, mean)).when(kind.isin("LineString", "MultiLineString"), F.coalesce(line, mean)).otherwise(mean)
    return F.when(kind.isin(*GEOMETRY_TYPES) & (F.size(points) > 0), F.when(kind == "Point", F.struct(origin["x"].alias("x"), origin["y"].alias("y"))).otherwise(found))
