"""Selection: by predicate, by box, around a point, and around many points at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import geo, measures
from cartolith.plans.compile import compile_program
from cartolith.plans.program import Near, Node, parse_or_search


def with_centroid(features: DataFrame, name: str = "centroid") -> DataFrame:
    """Struct x, y in degrees, on the JVM."""
    own = measures.centroid(F.col("geom_type"), F.col("parts"))

    def degrees(c: Column) -> Column:
        fit = F.when(F.col("srid") == 4326, c).when(F.col("srid") == 3857, F.struct(geo.lon_of(c["x"]).alias("x"), geo.lat_of(c["y"]).alias("y")))
        return F.when(c["x"].isNotNull(), fit)

    return features.withColumn(name, measures.let(own, degrees))


def query(features: DataFrame, text: str | list[Node], layer: str | None = None, keep: Column | None = None, strict: bool = False) -> DataFrame:
    """Rows for which the predicate holds; ``layer`` narrows it, ``keep`` is any further condition. Centroids are only made for ``near``."""
    program = parse_or_search(text, strict) if isinstance(text, str) else text
    out = features if layer is None else features.where(F.col("layer") == layer)
    if any(isinstance(n, Near) for n in program):
        out = with_centroid(out, "_centroid")
        out = out.where(compile_program(program, "properties", "_centroid")).drop("_centroid")
    else:
        out = out.where(compile_program(program))
    return out if keep is None else out.where(keep)


def overlaps(box: tuple[float, float, float, float]) -> Column:
    """Of boxes: comparisons of plain fields, which reach a Parquet scan."""
    xmin, ymin, xmax, ymax = box
    return (F.col("bbox.xmin") <= xmax) & (F.col("bbox.xmax") >= xmin) & (F.col("bbox.ymin") <= ymax) & (F.col("bbox.ymax") >= ymin)


def _exact(box: Column) -> Column:
    """Geometry against box, on the JVM; points are settled by their own box."""
    return (F.col("geom_type") == "Point") | measures.meets_box(F.col("geom_type"), F.col("parts"), box)


def in_box(features: DataFrame, box: tuple[float, float, float, float], layer: str | None = None, keep: Column | None = None) -> DataFrame:
    """Features that have a point in common with the box."""
    out = features if layer is None else features.where(F.col("layer") == layer)
    out = out.where(overlaps(box))
    lines = out.where(_exact(geo.box(*map(F.lit, box))))
    return lines if keep is None else lines.where(keep)


def around(features: DataFrame, x: float, y: float, tolerance: float, srid: int = 4326, layer: str | None = None, keep: Column | None = None) -> DataFrame:
    """Features that meet the square around a point: metres for 4326 and 3857, tile units for 0."""
    return in_box(features.where(F.col("srid") == srid), geo.point_box(x, y, tolerance, srid), layer, keep)


LEVELS = 40


def cells(box: Column, size: Column | float) -> Column:
    """Grid cells that a box touches, as an array of structs."""
    span = [F.sequence(F.floor(box[f"{a}min"] / size).cast("long"), F.floor(box[f"{a}max"] / size).cast("long")) for a in "xy"]
    return F.flatten(F.transform(span[0], lambda i: F.transform(span[1], lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def level_of(box: Column, size: float) -> Column:
    """The least level whose cells, ``size`` wide at level 0 and doubled from level to level, are as large as the box."""
    side = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    return F.least(F.greatest(F.ceil(F.log2(side / size)).cast("int"), F.lit(0)), F.lit(LEVELS))


_SIDES = "xmin", "ymin", "xmax", "ymax"


def _box_of(name: str) -> dict[str, Column]:
    """A box held in plain columns, which cost less to read for each pair of rows than a struct's fields."""
    return {n: F.col(f"{name}_{n}") for n in _SIDES}


def _plain(rows: DataFrame, box: str, *others: Column | str) -> DataFrame:
    return rows.select(*others, *(F.col(f"{box}.{n}").alias(f"{box}_{n}") for n in _SIDES))


def _in_cells(rows: DataFrame, box: str, size: float) -> DataFrame:
    """A row for each cell, cx and cy, of the row's grid that its box touches, and the cells' width."""
    b, width = _box_of(box), F.col("width")
    out = rows.withColumn("width", F.lit(size) * F.pow(F.lit(2.0), F.col("grid")))
    for a in "xy":
        out = out.withColumn(f"c{a}", F.explode(F.sequence(F.floor(b[f"{a}min"] / width).cast("long"), F.floor(b[f"{a}max"] / width).cast("long"))))
    return out


def around_many(features: DataFrame, points: DataFrame, tolerance: float, srid: int = 4326, include_duplicates: bool = True, keep: Column | None = None, cell: float | None = None) -> DataFrame:
    """point_idx, layer, fid_text of features near points (point_idx, px, py): an equi-join on grid cells, then boxes, then
    shapes. The least cells are four tolerances wide and double from level to level. A feature is in the cells of the level of its own
    size, four at most, and a point's square in those of every level that the extent of the projection has, so neither a large feature nor
    a small tolerance multiplies rows. Shapes of a few vertices are settled by plain columns, others by folds over their parts. A pair found in several cells counts once, in the cell of the corner where the two
    boxes' overlap begins. Cells with very many rows are split by AQE.

    Without duplicates each feature is reported only at its first point; features are told apart by layer and id."""
    t = abs(tolerance)
    if srid == 4326:
        dy = t / geo.RADIUS * 180 / 3.141592653589793
        dx = F.lit(dy) / F.greatest(F.cos(F.radians("py")), F.lit(1e-12))
        square = geo.box(F.greatest(F.col("px") - dx, F.lit(-180.0)), F.greatest(F.col("py") - dy, F.lit(-90.0)), F.least(F.col("px") + dx, F.lit(180.0)), F.least(F.col("py") + dy, F.lit(90.0)))
    else:
        dy = t
        square = geo.box(F.col("px") - t, F.col("py") - t, F.col("px") + t, F.col("py") + t)
    size = cell or max(4 * dy, 1e-9)
    extent = {4326: 360.0, 3857: geo.WORLD}.get(srid)
    levels = LEVELS if extent is None else min(LEVELS, max(0, math.ceil(math.log2(extent / size))) + 1)
    # Near the poles a square of degrees is wide: its cells are those of its own level at least.
    asked = points.select("point_idx", square.alias("square")).withColumn("own", F.least(level_of(F.col("square"), size), F.lit(levels)))
    asked = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("grid", F.greatest("level", "own"))
    asked = _in_cells(_plain(asked, "square", "point_idx", "level", "grid"), "square", size)
    rows = features.where((F.col("srid") == srid) & F.col("bbox").isNotNull())
    rows = (rows if keep is None else rows.where(keep)).select("layer", "fid_text", "ordinal", "geom_type", "parts", "bbox")
    rows = rows.withColumn("level", F.least(level_of(F.col("bbox"), size), F.lit(levels))).withColumn("short", measures.short_run(F.col("geom_type"), F.col("parts")))
    left = measures.unsettled(F.col("geom_type"), F.col("parts"), F.col("short")).alias("parts")
    rows = _plain(rows, "bbox", "layer", "fid_text", "ordinal", "geom_type", "level", left, *measures.places("short"))
    wide = asked.where("grid > level").groupBy("level").agg(F.collect_set("grid").alias("wide"))  # a row for each level at most
    rows = rows.join(F.broadcast(wide), "level", "left").withColumn("grid", F.explode(F.concat(F.array("level"), F.coalesce("wide", F.array().cast("array<int>"))))).drop("wide")
    rows = _in_cells(rows, "bbox", size)
    square, box = _box_of("square"), _box_of("bbox")
    # Both sides are shuffled: the pairs of a cell are the work, and where one side is broadcast, files of the other are too few tasks for them.
    both = asked.drop("width").hint("merge").join(rows, ["level", "grid", "cx", "cy"]).where(geo.boxes_meet(square, box))
    for a in "xy":
        both = both.where(F.col(f"c{a}") == F.floor(F.greatest(square[f"{a}min"], box[f"{a}min"]) / F.col("width")).cast("long"))
    exact = (F.col("geom_type") == "Point") | measures.short_meets_box(square) | (F.col("parts").isNotNull() & measures.meets_box(F.col("geom_type"), F.col("parts"), square))
    # Shapes are judged after the join, as the number that is made there can't be pushed into it: folds would keep the join from being compiled.
    hits = both.withColumn("pair", F.monotonically_increasing_id()).where((F.col("pair") >= 0) & exact).select("point_idx", "layer", "fid_text", "ordinal")
    if not include_duplicates:
        first = Window.partitionBy("layer", "fid_text").orderBy("point_idx", "ordinal")
        hits = hits.withColumn("n", F.row_number().over(first)).where("n = 1")
    return hits.select("point_idx", "layer", "fid_text")


def hilbert(x: Column, y: Column, order: int = 16) -> Column:
    """Place on the Hilbert curve of longitudes and latitudes, as a fold over bits on the JVM."""
    side = (1 << order) - 1
    zero = F.lit(0).cast("long")
    start = F.struct(F.least(F.greatest(((x + 180) / 360 * side).cast("long"), zero), F.lit(side).cast("long")).alias("x"), F.least(F.greatest(((y + 90) / 180 * side).cast("long"), zero), F.lit(side).cast("long")).alias("y"), zero.alias("d"))
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(order - 1, -1, -1)])

    def step(a: Column, s: Column) -> Column:
        rx, ry = (a["x"].bitwiseAND(s) > 0).cast("long"), (a["y"].bitwiseAND(s) > 0).cast("long")
        d = a["d"] + s * s * ((rx * 3).bitwiseXOR(ry))
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, F.lit(side) - a["x"]).otherwise(a["x"]), F.when(flip, F.lit(side) - a["y"]).otherwise(a["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(bits, start, step, lambda a: a["d"])


def clustered(features: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in the order of the Hilbert curve, so that Parquet statistics let box queries skip most row groups."""
    key = hilbert((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2, (F.col("bbox.ymin") + F.col("bbox.ymax")) / 2)
    keyed = features.withColumn("_h", key)
    keyed = keyed.repartitionByRange(partitions, "_h") if partitions else keyed.repartitionByRange("_h")
    return keyed.sortWithinPartitions("_h").drop("_h")
