"""The one schema of features: a row for each feature, tile coordinates as columns, properties as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYER_PROPERTY = "vt_layer"
GEOMETRY_TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")

PARTS = "array<array<array<struct<x:double,y:double>>>>"
BBOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
#: What readers give; ``properties`` is parsed from ``props_json`` on the JVM, and only where it is asked for.
RAW = (
    "source string, origin string, z int, x int, y int, srid int, layer string, layer_version int, layer_extent int, ordinal bigint, "
    f"fid decimal(20,0), fid_text string, geom_type string, parts {PARTS}, bbox {BBOX}, props_json string"
)


def raw_type() -> T.StructType:
    return T.StructType.fromDDL(RAW)


def surrogate_id(source: Column, layer: Column, ordinal: Column) -> Column:
    """The text id of a feature without one: the same in every run."""
    return F.sha2(F.concat_ws("|", source, layer, ordinal.cast("string")), 256)


def bbox_of(parts: Column) -> Column:
    """Struct of the extremes of all vertices; null for no vertex."""
    points = F.flatten(F.flatten(parts))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
    return F.when(F.size(points) > 0, box)


def with_properties(raw: DataFrame) -> DataFrame:
    return raw.withColumn("properties", F.try_parse_json("props_json"))


def features(df: DataFrame, **columns: Column | str | int | None) -> DataFrame:
    """Fills a DataFrame up to the canonical schema: given columns (name=expression), else its own of that name, else null."""
    out = []
    for f in raw_type().fields:
        value = columns.get(f.name, df[f.name] if f.name in df.columns else None)
        value = value if isinstance(value, Column) else F.lit(value)
        out.append(value.cast(f.dataType).alias(f.name))
    properties = columns.get("properties")
    done = df.select(*out, *([properties.alias("properties")] if properties is not None else []))
    return done if properties is not None else with_properties(done)


def point_parts(x: Column, y: Column) -> Column:
    return F.array(F.array(F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))))
