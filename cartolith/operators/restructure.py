"""Tiles as DataFrames: layers set, added to, removed, extracted; tiles merged; features routed to layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith import schema
from cartolith.functions import geo


def features_of(tile: DataFrame, layer: str) -> DataFrame:
    return tile.where(F.col("layer") == layer)


def reprojected(features: DataFrame, srid: int) -> DataFrame:
    """Vertices and boxes between degrees and metres, on the JVM; rows without a projection stay."""

    def moved(fx, fy) -> Column:
        def vertex(p: Column) -> Column:
            return F.struct(fx(p["x"]).alias("x"), fy(p["y"]).alias("y"))

        return F.transform("parts", lambda a: F.transform(a, lambda b: F.transform(b, vertex)))

    to_metres = moved(geo.mercator_x, geo.mercator_y)
    to_degrees = moved(geo.lon_of, geo.lat_of)
    change = ((F.col("srid") == 4326) & F.lit(srid == 3857)) | ((F.col("srid") == 3857) & F.lit(srid == 4326))
    parts = F.when(change, to_metres if srid == 3857 else to_degrees).otherwise(F.col("parts")) if srid else F.col("parts")
    out = features.withColumn("_new", parts).withColumn("bbox", F.when(change, schema.bbox_of(F.col("_new"))).otherwise(F.col("bbox")))
    return out.withColumn("parts", F.col("_new")).withColumn("srid", F.when(change, F.lit(srid)).otherwise(F.col("srid"))).drop("_new").select(*features.columns)


def completed(features: DataFrame, layer: str | None = None) -> DataFrame:
    """Missing boxes and ids filled in."""
    name = F.lit(layer) if layer is not None else F.col("layer")
    own = features.withColumn("layer", name).withColumn("bbox", F.coalesce("bbox", schema.bbox_of(F.col("parts"))))
    text = F.coalesce("fid_text", F.col("fid").cast("string"), schema.surrogate_id(F.coalesce("source", F.lit("")), F.col("layer"), F.coalesce("ordinal", F.xxhash64("props_json", "parts"))))
    return own.withColumn("fid_text", text).select(*features.columns)


def set_layer(tile: DataFrame, layer: str, features: DataFrame, srid: int | None = None) -> DataFrame:
    new = completed(features if srid is None else reprojected(features, srid), layer)
    return tile.where(~F.col("layer").eqNullSafe(layer)).unionByName(new, allowMissingColumns=True)


def append_layer(tile: DataFrame, layer: str, features: DataFrame, srid: int | None = None) -> DataFrame:
    """New features come after the layer's own: their ordinals go on from its largest, one number found by an aggregate."""
    new = completed(features if srid is None else reprojected(features, srid), layer)
    last = features_of(tile, layer).agg(F.max("ordinal")).first()[0]
    return tile.unionByName(new.withColumn("ordinal", F.col("ordinal") + F.lit(0 if last is None else last + 1)), allowMissingColumns=True)


def remove_features(tile: DataFrame, layer: str, which: Column) -> DataFrame:
    return tile.where(~((F.col("layer") == layer) & F.coalesce(which, F.lit(False))))


def remove_layer(tile: DataFrame, layer: str) -> tuple[DataFrame, DataFrame]:
    """(the tile without it, the features that went)."""
    return tile.where(~F.col("layer").eqNullSafe(layer)), features_of(tile, layer)


def extract(tile: DataFrame, layers: list[str]) -> DataFrame:
    return tile.where(F.col("layer").isin(layers))


def clear(tile: DataFrame) -> DataFrame:
    return tile.limit(0)


def merge(*parts: DataFrame, ignore_tile: bool = False, srid: int | None = None) -> DataFrame:
    """All rows of all tiles, doubles included. Unless ignored, all must be of one tile: its coordinates are compared by an aggregate."""
    own = [p if srid is None else reprojected(p, srid) for p in parts]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)
    if not ignore_tile and out.select("z", "x", "y").distinct().limit(2).count() > 1:
        raise ValueError("tiles with different coordinates")
    return out


def routed(features: DataFrame, layer_property: str | None = schema.LAYER_PROPERTY, layer_name: str | None = None, default: str = "Layer-0", allowed: list[str] | None = None) -> DataFrame:
    """The layer from a text property, which goes, else the name given, else the default; then the allow-list."""
    if not layer_property:
        out = features.withColumn("layer", F.lit(layer_name or default))
    else:
        bag = F.col("properties")
        named = F.try_variant_get(bag, f'$["{layer_property}"]', "variant")
        text = F.when(F.schema_of_variant(named) == "STRING", F.try_variant_get(named, "$", "string"))
        values = F.transform_values(bag.try_cast("map<string,variant>"), lambda k, v: F.to_json(v))
        rest = F.map_entries(F.map_filter(values, lambda k, v: k != layer_property))
        key = F.transform(rest, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"]))
        stripped = F.concat(F.lit("{"), F.array_join(key, ","), F.lit("}"))
        out = features.withColumn("_layer", text).withColumn("props_json", F.when(F.col("_layer").isNotNull(), stripped).otherwise(F.col("props_json")))
        out = schema.with_properties(out.withColumn("layer", F.coalesce("_layer", F.lit(layer_name or default))).drop("_layer", "properties"))
    return out if allowed is None else out.where(F.col("layer").isin(allowed))


def add_geojson(tile: DataFrame, features: DataFrame, replace: bool = False, **routing) -> DataFrame:
    """Adds routed features, or replaces the layers they go to."""
    new = completed(routed(features, **routing))
    if replace:
        tile = tile.join(new.select("layer").distinct(), "layer", "left_anti").select(*tile.columns)
    return tile.unionByName(new, allowMissingColumns=True)


def with_properties(features: DataFrame, extra: dict[str, object]) -> DataFrame:
    """Adds properties; a feature's own value of the same name wins."""
    import json

    added = F.from_json(F.lit(json.dumps({k: json.dumps(v) for k, v in extra.items()})), "map<string,string>")
    own = F.coalesce(F.transform_values(F.col("properties").try_cast("map<string,variant>"), lambda k, v: F.to_json(v)), F.create_map().cast("map<string,string>"))
    both = F.map_concat(F.map_filter(added, lambda k, v: ~F.map_contains_key(own, k)), own)
    text = F.array_join(F.transform(F.map_entries(both), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])), ",")
    return schema.with_properties(features.withColumn("props_json", F.concat(F.lit("{"), text, F.lit("}"))).drop("properties"))


def allowed_layers(allow: list[str] | None, deny: list[str] | None) -> tuple[set[str] | None, set[str] | None]:
    """Allow-list without the denied and deny-list without the allowed; empty is None."""
    a, d = set(allow or ()), set(deny or ())
    return (a - d) or None, (d - a) or None


def choose_layers(features: DataFrame, allow: list[str] | None, deny: list[str] | None) -> DataFrame:
    """A list that leaves nothing leaves nothing."""
    a, d = allowed_layers(allow, deny)
    if a is not None:
        features = features.where(F.col("layer").isin(*a))
    elif allow:
        return features.limit(0)
    return features if d is None else features.where(~F.col("layer").isin(*d))
