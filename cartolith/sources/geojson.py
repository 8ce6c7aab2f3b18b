"""GeoJSON as a source and sink.

Files are read by Spark as whole texts; documents are parsed on the JVM as VARIANT and exploded to features there. Only
the coordinates' nesting is evened out in one Arrow pass. Writing turns features to JSON on the JVM; a document's envelope is
put around the lines of a partition, so a single document is a single task's work and only made when asked for.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith import schema
from cartolith.functions import geo, shapes
from cartolith.sources import mvt, tiles

DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def to_parts(kind: str, coordinates: list) -> list:
    """Coordinates of any type in the one nesting of polygons, rings and vertices."""

    def vertex(p: list) -> dict:
        return {"x": float(p[0]), "y": float(p[1])}

    if kind == "Point":
        return [[[vertex(coordinates)]]] if coordinates else []
    if kind == "MultiPoint":
        return [[[vertex(p)]] for p in coordinates]
    if kind == "LineString":
        return [[[vertex(p) for p in coordinates]]]
    if kind == "MultiLineString":
        return [[[vertex(p) for p in line]] for line in coordinates]
    if kind == "Polygon":
        return [[[vertex(p) for p in ring] for ring in coordinates]]
    return [[[vertex(p) for p in ring] for ring in polygon] for polygon in coordinates]


def coordinates_of(kind: Column, parts: Column) -> Column:
    """The GeoJSON coordinates as JSON text."""

    def pair(p: Column) -> Column:
        return F.array(p["x"], p["y"])

    def ring(r: Column) -> Column:
        return F.transform(r, pair)

    first = F.get(F.get(parts, F.lit(0)), F.lit(0))
    points = F.to_json(pair(F.get(first, F.lit(0))))
    return (
        F.when(kind == "Point", points)
        .when(kind == "MultiPoint", F.to_json(F.transform(F.flatten(F.flatten(parts)), pair)))
        .when(kind == "LineString", F.to_json(ring(first)))
        .when(kind == "MultiLineString", F.to_json(F.transform(F.flatten(parts), ring)))
        .when(kind == "Polygon", F.to_json(F.transform(F.get(parts, F.lit(0)), ring)))
        .when(kind == "MultiPolygon", F.to_json(F.transform(parts, lambda p: F.transform(p, ring))))
    )


def flattened(texts: DataFrame) -> DataFrame:
    """source, ordinal, feature (variant) of rows (source, text): the features of collections, features, and bare geometries."""
    doc = texts.select("source", F.try_parse_json("text").alias("doc")).where("doc is not null")
    doc = doc.withColumn("type", F.try_variant_get("doc", "$.type", "string"))
    nested = F.try_variant_get("doc", "$.features", "array<variant>")
    single = F.when(F.col("type") == "Feature", F.array("doc")).otherwise(F.array(F.parse_json(F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.to_json("doc"), F.lit("}")))))
    each = doc.select("source", F.posexplode(F.when(F.col("type") == "FeatureCollection", nested).otherwise(single)).alias("ordinal", "feature"))
    return each.select("source", F.col("ordinal").cast("long").alias("ordinal"), "feature")


def decode(texts: DataFrame, layer_property: str | None = schema.LAYER_PROPERTY, layer_name: str | None = None, layers: list[str] | None = None) -> DataFrame:
    """Features of rows (source, text), always in degrees. The layer is the text in the layer property, which goes, else
    ``layer_name``, else ``Layer-0``. Altitudes and measures are dropped, geometry collections keep type and no parts."""
    each = flattened(texts)
    each = each.select(
        "source", "ordinal",
        F.coalesce(F.to_json(F.try_variant_get("feature", "$.properties", "variant")), F.lit("{}")).alias("props"),
        F.to_json(F.try_variant_get("feature", "$.geometry", "variant")).alias("geometry"),
        F.to_json(F.try_variant_get("feature", "$.id", "variant")).alias("id"),
    )
    wanted = None if layers is None else set(layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                props = json.loads(row["props"]) or {}
                layer = props.get(layer_property) if layer_property else None
                layer = layer if isinstance(layer, str) else None
                if layer is not None:
                    del props[layer_property]
                layer = layer or layer_name or "Layer-0"
                if wanted is not None and layer not in wanted:
                    continue
                geometry = json.loads(row["geometry"]) if row["geometry"] else None
                kind = (geometry or {}).get("type")
                parts = to_parts(kind, geometry.get("coordinates") or []) if kind in DEPTH else []
                fid = json.loads(row["id"]) if row["id"] else None
                whole = isinstance(fid, int) and not isinstance(fid, bool) and 0 <= fid < 1 << 64
                text = tiles.hashlib.sha256(f"{row['source']}|{layer}|{row['ordinal']}".encode()).hexdigest() if fid is None else str(fid)
                out.append({
                    "source": row["source"], "origin": "geoJson", "srid": 4326, "layer": layer, "ordinal": row["ordinal"], "fid": tiles.Decimal(fid) if whole else None, "fid_text": text,
                    "geom_type": kind, "parts": parts, "bbox": tiles.as_box(tiles.from_parts(parts)), "props_json": tiles.json_text(props),
                })
            yield from mvt._batches(iter(out), mvt.ARROW)

    return schema.with_properties(each.mapInArrow(run, schema.raw_type()))


def read(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    return decode(mvt.files(spark, paths).select(F.col("path").alias("source"), _text(F.col("content")).alias("text")), **options)


ZIPPED = bytes.fromhex("1f8b")


def _text(content: Column) -> Column:
    """UTF-8 text, unzipped; only gzipped bytes travel to Python. Bytes that aren't UTF-8 become U+FFFD."""

    @F.pandas_udf("binary")
    def unzipped(data):
        return data.map(lambda b: None if b is None else tiles.unzipped(bytes(b)))

    zipped = F.substring(content, 1, 2) == F.lit(ZIPPED)
    whole = F.coalesce(unzipped(F.when(zipped, content)), content)
    return F.regexp_replace(F.make_valid_utf8(whole.cast("string")), "^\ufeff", "")


def _begins_as_json(text: Column) -> Column:
    """Whether the first letter that isn't white space is a brace or a bracket."""
    return F.coalesce(F.substring(text, 1, 512).rlike(r"^[\s\ufeff]*[{\[]"), F.lit(False))


def with_tile(features: DataFrame, max_zoom: int = 14) -> DataFrame:
    """z, x, y of the least tile around all features of each source. One box for each source reaches the join."""
    boxes = features.where("bbox is not null").groupBy("source").agg(*(F.min(f"bbox.{n}").alias(n) for n in ("xmin", "ymin")), *(F.max(f"bbox.{n}").alias(n) for n in ("xmax", "ymax")))
    at = geo.least_tile(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), max_zoom)
    at = boxes.select("source", at.alias("t")).select("source", *(F.col(f"t.{n}").alias(f"_{n}") for n in "zxy"))
    out = features.join(at, "source")
    return out.withColumns({n: F.col(f"_{n}") for n in "zxy"}).drop("_z", "_x", "_y").select(*features.columns)


def lines(features: DataFrame, layer_property: str | None = schema.LAYER_PROPERTY, extra: dict | None = None) -> DataFrame:
    """layer, ordinal, json: a Feature in each row. ``extra`` properties are added where the feature has none of that name."""
    bag = F.map_concat(
        F.map_filter(
            F.coalesce(F.from_json(F.lit(json.dumps({k: json.dumps(v) for k, v in (extra or {}).items()})), "map<string,string>"), F.create_map().cast("map<string,string>")),
            lambda k, v: ~F.coalesce(F.map_contains_key(own_text(), k), F.lit(False)),
        ),
        F.coalesce(own_text(), F.create_map().cast("map<string,string>")),
    )
    if layer_property:
        bag = F.map_concat(F.map_filter(bag, lambda k, v: k != layer_property), F.create_map(F.lit(layer_property), F.to_json(F.array("layer")).substr(F.lit(2), F.length(F.to_json(F.array("layer"))) - 2)))
    members = F.array_join(F.transform(F.map_entries(bag), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])), ",")
    fid = F.coalesce(F.col("fid").cast("string"), _quoted(F.col("fid_text")))
    geometry = F.when(F.col("geom_type").isin(*schema.GEOMETRY_TYPES), F.concat(F.lit('{"type":"'), F.col("geom_type"), F.lit('","coordinates":'), coordinates_of(F.col("geom_type"), F.col("parts")), F.lit("}")))
    text = F.concat(F.lit('{"type":"Feature","id":'), F.coalesce(fid, F.lit("null")), F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":{'), members, F.lit("}}"))
    return features.select("layer", "ordinal", text.alias("json"))


def own_text() -> Column:
    """Top-level properties as JSON texts by key."""
    return F.transform_values(F.expr("try_cast(properties as map<string,variant>)"), lambda k, v: F.coalesce(F.to_json(v), F.lit("null")))


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return whole.substr(F.lit(2), F.length(whole) - 2)


def prepared(features: DataFrame, options: tiles.ExportOptions = tiles.ExportOptions(), layers: list[str] | None = None) -> DataFrame:
    """Features as they are exported: of the layers (None: all), clipped only if there is a buffer, simplified if asked."""
    if layers is not None:
        features = features.where(F.col("layer").isin(layers))
    if not options.buffer and not options.simplify_extents and not options.simplify_meters:
        return features
    own = [c for c in features.columns if c != "properties"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                kind, parts, srid = row["geom_type"], tiles.from_parts(row["parts"]), row["srid"] or 0
                if kind not in DEPTH:
                    out.append(row)
                    continue
                if options.buffer and row["z"] is not None and srid:
                    got = tiles.clipped(kind, parts, row["z"], row["x"], row["y"], srid, options.buffer)
                    if got is None:
                        continue
                    kind, parts = got
                parts = shapes.simplify(kind, parts, options.tolerance(row["z"] or 0), (lambda r: tiles.metres(r, srid)) if srid else None)
                out.append({**row, "geom_type": kind, "parts": tiles.as_parts(parts), "bbox": tiles.as_box(parts)})
            yield from mvt._batches(iter(out), pa.schema([mvt.ARROW.field(n) for n in own]))

    kind = features.select(*own).schema
    return schema.with_properties(features.select(*own).mapInArrow(run, kind))


def write(features: DataFrame, path: str, options: tiles.ExportOptions = tiles.ExportOptions(), layers: list[str] | None = None, layer_property: str | None = schema.LAYER_PROPERTY, extra: dict | None = None, mode: str = "error") -> None:
    """A folder of newline-delimited features: every partition writes its own file."""
    out = lines(prepared(features, options, layers), layer_property, extra).select("json")
    writer = out.write.mode(mode)
    (writer.option("compression", "gzip") if options.compression is not None else writer).text(path)


def document(features: DataFrame, options: tiles.ExportOptions = tiles.ExportOptions(), layers: list[str] | None = None, layer_property: str | None = schema.LAYER_PROPERTY, extra: dict | None = None, pretty: bool = False) -> bytes:
    """One FeatureCollection, for one tile or another small selection: it comes to the driver partition by partition."""
    rows = lines(prepared(features, options, layers), layer_property, extra).orderBy("layer", "ordinal").toLocalIterator()
    text = '{"type":"FeatureCollection","features":[' + ",".join(r.json for r in rows) + "]}"
    if pretty:
        text = json.dumps(json.loads(text), indent=2, ensure_ascii=False, sort_keys=True)
    data = text.encode()
    return data if options.compression is None else gzip.compress(data, min(9, max(0, options.compression)), mtime=0)


def _sorted_out(spark: SparkSession, paths: list[str], tile: tuple[int, int, int] | None) -> DataFrame:
    """source, z, x, y, data, json: files of either kind, told apart by how they begin."""
    files = mvt.blobs(spark, paths, tile)
    zipped = F.substring("data", 1, 2) == F.lit(ZIPPED)
    plain = F.make_valid_utf8(F.substring("data", 1, 512).cast("string"))
    return files.withColumn("json", _begins_as_json(F.when(zipped, _text(F.when(zipped, F.col("data")))).otherwise(plain)))


def read_auto(spark: SparkSession, paths: list[str], srid: int = 4326, tile: tuple[int, int, int] | None = None, layers: list[str] | None = None, **options) -> DataFrame:
    """Files of either kind: those whose first letter that isn't white space is a brace or a bracket are GeoJSON, the rest vector tiles."""
    both = _sorted_out(spark, paths, tile)
    own = mvt.decode(both.where("not json and z is not null").drop("json"), srid, layers)
    return own.unionByName(decode(both.where("json").select("source", _text(F.col("data")).alias("text")), layers=layers, **options))


def unreadable(spark: SparkSession, paths: list[str], srid: int = 4326, tile: tuple[int, int, int] | None = None) -> DataFrame:
    """source, problem: what ``read_auto`` gives nothing for."""
    both = _sorted_out(spark, paths, tile)
    text = both.where("json").select("source", _text(F.col("data")).alias("text"))
    broken = text.where(F.try_parse_json("text").isNull()).select("source", F.lit("no JSON").alias("problem"))
    return mvt.unreadable(both.where("not json").drop("json"), srid).unionByName(broken)
