"""Queries over the test tables, one or more for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith import schema
from cartolith.functions import geo, values
from cartolith.operators import profile, restructure, select
from cartolith.plans.compile import Bag, predicate
from cartolith.sources import geojson, mvt
from cartolith.sources.tiles import ExportOptions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_features(spark: SparkSession, sf: str, props: Column | str = "props") -> DataFrame:
    """Events as features without geometry: the type is the layer."""
    text = F.col(props) if isinstance(props, str) else props
    rows = table(spark, sf, "events").select("event_id", "event_type", text.alias("props"))
    return schema.features(rows, source=F.lit("events"), layer=F.col("event_type"), ordinal=F.col("event_id"), fid=F.col("event_id"), fid_text=F.col("event_id").cast("string"), geom_type=F.lit("Point"), props_json=F.col("props"))


def lon_lat(key: str) -> tuple[Column, Column]:
    """Made-up degrees of an id, the same in both engines."""
    return (F.col(key) * 7919 % 36000) / 100.0 - 180, (F.col(key) * 104729 % 17000) / 100.0 - 85


LON_LAT = "(({k} * 7919 % 36000) / 100.0 - 180)", "(({k} * 104729 % 17000) / 100.0 - 85)"


def points(spark: SparkSession, sf: str, name: str = "customer", key: str = "c_custkey", layer: str = "c_mktsegment") -> DataFrame:
    """Customers (or suppliers) as point features."""
    lon, lat = lon_lat(key)
    rows = table(spark, sf, name).withColumns({"lon": lon, "lat": lat})
    parts = schema.point_parts(F.col("lon"), F.col("lat"))
    out = schema.features(
        rows, source=F.lit(name), origin=F.lit("geoJson"), srid=4326, layer=F.col(layer) if layer in rows.columns else F.lit(layer), ordinal=F.col(key), fid=F.col(key), fid_text=F.col(key).cast("string"), geom_type=F.lit("Point"),
        parts=parts, bbox=geo.box(F.col("lon"), F.col("lat"), F.col("lon"), F.col("lat")), props_json=F.to_json(F.struct(F.col(key).alias("id"), F.col(f"{key[0]}_nationkey").alias("nation"))),
    )
    return out


def sql_points(name: str = "customer", key: str = "c_custkey") -> str:
    lon, lat = (x.format(k=key) for x in LON_LAT)
    return f"(SELECT *, {lon}::DOUBLE AS lon, {lat}::DOUBLE AS lat FROM {name})"


def xy() -> tuple[Column, Column]:
    return F.col("bbox.xmin"), F.col("bbox.ymin")


def rounded(c: Column, name: str, places: int = 6) -> Column:
    return F.round(c, places).alias(name)


# Predicates


@query("SELECT event_id FROM events WHERE json_exists(props, '$.k')")
def pred_exists(spark, sf):
    return select.query(event_features(spark, sf), ".k").select(F.col("ordinal").alias("event_id"))


@query("SELECT event_id FROM events WHERE (props->>'k')::BIGINT = 50")
def pred_eq_num(spark, sf):
    return select.query(event_features(spark, sf), ".k == 50.0").select(F.col("ordinal").alias("event_id"))


@query("SELECT event_id FROM events WHERE (props->>'k')::BIGINT <> 50")
def pred_ne_num(spark, sf):
    return select.query(event_features(spark, sf), ".k != 50").select(F.col("ordinal").alias("event_id"))


@query("SELECT event_id FROM events WHERE FALSE")
def pred_kind_mismatch(spark, sf):
    return select.query(event_features(spark, sf), ".k == 'fifty' or .k == true").select(F.col("ordinal").alias("event_id"))


def where(df: DataFrame, text: str, /, **columns: str) -> DataFrame:
    """Rows for which a predicate over plain columns holds."""
    return df.where(predicate(text, Bag(df, columns)))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_discount <= 0.05 AND l_returnflag = 'R'")
def pred_range_and(spark, sf):
    return where(table(spark, sf, "lineitem"), '.quantity > 10 and .discount <= 0.05 and .flag == "R"', quantity="l_quantity", discount="l_discount", flag="l_returnflag").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE (p_size < 5 OR p_brand = 'Brand#3') AND p_retailprice > 950")
def pred_or_left_to_right(spark, sf):
    return where(table(spark, sf, "part"), '.size < 5 or .brand == "Brand#3" and .price > 950', size="p_size", brand="p_brand", price="p_retailprice").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT (p_size > 10 AND p_retailprice > 950)")
def pred_not_postfix(spark, sf):
    return where(table(spark, sf, "part"), ".size > 10 and .price > 950 not", size="p_size", price="p_retailprice").select("p_partkey")


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 AND (event_id % 2 = 1 OR (props->>'k')::BIGINT >= 20)")
def pred_abort_missing(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"x":'), (F.col("event_id") % 2).cast("string"), F.lit(","), F.substr("props", F.lit(2)))).otherwise(F.col("props"))
    return select.query(event_features(spark, sf, text), ".x == 1 or .k >= 20").select(F.col("ordinal").alias("event_id"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[A-M].*[ED]$')")
def pred_regex(spark, sf):
    return where(table(spark, sf, "part"), '.type =~ "/^[A-M].*[ED]$/"', type="p_type").select("p_partkey")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'and\\s+the', 'i')")
def pred_regex_ci(spark, sf):
    return where(table(spark, sf, "documents"), r".text =~ '/and\\s+the/i'", text="text").select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'oning the')")
def pred_fulltext(spark, sf):
    return where(table(spark, sf, "documents"), "Oning the", text="text", id="doc_id").select("doc_id")


@query("""SELECT page_id FROM pages WHERE contains(lower(html), 't="</p>"')""")
def pred_raw_search(spark, sf):
    return where(table(spark, sf, "pages"), 't="</p>"', html="html").select("page_id")


@query("SELECT vec_id FROM embeddings WHERE embedding[1] > 0.05 AND embedding[3] <= 0")
def pred_array_index(spark, sf):
    return where(table(spark, sf, "embeddings"), ".e.0 > 0.05 and .e.[2] <= 0", e="embedding").select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE embedding[-1] > 0.05")
def pred_negative_index(spark, sf):
    return where(table(spark, sf, "embeddings"), ".e.-1 > 0.05", e="embedding").select("vec_id")


# Projections and tiles

_X = "radians(lon) * 6378137.0"
_Y = "ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0"


@query(f"SELECT c_custkey, round({_X}, 6) AS mx, round({_Y}, 6) AS my FROM {sql_points()}")
def mercator_forward(spark, sf):
    x, y = xy()
    return points(spark, sf).select(F.col("ordinal").alias("c_custkey"), rounded(geo.mercator_x(x), "mx"), rounded(geo.mercator_y(y), "my"))


@query(f"SELECT c_custkey, round(degrees(lon * 100000 / 6378137.0), 6) AS lon, round(degrees(atan(sinh(lat * 100000 / 6378137.0))), 6) AS lat FROM {sql_points()}")
def mercator_inverse(spark, sf):
    x, y = xy()
    return points(spark, sf).select(F.col("ordinal").alias("c_custkey"), rounded(geo.lon_of(x * 100000), "lon"), rounded(geo.lat_of(y * 100000), "lat"))


_TX = "floor((lon + 180) / 360 * pow(2.0, {z}))::INT"
_TY = "floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2.0, {z}))::INT"


@query(f"SELECT c_custkey, {_TX.format(z=9)} AS x, {_TY.format(z=9)} AS y FROM {sql_points()}")
def tile_of_point(spark, sf):
    x, y = xy()
    return points(spark, sf).select(F.col("ordinal").alias("c_custkey"), geo.tile_x(x, 9).alias("x"), geo.tile_y(y, 9).alias("y"))


@query("""SELECT s_suppkey, round(-20037508.342789244 + x * u, 6) AS xmin, round(20037508.342789244 - (y + 1) * u, 6) AS ymin, round(-20037508.342789244 + (x + 1) * u, 6) AS xmax, round(20037508.342789244 - y * u, 6) AS ymax
FROM (SELECT s_suppkey, s_suppkey % 64 AS x, s_suppkey % 61 AS y, 40075016.68557849 / 64 AS u FROM supplier)""")
def tile_bounds(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", geo.tile_bounds(6, F.col("s_suppkey") % 64, F.col("s_suppkey") % 61).alias("b"))
    return rows.select("s_suppkey", *(rounded(F.col(f"b.{n}"), n) for n in ("xmin", "ymin", "xmax", "ymax")))


_UNITS = f"""SELECT c_custkey, tx, ty, trunc((({_X} + 20037508.342789244) / u - tx) * 4096)::BIGINT AS px, trunc(((20037508.342789244 - {_Y}) / u - ty) * 4096)::BIGINT AS py
FROM (SELECT *, {_TX.format(z=4)} AS tx, {_TY.format(z=4)} AS ty, 40075016.68557849 / 16 AS u FROM {sql_points()})"""


@query(_UNITS)
def tile_quantize(spark, sf):
    x, y = xy()
    rows = points(spark, sf).select(F.col("ordinal").alias("c_custkey"), x.alias("lon"), y.alias("lat"), geo.tile_x(x, 4).alias("tx"), geo.tile_y(y, 4).alias("ty"))
    return rows.select("c_custkey", "tx", "ty", geo.quantize_x(geo.mercator_x(F.col("lon")), 4, F.col("tx")).alias("px"), geo.quantize_y(geo.mercator_y(F.col("lat")), 4, F.col("ty")).alias("py"))


@query("SELECT s_suppkey, xor(s << 1, s >> 31) AS encoded, s AS decoded FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE -s_suppkey END AS s FROM supplier) WHERE s >= 0 UNION ALL SELECT s_suppkey, 2 * s_suppkey - 1, -s_suppkey FROM supplier WHERE s_suppkey % 2 <> 0")
def zigzag_roundtrip(spark, sf):
    signed = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).otherwise(-F.col("s_suppkey"))
    rows = table(spark, sf, "supplier").select("s_suppkey", geo.zigzag(signed).alias("encoded"))
    return rows.select("s_suppkey", "encoded", geo.unzigzag(F.col("encoded")).alias("decoded"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 2 THEN 'Polygon' WHEN l_linenumber % 3 = 1 THEN 'LineString' ELSE 'MultiPoint' END AS kind,
CASE WHEN l_linenumber % 3 = 2 THEN 4 ELSE 3 END AS n, x::DOUBLE AS first_x, y::DOUBLE AS first_y,
CASE WHEN l_linenumber % 3 = 2 THEN x ELSE x - 4 END::DOUBLE AS last_x, CASE WHEN l_linenumber % 3 = 2 THEN y ELSE y + 11 END::DOUBLE AS last_y
FROM (SELECT *, l_partkey % 1000 AS x, -(l_suppkey % 500) AS y FROM lineitem)""")
def command_decode(spark, sf):
    x, y = F.col("l_partkey") % 1000, -(F.col("l_suppkey") % 500)
    steps = [geo.zigzag(v.cast("long")) for v in (x, y, F.lit(9), F.lit(1), F.lit(-13), F.lit(10))]
    line = F.array(F.lit(9).cast("long"), *steps[:2], F.lit(18).cast("long"), *steps[2:])
    kind = F.col("l_linenumber") % 3
    stream = F.when(kind == 2, F.concat(line, F.array(F.lit(15).cast("long")))).when(kind == 1, line).otherwise(F.array(F.lit(25).cast("long"), *steps))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(kind == 2, 3).when(kind == 1, 2).otherwise(1).alias("type"), stream.alias("commands"))
    got = mvt.geometries(rows)
    v = F.flatten(F.flatten("parts"))
    first, last = F.element_at(v, 1), F.element_at(v, -1)
    return got.select("l_orderkey", "l_linenumber", F.col("geom_type").alias("kind"), F.size(v).alias("n"), first["x"].alias("first_x"), first["y"].alias("first_y"), last["x"].alias("last_x"), last["y"].alias("last_y"))


# Spatial selection

_DEG = "degrees({t} / 6378137.0)"


@query(f"SELECT c_custkey FROM {sql_points()} WHERE lon BETWEEN -20 AND 60 AND lat BETWEEN -10 AND 45")
def bbox_select(spark, sf):
    return select.in_box(points(spark, sf), (-20.0, -10.0, 60.0, 45.0)).select(F.col("ordinal").alias("c_custkey"))


@query(f"SELECT c_custkey FROM {sql_points()} WHERE c_mktsegment = 'BUILDING' AND abs(lat - 47) <= {_DEG.format(t=900000)} AND abs(lon - 8) <= {_DEG.format(t=900000)} / cos(radians(47))")
def point_tolerance_select(spark, sf):
    return select.around(points(spark, sf), 8.0, 47.0, 900_000, layer="BUILDING").select(F.col("ordinal").alias("c_custkey"))


_HAVERSINE = "2 * 6371008.8 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"


@query(f"SELECT c_custkey FROM {sql_points()} WHERE c_nationkey < 20 AND {_HAVERSINE.format(a='lat', b='47.0', c='lon', d='8.0')} <= 1500000")
def near_select(spark, sf):
    return select.query(points(spark, sf), "near(47, 8, 1500000) and .nation < 20").select(F.col("ordinal").alias("c_custkey"))


_MANY = f"""SELECT s.s_suppkey AS point_idx, c.c_mktsegment AS layer, c.c_custkey::VARCHAR AS fid_text
FROM {sql_points("supplier", "s_suppkey")} s JOIN {sql_points()} c
ON c.lat BETWEEN greatest(s.lat - {_DEG.format(t=150000)}, -90) AND least(s.lat + {_DEG.format(t=150000)}, 90)
AND c.lon BETWEEN greatest(s.lon - {_DEG.format(t=150000)} / cos(radians(s.lat)), -180) AND least(s.lon + {_DEG.format(t=150000)} / cos(radians(s.lat)), 180)"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = lon_lat("s_suppkey")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("point_idx"), lon.alias("px"), lat.alias("py"))


@query(_MANY)
def query_many(spark, sf):
    return select.around_many(points(spark, sf), _asked(spark, sf), 150_000)


@query(f"SELECT min(point_idx) AS point_idx, layer, fid_text FROM ({_MANY}) GROUP BY layer, fid_text")
def query_many_dedup(spark, sf):
    return select.around_many(points(spark, sf), _asked(spark, sf), 150_000, include_duplicates=False)


@query(f"SELECT c_custkey FROM {sql_points()} WHERE lon BETWEEN 0 AND 30 AND lat BETWEEN 0 AND 30")
def hilbert_clustered_bbox(spark, sf):
    return select.in_box(select.clustered(points(spark, sf), 8), (0.0, 0.0, 30.0, 30.0)).select(F.col("ordinal").alias("c_custkey"))


# Profiles


@query("SELECT event_type AS layer, count(*) AS point_features, 0::BIGINT AS line_features, 0::BIGINT AS polygon_features, 0::BIGINT AS unknown_features, count(*) AS features, NULL::INT AS version FROM events GROUP BY 1")
def layer_counts(spark, sf):
    return profile.layer_counts(event_features(spark, sf))


_KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")


@query("""SELECT o_orderstatus AS layer, count(*) FILTER (o_orderkey % 7 < 2) AS point_features, count(*) FILTER (o_orderkey % 7 IN (2, 3)) AS line_features,
count(*) FILTER (o_orderkey % 7 IN (4, 5)) AS polygon_features, count(*) FILTER (o_orderkey % 7 = 6) AS unknown_features, count(*) AS features, NULL::INT AS version FROM orders GROUP BY 1""")
def geom_class_counts(spark, sf):
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 7).cast("int"))
    return profile.layer_counts(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("layer"), kind.alias("geom_type")))


def order_features(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a priority, and a total only for every second one."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    even = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 5)
    return schema.features(rows, layer=F.col("o_orderstatus"), ordinal=F.col("o_orderkey"), props_json=F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), even.alias("rest"))))


_ENTRIES = """(SELECT o_orderstatus AS layer, 'priority' AS key, o_orderpriority AS value_text FROM orders
UNION ALL SELECT o_orderstatus, 'rest', (o_orderkey % 5)::VARCHAR FROM orders WHERE o_orderkey % 2 = 0)"""


@query(f"SELECT layer, key, count(*) AS n FROM {_ENTRIES} GROUP BY 1, 2")
def property_presence(spark, sf):
    return profile.property_presence(order_features(spark, sf))


@query(f"SELECT layer, key, value_text, count(*) AS n FROM {_ENTRIES} GROUP BY 1, 2, 3")
def property_histogram(spark, sf):
    return profile.property_histogram(order_features(spark, sf))


@query(f"SELECT layer, count(*) FILTER (key = 'priority') AS priority, count(*) FILTER (key = 'rest') AS rest FROM {_ENTRIES} GROUP BY 1")
def property_pivot(spark, sf):
    return profile.property_table(order_features(spark, sf))


@query(f"""SELECT key, {", ".join(f'''count(*) FILTER (value_text = '{v}') AS "{v}"''' for v in "01234")} FROM {_ENTRIES} WHERE key = 'rest' GROUP BY 1""")
def value_pivot(spark, sf):
    return profile.value_table(order_features(spark, sf), ["rest"])


@query(f"SELECT c_mktsegment AS layer, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM {sql_points()} GROUP BY 1")
def layer_bbox(spark, sf):
    return profile.layer_bounds(points(spark, sf))


@query("SELECT DISTINCT event_type AS layer FROM events")
def layer_list(spark, sf):
    return profile.layers(event_features(spark, sf))


# Restructuring


def ids(df: DataFrame) -> DataFrame:
    return df.select("layer", "fid_text", "ordinal")


_C = "SELECT c_mktsegment AS layer, c_custkey::VARCHAR AS fid_text, c_custkey AS ordinal FROM customer"
_S = "SELECT {layer} AS layer, s_suppkey::VARCHAR AS fid_text, s_suppkey AS ordinal FROM supplier"


@query(f"{_C} UNION ALL {_S.format(layer=repr('suppliers'))}")
def merge_union_all(spark, sf):
    return ids(restructure.merge(points(spark, sf), points(spark, sf, "supplier", "s_suppkey", "suppliers")))


@query(f"{_C} WHERE c_mktsegment <> 'BUILDING' UNION ALL {_S.format(layer=repr('BUILDING'))}")
def set_layer(spark, sf):
    return ids(restructure.set_layer(points(spark, sf), "BUILDING", points(spark, sf, "supplier", "s_suppkey", "suppliers")))


@query(f"{_C} UNION ALL SELECT 'BUILDING', s_suppkey::VARCHAR, s_suppkey + 1 + (SELECT max(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING') FROM supplier")
def append_layer(spark, sf):
    return ids(restructure.append_layer(points(spark, sf), "BUILDING", points(spark, sf, "supplier", "s_suppkey", "suppliers")))


@query(f"{_C} WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey < 10)")
def remove_features(spark, sf):
    return ids(restructure.remove_features(points(spark, sf), "BUILDING", predicate(".nation < 10")))


@query(f"{_C} WHERE c_mktsegment <> 'BUILDING'")
def remove_layer(spark, sf):
    return ids(restructure.remove_layer(points(spark, sf), "BUILDING")[0])


@query(f"{_C} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def extract_layers(spark, sf):
    return ids(restructure.extract(points(spark, sf), ["BUILDING", "MACHINERY", "none"]))


@query(f"{_C} WHERE FALSE")
def clear_tile(spark, sf):
    return ids(restructure.clear(points(spark, sf)))


@query(f"{_C} WHERE c_mktsegment = 'BUILDING'")
def layer_features(spark, sf):
    return ids(restructure.features_of(points(spark, sf), "BUILDING"))


@query(f"{_C} WHERE c_mktsegment = 'MACHINERY'")
def allow_deny(spark, sf):
    return ids(restructure.choose_layers(points(spark, sf), ["BUILDING", "MACHINERY"], ["BUILDING"]))


_ROUTED = "CASE WHEN event_id % 4 = 0 THEN 'l' || (event_id % 3) ELSE 'Layer-0' END"


@query(f"SELECT event_id, {_ROUTED} AS layer, (props->>'k')::BIGINT AS k FROM events")
def layer_routing(spark, sf):
    name = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('"l'), (F.col("event_id") % 3).cast("string"), F.lit('"'))).otherwise(F.lit("7"))
    text = F.concat(F.lit('{"vt_layer":'), name, F.lit(","), F.substr("props", F.lit(2)))
    routed = restructure.routed(event_features(spark, sf, text))
    return routed.select(F.col("ordinal").alias("event_id"), "layer", F.try_variant_get("properties", "$.k", "bigint").alias("k"))


@query("SELECT n_nationkey, n_name AS name, n_regionkey::VARCHAR AS region, 'map' AS kind FROM nation")
def add_properties(spark, sf):
    rows = schema.features(table(spark, sf, "nation"), ordinal=F.col("n_nationkey"), props_json=F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))))
    out = restructure.with_properties(rows, {"kind": "map", "name": "none"})
    return out.select(F.col("ordinal").cast("int").alias("n_nationkey"), *(F.try_variant_get("properties", f"$.{n}", "string").alias(n) for n in ("name", "region", "kind")))


@query(f"SELECT c_custkey, round({_X}, 4) AS x, round({_Y}, 4) AS y FROM {sql_points()}")
def reproject_features(spark, sf):
    out = restructure.reprojected(points(spark, sf), 3857)
    return out.select(F.col("ordinal").alias("c_custkey"), rounded(F.col("parts")[0][0][0]["x"], "x", 4), rounded(F.col("bbox.ymax"), "y", 4))


# Paths and small functions


@query("SELECT s_suppkey, 6 AS z, (s_suppkey % 64)::INT AS x, (s_suppkey % 61)::INT AS y FROM supplier")
def path_zxy(spark, sf):
    a, b = (F.col("s_suppkey") % 64).cast("string"), (F.col("s_suppkey") % 61).cast("string")
    slashed, joined = F.concat(F.lit("file:/tiles/6/"), a, F.lit("/"), b, F.lit(".mvt")), F.concat(F.lit("file:/tiles/6_"), a, F.lit("_"), b, F.lit(".vector.mvt"))
    at = mvt.tile_of_path(F.when(F.col("s_suppkey") % 2 == 0, slashed).otherwise(joined))
    return table(spark, sf, "supplier").select("s_suppkey", at.alias("t")).select("s_suppkey", "t.z", "t.x", "t.y")


@query("SELECT p_partkey, regexp_matches(p_name, 'red', 'i') AS found, p_name AS trimmed, contains(lower(p_type), 'steel') AS steel FROM part")
def text_functions(spark, sf):
    padded = F.concat(F.lit(" \t\n"), "p_name", F.lit("\r\n "))
    return table(spark, sf, "part").select("p_partkey", values.regex_find(F.col("p_name"), "/red/i").alias("found"), values.trimmed(padded).alias("trimmed"), values.contains_any_case(F.col("p_type"), "Steel").alias("steel"))


@query("SELECT vec_id, embedding[-2]::DOUBLE AS second_last, embedding[2]::DOUBLE AS second, (len(embedding) // 2)::INT AS n_pairs, CAST(NULL AS DOUBLE) AS outside FROM embeddings")
def array_functions(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", values.element(e, -2).cast("double").alias("second_last"), values.element(e, 1).cast("double").alias("second"), F.size(values.pairs(e)).alias("n_pairs"), values.element(e, 1000).cast("double").alias("outside"))


@query("SELECT n_nationkey, n_nationkey AS left_wins, n_nationkey + n_regionkey AS summed, TRUE AS has_a FROM nation")
def map_functions(spark, sf):
    a = F.create_map(F.lit("a"), F.col("n_nationkey"))
    b = F.create_map(F.lit("a"), F.col("n_regionkey"), F.lit("b"), F.col("n_regionkey"))
    return table(spark, sf, "nation").select("n_nationkey", values.merged_left(a, b)["a"].alias("left_wins"), values.merged_sum(a, b)["a"].alias("summed"), values.has_key(b, "a").alias("has_a"))


@query(f"SELECT c_custkey, CASE WHEN abs(lat) <= 90 THEN lat END AS lat, CASE WHEN abs(lat) <= 90 THEN lon END AS lon FROM {sql_points()}")
def asked_points(spark, sf):
    x, y = xy()
    text = F.concat(F.format_string("%.2f", y), F.lit(","), F.format_string("%.2f", x), F.lit(",100"))
    return points(spark, sf).select(F.col("ordinal").alias("c_custkey"), values.asked_point(text).alias("p")).select("c_custkey", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


@query("SELECT o_orderkey, (o_orderkey % 2 = 0) AS exterior FROM orders")
def ring_orientation(spark, sf):
    def vertex(x: int, y: int) -> Column:
        return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))

    there, back = F.array(vertex(0, 0), vertex(4, 0), vertex(4, 4), vertex(0, 0)), F.array(vertex(0, 0), vertex(4, 4), vertex(4, 0), vertex(0, 0))
    return table(spark, sf, "orders").select("o_orderkey", values.is_exterior(F.when(F.col("o_orderkey") % 2 == 0, there).otherwise(back)).alias("exterior"))


# Tiles and GeoJSON


def tiled(spark: SparkSession, sf: str, z: int = 4) -> DataFrame:
    x, y = xy()
    return points(spark, sf).withColumns({"z": F.lit(z), "x": geo.tile_x(x, z), "y": geo.tile_y(y, z)})


@query(f"SELECT c_custkey, tx AS x, ty AS y, px, py FROM ({_UNITS})")
def mvt_roundtrip(spark, sf):
    blobs = mvt.encode(tiled(spark, sf)).withColumn("source", F.lit("memory"))
    p = F.col("parts")[0][0][0]
    return mvt.decode(blobs, 0).select(F.col("fid").cast("bigint").alias("c_custkey"), "x", "y", p["x"].cast("bigint").alias("px"), p["y"].cast("bigint").alias("py"))


@query("SELECT c_mktsegment AS layer, count(*) AS point_features, 0::BIGINT AS line_features, 0::BIGINT AS polygon_features, 0::BIGINT AS unknown_features, count(*) AS features, 2 AS version FROM customer GROUP BY 1")
def wire_counts(spark, sf):
    return profile.wire_counts(mvt.wire_profile(mvt.encode(tiled(spark, sf)).withColumn("source", F.lit("memory"))))


@query(f"SELECT DISTINCT layer FROM (SELECT c_mktsegment AS layer FROM {sql_points()})")
def mvt_layer_names(spark, sf):
    return mvt.layer_names(mvt.encode(tiled(spark, sf)).withColumn("source", F.lit("memory"))).select("layer").distinct()


@query(f"SELECT c_custkey, c_mktsegment AS layer, lon, lat, c_nationkey::BIGINT AS nation FROM {sql_points()}")
def geojson_roundtrip(spark, sf):
    texts = geojson.lines(points(spark, sf)).select(F.lit("memory").alias("source"), F.col("json").alias("text"))
    p = F.col("parts")[0][0][0]
    return geojson.decode(texts).select(F.col("fid").cast("bigint").alias("c_custkey"), "layer", p["x"].alias("lon"), p["y"].alias("lat"), F.try_variant_get("properties", "$.nation", "bigint").alias("nation"))


# Lines and polygons


def vertex(x: Column | float, y: Column | float) -> Column:
    x, y = (v if isinstance(v, Column) else F.lit(v) for v in (x, y))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def shapes_of(spark: SparkSession, sf: str, kind: str, parts: Column, srid: int = 4326, name: str = "customer", key: str = "c_custkey", **more: Column | int) -> DataFrame:
    """A feature for each customer (or supplier), drawn from columns lon and lat."""
    lon, lat = lon_lat(key)
    rows = table(spark, sf, name).withColumns({"lon": lon, "lat": lat}).withColumn("shape", parts)
    return schema.features(rows, source=F.lit(name), srid=srid, layer=F.lit("shapes"), ordinal=F.col(key), fid=F.col(key), fid_text=F.col(key).cast("string"), geom_type=F.lit(kind), parts=F.col("shape"), bbox=schema.bbox_of(F.col("shape")), props_json=F.lit("{}"), **more)


def bent() -> Column:
    """Two segments: 6 to the east, then 8 to the north."""
    x, y = F.col("lon") / 2, F.col("lat") / 2
    return F.array(F.array(F.array(vertex(x, y), vertex(x + 6, y), vertex(x + 6, y + 8))))


def diamond(r: float = 5.0) -> Column:
    x, y = F.col("lon") / 2, F.col("lat") / 2
    return F.array(F.array(F.array(vertex(x + r, y), vertex(x, y + r), vertex(x - r, y), vertex(x, y - r), vertex(x + r, y))))


_HALVED = f"(SELECT *, lon / 2 AS x, lat / 2 AS y FROM {sql_points()})"


@query(f"""SELECT c_custkey FROM {_HALVED} WHERE (y BETWEEN -20 AND 15 AND x <= 40 AND x + 6 >= -30) OR (x + 6 BETWEEN -30 AND 40 AND y <= 15 AND y + 8 >= -20)""")
def line_bbox_select(spark, sf):
    return select.in_box(shapes_of(spark, sf, "LineString", bent()), (-30.0, -20.0, 40.0, 15.0)).select(F.col("ordinal").alias("c_custkey"))


@query(f"SELECT c_custkey FROM {_HALVED} WHERE greatest(-1.5 - x, 0, x - 40) + greatest(-20 - y, 0, y - 15) <= 5")
def polygon_bbox_select(spark, sf):
    return select.in_box(shapes_of(spark, sf, "Polygon", diamond()), (-1.5, -20.0, 40.0, 15.0)).select(F.col("ordinal").alias("c_custkey"))


@query(f"SELECT c_custkey, round((6 * (x + 3) + 8 * (x + 6)) / 14, 6) AS x, round((6 * y + 8 * (y + 4)) / 14, 6) AS y FROM {_HALVED}")
def line_centroid(spark, sf):
    out = select.with_centroid(shapes_of(spark, sf, "LineString", bent()))
    return out.select(F.col("ordinal").alias("c_custkey"), rounded(F.col("centroid.x"), "x"), rounded(F.col("centroid.y"), "y"))


@query(f"SELECT c_custkey, round((x * 100 - (x + 2) * 4) / 96, 6) AS x, round(y, 6) AS y FROM {_HALVED}")
def polygon_centroid(spark, sf):
    x, y = F.col("lon") / 2, F.col("lat") / 2

    def square(cx: Column, half: int) -> Column:
        return F.array(*(vertex(cx + a * half, y + b * half) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))

    out = select.with_centroid(shapes_of(spark, sf, "Polygon", F.array(F.array(square(x, 5), square(x + 2, 1)))))
    return out.select(F.col("ordinal").alias("c_custkey"), rounded(F.col("centroid.x"), "x"), rounded(F.col("centroid.y"), "y"))


@query(f"SELECT c_custkey FROM {_HALVED} WHERE {_HAVERSINE.format(a='(6 * y + 8 * (y + 4)) / 14', b='20.0', c='(6 * (x + 3) + 8 * (x + 6)) / 14', d='10.0')} <= 2500000")
def near_lines(spark, sf):
    return select.query(shapes_of(spark, sf, "LineString", bent()), "near(20, 10, 2500000)").select(F.col("ordinal").alias("c_custkey"))


_WIDE = f"SELECT s_suppkey AS point_idx, lon AS px, lat AS py, {_DEG.format(t=150000)} AS dy, {_DEG.format(t=150000)} / cos(radians(lat)) AS dx FROM {sql_points('supplier', 's_suppkey')}"


@query(f"""SELECT point_idx, 'shapes' AS layer, c_custkey::VARCHAR AS fid_text FROM ({_WIDE}) JOIN {_HALVED} ON
(y BETWEEN greatest(py - dy, -90) AND least(py + dy, 90) AND x <= least(px + dx, 180) AND x + 6 >= greatest(px - dx, -180))
OR (x + 6 BETWEEN greatest(px - dx, -180) AND least(px + dx, 180) AND y <= least(py + dy, 90) AND y + 8 >= greatest(py - dy, -90))""")
def query_many_lines(spark, sf):
    return select.around_many(shapes_of(spark, sf, "LineString", bent()), _asked(spark, sf), 150_000)


@query("SELECT s_suppkey, 'MultiLineString' AS kind, 2 AS parts, 5 AS vertices, s_suppkey % 64 AS first_x, s_suppkey % 61 AS first_y, s_suppkey % 64 + 30 AS last_x, s_suppkey % 61 - 9 AS last_y FROM supplier")
def line_roundtrip(spark, sf):
    x, y = F.col("s_suppkey") % 64, F.col("s_suppkey") % 61
    parts = F.array(F.array(F.array(vertex(x, y), vertex(x + 10, y + 5), vertex(x + 20, y - 3))), F.array(F.array(vertex(x + 25, y), vertex(x + 30, y - 9))))
    rows = shapes_of(spark, sf, "MultiLineString", parts, 0, "supplier", "s_suppkey", z=0, x=0, y=0)
    got = mvt.decode(mvt.encode(rows).withColumn("source", F.lit("memory")), 0)
    v = F.flatten(F.flatten("parts"))
    ends = [F.element_at(v, i)[n].cast("bigint").alias(f"{w}_{n}") for i, w in ((1, "first"), (-1, "last")) for n in "xy"]
    return got.select(F.col("fid").cast("bigint").alias("s_suppkey"), F.col("geom_type").alias("kind"), F.size("parts").alias("parts"), F.size(v).alias("vertices"), *ends)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 1 END AS rings, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS polygons, 10 * (s_suppkey % 64) AS xmin, CASE WHEN s_suppkey % 2 = 0 THEN 60 ELSE 20 END + 10 * (s_suppkey % 64) AS xmax FROM supplier")
def polygon_roundtrip(spark, sf):
    x = 10 * (F.col("s_suppkey") % 64)

    def square(at: Column, side: int, down: bool) -> Column:
        corners = [(0, 0), (side, 0), (side, side), (0, side), (0, 0)]
        return F.array(*(vertex(at + a, F.lit(b)) for a, b in (corners if down else corners[::-1])))

    two = F.array(F.array(square(x, 20, True), square(x + 5, 5, False)), F.array(square(x + 40, 20, True)))
    parts = F.when(F.col("s_suppkey") % 2 == 0, two).otherwise(F.array(F.array(square(x, 20, True))))
    rows = shapes_of(spark, sf, "MultiPolygon", parts, 0, "supplier", "s_suppkey", z=0, x=0, y=0)
    got = mvt.decode(mvt.encode(rows).withColumn("source", F.lit("memory")), 0)
    return got.select(F.col("fid").cast("bigint").alias("s_suppkey"), F.col("geom_type").alias("kind"), F.size(F.flatten("parts")).alias("rings"), F.size("parts").alias("polygons"), F.col("bbox.xmin").cast("bigint").alias("xmin"), F.col("bbox.xmax").cast("bigint").alias("xmax"))


_BOX = "-20037508.342789244 + 4 * 40075016.68557849 / 8 - 64 * 40075016.68557849 / 8 / 4096 AS xmin, -20037508.342789244 + 5 * 40075016.68557849 / 8 + 64 * 40075016.68557849 / 8 / 4096 AS xmax, 20037508.342789244 - 4 * 40075016.68557849 / 8 - 64 * 40075016.68557849 / 8 / 4096 AS ymin, 20037508.342789244 - 3 * 40075016.68557849 / 8 + 64 * 40075016.68557849 / 8 / 4096 AS ymax"
_METRES = f"(SELECT c_custkey, lon * 40000 AS x, lat * 80000 AS y, {_BOX} FROM {sql_points()})"
_TILE = {"z": 3, "x": 4, "y": 3}


@query(f"SELECT c_custkey, round(greatest(x, xmin), 3) AS from_x, round(least(x + 3e6, xmax), 3) AS to_x, round(y, 3) AS y FROM {_METRES} WHERE y BETWEEN ymin AND ymax AND x < xmax AND x + 3e6 > xmin")
def clip_lines(spark, sf):
    x, y = F.col("lon") * 40000, F.col("lat") * 80000
    rows = shapes_of(spark, sf, "LineString", F.array(F.array(F.array(vertex(x, y), vertex(x + 3e6, y)))), 3857, **_TILE)
    v = F.col("parts")[0][0]
    return geojson.prepared(rows, ExportOptions(buffer_extents=64)).select(F.col("ordinal").alias("c_custkey"), rounded(v[0]["x"], "from_x", 3), rounded(F.element_at(v, -1)["x"], "to_x", 3), rounded(v[0]["y"], "y", 3))


@query(f"SELECT c_custkey, round(greatest(x, xmin), 3) AS xmin, round(greatest(y, ymin), 3) AS ymin, round(least(x + 3e6, xmax), 3) AS xmax, round(least(y + 2e6, ymax), 3) AS ymax FROM {_METRES} WHERE x < xmax AND x + 3e6 > xmin AND y < ymax AND y + 2e6 > ymin")
def clip_polygons(spark, sf):
    x, y = F.col("lon") * 40000, F.col("lat") * 80000
    ring = F.array(vertex(x, y), vertex(x + 3e6, y), vertex(x + 3e6, y + 2e6), vertex(x, y + 2e6), vertex(x, y))
    rows = shapes_of(spark, sf, "Polygon", F.array(F.array(ring)), 3857, **_TILE)
    return geojson.prepared(rows, ExportOptions(buffer_extents=64)).select(F.col("ordinal").alias("c_custkey"), *(rounded(F.col(f"bbox.{n}"), n, 3) for n in ("xmin", "ymin", "xmax", "ymax")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 21 END AS vertices FROM customer")
def simplify_lines(spark, sf):
    height = F.when(F.col("c_custkey") % 2 == 0, 1.0).otherwise(100.0)
    wave = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: vertex(i * 1000, (i % 2) * height))
    rows = shapes_of(spark, sf, "LineString", F.array(F.array(wave)), 3857)
    return geojson.prepared(rows, ExportOptions(simplify_meters=10.0)).select(F.col("ordinal").alias("c_custkey"), F.size(F.flatten(F.flatten("parts"))).alias("vertices"))


@query(f"""SELECT c_custkey FROM (SELECT *, {_X} AS mx, {_Y} AS my, 40075016.68557849 / 2 AS u FROM {sql_points()})
WHERE mx BETWEEN -20037508.342789244 + u - u / 4 AND 20037508.342789244 + u / 4 AND my BETWEEN -u / 4 AND 20037508.342789244 + u / 4""")
def buffered_tile(spark, sf):
    rows = restructure.reprojected(points(spark, sf), 3857).withColumns({"z": F.lit(1), "x": F.lit(1), "y": F.lit(0)})
    got = mvt.decode(mvt.encode(rows, ExportOptions(buffer_extents=1024)).withColumn("source", F.lit("memory")), 0)
    return got.select(F.col("fid").cast("bigint").alias("c_custkey"))


@query("SELECT c_custkey, c_name AS name, c_acctbal AS balance, c_acctbal > 0 AS solvent, c_nationkey::BIGINT AS nation FROM customer")
def tile_properties(spark, sf):
    named = table(spark, sf, "customer").select(F.col("c_custkey").alias("ordinal"), F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), (F.col("c_acctbal") > 0).alias("solvent"), F.col("c_nationkey").alias("nation"))).alias("more"))
    rows = tiled(spark, sf, 2).join(named, "ordinal").withColumn("props_json", F.col("more")).drop("more")
    got = mvt.decode(mvt.encode(rows).withColumn("source", F.lit("memory")), 0)
    kinds = {"name": "string", "balance": "double", "solvent": "boolean", "nation": "bigint"}
    return got.select(F.col("fid").cast("bigint").alias("c_custkey"), *(F.try_variant_get("properties", f"$.{n}", k).alias(n) for n, k in kinds.items()))


@query(f"SELECT tx AS x, ty AS y, count(*) AS features FROM (SELECT {_TX.format(z=2)} AS tx, {_TY.format(z=2)} AS ty FROM {sql_points()}) GROUP BY 1, 2")
def gzip_tile(spark, sf):
    blobs = mvt.encode(tiled(spark, sf, 2), ExportOptions(compression=9)).where(F.substring("data", 1, 2) == F.lit(geojson.ZIPPED))
    return mvt.decode(blobs.withColumn("source", F.lit("memory")), 0).groupBy("x", "y").agg(F.count(F.lit(1)).alias("features"))


@query(f"""SELECT c_custkey, max(z) AS z FROM (SELECT c_custkey, z, floor((lon + 180) / 360 * pow(2, z)) AS x0, floor((lon + 180.7) / 360 * pow(2, z)) AS x1,
floor((1 - asinh(tan(radians(greatest(lat / 2, -85.0511287798066)))) / pi()) / 2 * pow(2, z)) AS y0, floor((1 - asinh(tan(radians(lat / 2 + 0.3))) / pi()) / 2 * pow(2, z)) AS y1
FROM {sql_points()}, (SELECT unnest(range(15))::INT AS z)) WHERE z = 0 OR (least(x0, pow(2, z) - 1) = least(x1, pow(2, z) - 1) AND y0 = y1) GROUP BY 1""")
def least_tile(spark, sf):
    x, y = xy()
    y = y / 2
    at = geo.least_tile(x, y, None, y + 0.3, width=0.7)
    return points(spark, sf).select(F.col("ordinal").alias("c_custkey"), at["z"].alias("z"))
