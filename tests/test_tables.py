import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from cartolith import cli, schema
from cartolith.functions import geo, values
from cartolith.operators import profile, restructure, select
from cartolith.queries import points, tiled
from cartolith.sources import geojson, mvt
from cartolith.sources.tiles import ExportOptions

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted((r.layer, r.fid_text) for r in df.collect())


def test_files_round_trip_and_push_down(spark, tmp_path):
    df = tiled(spark, SF, 2)
    out = f"file://{tmp_path}/t"
    mvt.write(df, out)
    assert ids(mvt.read(spark, out)) == ids(df)
    assert ids(mvt.read(spark, out, layers=["BUILDING"])) == ids(df.where("layer = 'BUILDING'"))
    mvt.register(spark)
    source = spark.read.format("mvt").option("path", out).option("srid", "4326").load()
    assert ids(source.where("layer IN ('BUILDING', 'MACHINERY')")) == ids(df.where("layer IN ('BUILDING', 'MACHINERY')"))
    with pytest.raises(Exception, match="FileExists|exist"):
        mvt.write(df, out)
    mvt.write(df, out, mode="append")
    assert mvt.read(spark, out).count() == 2 * df.count()
    mvt.write(df, out, mode="overwrite")
    assert mvt.read(spark, out).count() == df.count()


def test_gzip_is_smaller_and_bad_bytes_give_nothing(spark):
    df = tiled(spark, SF, 0)
    plain, packed = (mvt.encode(df, ExportOptions(compression=c)).first().data for c in (None, 9))
    assert len(packed) < len(plain)
    bad = spark.createDataFrame([("s", 0, 0, 0, bytearray(b"\x99nonsense"))], "source string, z int, x int, y int, data binary")
    assert mvt.decode(bad).count() == 0
    assert mvt.empty(spark).count() == 0


@pytest.mark.parametrize("mode", ["error", "append", "overwrite"])
def test_a_task_may_run_twice(tmp_path, mode):
    import pyarrow as pa

    from cartolith.sources import tiles, wire

    def tile(name):
        return wire.write_tile([wire.WireLayer(name, 2, 4096, raw_features=[wire.write_feature(wire.WireFeature(1, [], wire.POINT, [9, 50, 34]))])])

    def rows(name, *at):
        return pa.RecordBatch.from_pylist([{"z": 0, "x": x, "y": 0, "data": tile(name)} for x in at])

    options = {"path": f"file://{tmp_path}/t", "exists": mode}
    if mode != "error":
        first = mvt.MvtWriter(options, False)
        first.commit([first.write(iter([rows("old", 0, 2)]))])
    writer = mvt.MvtWriter(options, mode == "overwrite")
    writer.write(iter([rows("new", 0)]))  # this attempt is lost
    writer.commit([writer.write(iter([rows("new", 0)])), None])
    found = {f: [wire.layer_name(x) for x in wire.raw_layers(open(f, "rb").read())] for f in sorted(glob.glob(f"{tmp_path}/t/**/*.mvt", recursive=True))}
    names = [["new"]] if mode in ("error", "overwrite") else [["new", "old"], ["old"]]
    assert [sorted(x) for x in found.values()] == names
    assert not glob.glob(f"{tmp_path}/t/_staging*")
    if mode == "error":
        again = mvt.MvtWriter(options, False)
        with pytest.raises(FileExistsError):
            again.write(iter([rows("new", 0)]))
        again.abort([])
    assert list(tiles.decode_tile(tile("a"), "s", 0, 0, 0, 0))


def test_what_cannot_be_read_is_told(spark, tmp_path, capsys):
    from cartolith.sources import wire

    old = wire.write_tile([wire.WireLayer("old", 1, 4096)])
    for name, data in (("0_0_0.mvt", b"\x99nonsense"), ("1_0_0.mvt", old), ("noname.mvt", old), ("a.geojson", b"\n\t {no json"), ("b.geojson", b' \n{"type":"Point","coordinates":[1,2]}')):
        (tmp_path / name).write_bytes(data)
    paths = [f"file://{tmp_path}/{n}" for n in ("0_0_0.mvt", "1_0_0.mvt", "noname.mvt", "a.geojson", "b.geojson")]
    told = {r.source.rpartition("/")[2]: r.problem for r in geojson.unreadable(spark, paths).collect()}
    assert told.keys() == {"0_0_0.mvt", "1_0_0.mvt", "noname.mvt", "a.geojson"} and told["1_0_0.mvt"] == "layer old: version 1, extent 4096"
    assert [r.geom_type for r in geojson.read_auto(spark, paths).collect()] == ["Point"]
    mvt.register(spark)
    bad = spark.read.format("mvt").option("path", paths[0])
    assert bad.load().count() == 0
    with pytest.raises(Exception, match="wire type|ValueError|varint|over the end"):
        bad.option("unreadable", "fail").load().count()
    cli.run(["export", "-v", "-o", str(tmp_path / "e.json"), str(tmp_path / "0_0_0.mvt")], spark)
    assert "no tile" in capsys.readouterr().err


def test_steps_beyond_32_bits_leave_one_feature_out(spark):
    far = [[[{"x": 0.0, "y": 0.0}, {"x": 4e9, "y": 0.0}]]]
    from cartolith.sources import tiles

    row = {"layer": "a", "ordinal": 0, "fid": None, "fid_text": "far", "srid": 0, "geom_type": "LineString", "parts": far, "layer_extent": 4096, "props_json": "{}"}
    lost = []
    data = tiles.encode_tile([row, {**row, "fid_text": "near", "ordinal": 1, "parts": [[[{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}]]]}], 0, 0, 0, ExportOptions(), lost)
    assert lost == ["far"] and len(list(tiles.decode_tile(data, "s", 0, 0, 0, 0))) == 1


def test_large_features_and_small_tolerances_multiply_nothing(spark):
    df = spark.createDataFrame([("1", 0.0, 0.0, 4.0, 4.0), ("2", 1.0, 1.0, 1.0001, 1.0001)], "fid_text string, a double, b double, c double, d double")
    corners = [F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ("ab", "cb", "cd", "ad", "ab")]
    df = schema.features(df.withColumn("p", F.array(F.array(F.array(*corners)))), srid=4326, layer=F.lit("l"), geom_type=F.lit("Polygon"), parts=F.col("p"), bbox=schema.bbox_of(F.col("p")), props_json=F.lit("{}"))
    size = 4 * 50 / geo.RADIUS * 180 / 3.141592653589793
    width = F.lit(size) * F.pow(F.lit(2.0), select.level_of(F.col("bbox"), size))
    assert df.select(F.max(F.size(select.cells(F.col("bbox"), width)))).first()[0] <= 4
    asked = spark.createDataFrame([(1, 1.00005, 1.00005), (2, 3.9, 3.9), (3, 5.0, 5.0), (4, 0.0, 89.99)], "point_idx int, px double, py double")
    assert sorted((r.point_idx, r.fid_text) for r in select.around_many(df, asked, 50).collect()) == [(1, "1"), (1, "2"), (2, "1")]
    assert "Python" not in select.around_many(df, asked, 50)._jdf.queryExecution().toString() and "Python" not in select.in_box(df, (0.0, 0.0, 1.0, 1.0))._jdf.queryExecution().toString()


def test_predicates_over_columns_reach_the_scan(spark):
    from cartolith.queries import QUERIES

    plan = QUERIES["pred_range_and"](spark, SF)._jdf.queryExecution().toString()
    assert "variant" not in plan.lower() and "(l_quantity" in plan and all(f"IsNotNull({c})" in plan for c in ("l_quantity", "l_discount"))


def test_geojson(spark, tmp_path):
    collection = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "id": 18446744073638380036, "geometry": {"type": "Point", "coordinates": [-120.37960052490236, 34.045263375550654, 7]}, "properties": {"rank": 3, "name:en": "x", "vt_layer": "l1", "n": None}},
            {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {"vt_layer": 5}},
            {"type": "Feature", "id": "text", "geometry": {"type": "GeometryCollection", "geometries": []}, "properties": None},
        ],
    }
    (tmp_path / "a.geojson").write_text(json.dumps(collection))
    df = geojson.read(spark, f"file://{tmp_path}/a.geojson").orderBy("ordinal")
    a, b, c = df.collect()
    assert (a.layer, int(a.fid), a.geom_type) == ("l1", 18446744073638380036, "Point") and json.loads(a.props_json) == {"rank": 3, "name:en": "x", "n": None}
    assert (b.layer, json.loads(b.props_json)) == ("Layer-0", {"vt_layer": 5}) and len(b.fid_text) == 64
    assert (c.geom_type, c.fid_text) == ("GeometryCollection", "text")
    assert profile.layer_counts(df).where("layer = 'Layer-0'").first().unknown_features == 1
    back = json.loads(geojson.document(df, extra={"rank": 9, "more": 1}))
    first = next(f for f in back["features"] if f["id"] == 18446744073638380036)
    assert first["properties"] == {"rank": 3, "name:en": "x", "n": None, "more": 1, "vt_layer": "l1"} and first["geometry"]["coordinates"] == [-120.37960052490236, 34.045263375550654]
    placed = geojson.with_tile(df.limit(1)).first()
    assert (placed.z, placed.x, placed.y) == (14, *geo.tile_at(a.parts[0][0][0].x, a.parts[0][0][0].y, 14))
    geojson.write(df, f"file://{tmp_path}/out")
    assert geojson.decode(spark.read.text(f"file://{tmp_path}/out").select(F.lit("s").alias("source"), F.col("value").alias("text"))).count() == 3


def test_selection_relations(spark):
    df = points(spark, SF).cache()
    box = (-60.0, -40.0, 90.0, 60.0)
    assert ids(select.in_box(select.clustered(df, 4), box)) == ids(select.in_box(df, box))
    asked = spark.createDataFrame([(1, 8.0, 47.0), (2, 8.5, 47.2), (3, 179.0, 80.0)], "point_idx int, px double, py double")
    every = select.around_many(df, asked, 2_000_000)
    for p in asked.collect():
        assert sorted((r.layer, r.fid_text) for r in every.where(F.col("point_idx") == p.point_idx).collect()) == ids(select.around(df, p.px, p.py, 2_000_000))
    once = select.around_many(df, asked, 2_000_000, include_duplicates=False).collect()
    assert len({(r.layer, r.fid_text) for r in once}) == len(once) == every.select("layer", "fid_text").distinct().count()
    assert select.query(df, "near(47,8,3000000)", layer="BUILDING", keep=F.col("ordinal") > 5).count() <= select.query(df, "near(47,8,3000000)").count()
    df.unpersist()


def test_polygons_are_tested_exactly(spark):
    ring = [{"x": x, "y": y} for x, y in ((0, 0), (10, 0), (0, 10), (0, 0))]
    rows = spark.createDataFrame([([[[(p["x"], p["y"]) for p in ring]]],)], "parts array<array<array<struct<x:int,y:int>>>>")
    df = schema.features(rows, srid=4326, layer=F.lit("a"), geom_type=F.lit("Polygon"), bbox=schema.bbox_of(F.col("parts")), props_json=F.lit("{}")).withColumn("fid_text", F.lit("1"))
    assert select.in_box(df, (8.0, 8.0, 9.0, 9.0)).count() == 0
    assert select.in_box(df, (1.0, 1.0, 2.0, 2.0)).count() == 1
    assert select.with_centroid(df).select("centroid.x").first()[0] == pytest.approx(10 / 3)


def test_restructure(spark):
    df = tiled(spark, SF, 0)
    other = df.withColumn("z", F.lit(1))
    with pytest.raises(ValueError, match="different"):
        restructure.merge(df, other)
    assert restructure.merge(df, other, ignore_tile=True).count() == 2 * df.count()
    there = restructure.reprojected(restructure.reprojected(df, 3857), 4326)
    a, b = (x.orderBy("ordinal").first().parts[0][0][0] for x in (df, there))
    assert (a.x, a.y) == pytest.approx((b.x, b.y), abs=1e-9)
    assert restructure.choose_layers(df, ["BUILDING"], ["BUILDING"]).count() == 0
    assert restructure.allowed_layers([], ["a"]) == (None, {"a"})
    new = restructure.add_geojson(df, df.withColumn("layer", F.lit(None).cast("string")), replace=True, layer_name="BUILDING")
    assert new.where("layer = 'BUILDING'").count() == df.count()
    assert profile.has_layer(df, "BUILDING") and not profile.has_layer(df, "none") and "features" in profile.describe(df)
    assert profile.tables("features,properties,property=a,junk") == ({"features", "properties", "property"}, ["a"])
    assert profile.tables(None, "k") == ({"property"}, ["k"])


def test_pivots_of_too_many_columns_are_refused(spark, monkeypatch):
    from cartolith.queries import order_features

    monkeypatch.setattr(profile, "MOST_COLUMNS", 2)
    assert profile.property_table(order_features(spark, SF)).columns == ["layer", "priority", "rest"]
    with pytest.raises(ValueError, match="columns"):
        profile.value_table(order_features(spark, SF), ["rest"])


def test_value_functions(spark):
    row = spark.range(1).select(
        values.pairs(F.array(*map(F.lit, (1, 2, 3)))), values.pairs(F.array().cast("array<int>")), values.unique(F.array(F.lit(1), F.lit(1))), values.appended(F.array(F.lit(1)), F.lit(None).cast("int")),
        values.filled(F.array().cast("array<int>")), values.groups_of(F.lit("a1b2"), "([a-z])([0-9])", 2), values.trimmed(F.lit("  x\n")), values.asked_point(F.lit("-1.5,2,3.2")), values.asked_point(F.lit("95,2,3")), values.regex_find(F.lit("x"), "("),
    ).first()
    assert [tuple(p) for p in row[0]] == [(1, 2)] and row[1] == [] and row[2] == [1] and row[3] == [1] and row[4] is None
    assert row[5] == ["a", "1", "b", "2"] and row[6] == "x" and tuple(row[7]) == (-1.5, 2.0, 3.0) and row[8] is None and row[9] is False


def test_command_line(spark, tmp_path, capsys):
    data = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [8.0, 47.0]}, "properties": {"vt_layer": n, "rank": i}} for i, n in enumerate(("a", "a", "b"))]}
    src, tile = tmp_path / "in.geojson", tmp_path / "0" / "0" / "0.mvt"
    src.write_text(json.dumps(data))
    os.makedirs(tile.parent)
    cli.run(["import", "-o", str(tile), str(src)], spark)
    with pytest.raises(SystemExit):
        cli.run(["import", "-o", str(tile), str(src)], spark)
    capsys.readouterr()
    cli.run(["info", "-i", "features,properties,property=rank", str(tile)], spark)
    shown = capsys.readouterr().out
    assert "point_features" in shown and "rank" in shown
    cli.run(["query", str(tile), ".rank", ">=", "1"], spark)
    assert len(json.loads(capsys.readouterr().out)["features"]) == 2
    cli.run(["query", str(tile), "47,8,9000"], spark)
    assert len(json.loads(capsys.readouterr().out)["features"]) == 3
    cli.run([str(tile), "-l", "b"], spark)
    assert len(json.loads(capsys.readouterr().out)["features"]) == 1
    both = tmp_path / "merged.geojson"
    cli.run(["merge", "-o", str(both), "-O", "geojson", str(tile), str(src)], spark)
    assert len(json.loads(both.read_text())["features"]) == 6
    cli.run(["export", "-o", str(tmp_path / "e.geojson"), "-d", "a", "-p", str(tile)], spark)
    assert len(json.loads((tmp_path / "e.geojson").read_text())["features"]) == 1


def test_stream(spark, tmp_path):
    from cartolith.streaming import tiles as stream

    out = f"{tmp_path}/t"
    mvt.write(tiled(spark, SF, 1), f"file://{out}")
    assert glob.glob(f"{out}/1/*/*.mvt")
    df = stream.query_stream(stream.read_stream(spark, f"file://{out}"), ".nation < 10")
    q = df.select("layer", "fid_text").writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == select.query(tiled(spark, SF, 1), ".nation < 10").count()


def test_addresses(spark, tmp_path):
    import functools
    import http.server
    import threading

    mvt.write(tiled(spark, SF, 0), f"file://{tmp_path}/t")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{server.server_address[1]}"
        got = mvt.read(spark, [f"{at}/t/0/0/0.mvt", f"{at}/none/0/0/0.mvt"])
        assert got.count() == tiled(spark, SF, 0).count()
        server.shutdown()
