import json

import numpy as np
import pytest

from cartolith.functions import geo, shapes
from cartolith.sources import commands, tiles, wire

# Streams and what they draw, as the tile format has them.
STREAMS = [
    ("Point", wire.POINT, [9, 50, 34], [[[(25, 17)]]]),
    ("MultiPoint", wire.POINT, [17, 10, 14, 3, 9], [[[(5, 7)]], [[(3, 2)]]]),
    ("LineString", wire.LINESTRING, [9, 4, 4, 18, 0, 16, 16, 0], [[[(2, 2), (2, 10), (10, 10)]]]),
    ("MultiLineString", wire.LINESTRING, [9, 4, 4, 18, 0, 16, 16, 0, 9, 17, 17, 10, 4, 8], [[[(2, 2), (2, 10), (10, 10)]], [[(1, 1), (3, 5)]]]),
    ("Polygon", wire.POLYGON, [9, 6, 12, 18, 10, 12, 24, 44, 15], [[[(3, 6), (8, 12), (20, 34), (3, 6)]]]),
    (
        "MultiPolygon", wire.POLYGON, [9, 0, 0, 26, 20, 0, 0, 20, 19, 0, 15, 9, 22, 2, 26, 18, 0, 0, 18, 17, 0, 15, 9, 4, 13, 26, 0, 8, 8, 0, 0, 7, 15],
        [[[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]], [[(11, 11), (20, 11), (20, 20), (11, 20), (11, 11)], [(13, 13), (13, 17), (17, 17), (17, 13), (13, 13)]]],
    ),
]


@pytest.mark.parametrize(("kind", "number", "stream", "parts"), STREAMS)
def test_command_streams(kind, number, stream, parts):
    got_kind, got = commands.read_geometry(stream, number)
    assert got_kind == kind
    assert [[[tuple(p) for p in r] for r in q] for q in got] == parts
    assert commands.write_geometry(kind, [[np.array(r) for r in q] for q in parts]) == stream


def test_streams_that_break_off():
    assert [p.tolist() for p in commands.read_paths([9, 4, 4, 18, 0, 16], wire.LINESTRING)] == [[[2, 2]]]
    assert commands.read_geometry([9, 4, 4, 18, 0, 16], wire.LINESTRING) is None
    assert commands.read_geometry([], wire.POINT) is None
    assert commands.read_geometry([9, 2, 2], 0) is None
    assert [p.tolist() for p in commands.read_paths([9, 2, 2, 12, 2, 2], wire.LINESTRING)] == [[[1, 1], [2, 2]]]  # command 4 draws


def test_zigzag_and_values():
    for n in (0, 1, -1, 5, -(1 << 31), (1 << 31) - 1):
        assert wire.unzigzag(wire.zigzag(n)) == n
    for number, value in ((1, "é"), (2, 0.5), (3, 0.1), (4, -5), (5, (1 << 64) - 1), (6, -7), (7, True)):
        assert wire.read_value(wire.write_value(number, value)) == (number, value)
    assert wire.read_value(b"") == (wire.VALUE_STRING, "")
    assert wire.read_value(wire.write_value(5, 9) + wire.write_value(4, 8)) == (4, 8)


def row(**more):
    base = {"layer": "a", "ordinal": 0, "fid": None, "fid_text": "t", "srid": 4326, "geom_type": "Point", "parts": [[[{"x": 25.0, "y": 25.0}]]], "layer_extent": None, "props_json": "{}"}
    return base | more


def test_encode_decode_point_keeps_id_and_place():
    data = tiles.encode_tile([row(fid=600, fid_text="600")], 0, 0, 0, tiles.ExportOptions())
    (got,) = tiles.decode_tile(data, "s", 0, 0, 0, 4326)
    assert int(got["fid"]) == 600
    p = got["parts"][0][0][0]
    assert abs(p["x"] - 25) < 0.1 and abs(p["y"] - 25) < 0.1


def test_full_range_ids_and_properties():
    props = {"s": "x", "i": -3, "d": 0.5, "b": True, "list": [1, "a"], "dict": {"k": 1}, "big": (1 << 64) - 1, "one": 1, "real": 1.0}
    data = tiles.encode_tile([row(fid=18446744073638380036, props_json=json.dumps(props))], 6, 10, 25, tiles.ExportOptions(buffer_extents=1 << 20))
    (got,) = tiles.decode_tile(data, "s", 6, 10, 25, 0)
    assert int(got["fid"]) == 18446744073638380036
    back = json.loads(got["props_json"])
    assert back == props and isinstance(back["one"], int) and isinstance(back["real"], float)


def test_gzip_layers_versions_and_duplicates():
    def layer(name, version=2, extent=4096):
        return wire.WireLayer(name, version, extent, ["k", "k2"], [(1, "[1,2]"), (1, "[x")], [wire.write_feature(wire.WireFeature(1, [0, 0, 1, 1, 7, 0, 1], wire.POINT, [9, 50, 34]))])

    data = wire.write_tile([layer("a"), layer("old", 1), layer("none", 2, 0), layer("a", extent=8192)])
    (got,) = tiles.decode_tile(tiles.gzip.compress(data), "s", 0, 0, 0, 0)
    assert got["layer_extent"] == 8192 and json.loads(got["props_json"]) == {"k": [1, 2], "k2": "[x"}
    assert got["fid_text"] == "1"
    assert list(tiles.decode_tile(data, "s", 0, 0, 0, 0, {"b"})) == []
    assert tiles.unzipped(b"\x1f\x8bnot") == b"\x1f\x8bnot"


def test_clip_keeps_to_the_tile_and_simplify_keeps_features():
    ring = [{"x": x, "y": y} for x, y in ((-30, -30), (60, -30), (60, 60), (-30, 60), (-30, -30))]
    wave = [{"x": float(i), "y": float(10 + (i % 2) * 0.01)} for i in range(1, 80)]
    rows = [row(geom_type="Polygon", parts=[[ring]]), row(geom_type="LineString", parts=[[wave]], ordinal=1), row(parts=[[[{"x": -50.0, "y": 10.0}]]], ordinal=2)]
    plain = list(tiles.decode_tile(tiles.encode_tile(rows, 1, 1, 0, tiles.ExportOptions()), "s", 1, 1, 0, 0))
    assert len(plain) == 2
    for r in plain:
        b = r["bbox"]
        assert b["xmin"] >= 0 and b["ymin"] >= 0 and b["xmax"] <= 4096 and b["ymax"] <= 4096
    simple = list(tiles.decode_tile(tiles.encode_tile(rows, 1, 1, 0, tiles.ExportOptions(simplify_extents=1024)), "s", 1, 1, 0, 0))
    assert len(simple) == 2 and len(simple[1]["parts"][0][0]) < len(plain[1]["parts"][0][0])
    wide = list(tiles.decode_tile(tiles.encode_tile(rows, 1, 1, 0, tiles.ExportOptions(buffer_pixels=64)), "s", 1, 1, 0, 0))
    assert min(r["bbox"]["xmin"] for r in wide) < 0


def test_unprojected_tiles_are_rescaled_only():
    (got,) = tiles.decode_tile(tiles.encode_tile([row(srid=0, layer_extent=8192, parts=[[[{"x": 9000.0, "y": 80.0}]]])], 0, 0, 0, tiles.ExportOptions()), "s", 0, 0, 0, 0)
    assert got["parts"][0][0][0] == {"x": 4500.0, "y": 40.0}


def test_mercator_constants():
    # Degrees and metres of the projection.
    for lon, lat, x, y in ((10.5, 20.5, 1168854.653329, 2332357.812619), (-180.0, 45.0, -20037508.342789, 5621521.486192), (45.0, -45.0, 5009377.085697, -5621521.486192)):
        assert geo.project(lon, lat) == pytest.approx((x, y), abs=1e-5)
        assert geo.unproject(x, y) == pytest.approx((lon, lat), abs=1e-5)


def test_tiles():
    assert geo.minimal_tile(1, 1, 2, 2, 14) == (7, 64, 63)
    assert geo.minimal_tile(-1, -1, 1, 1) == (0, 0, 0)
    assert geo.bounds_of_tile(3, 1, 1, 0) == (0, 0, 4096, 4096)
    with pytest.raises(ValueError):
        geo.bounds_of_tile(1, 2, 0, 3857)


def test_shapes():
    square = [np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)]
    assert shapes.centroid("Polygon", [square]) == pytest.approx((2, 2))
    assert shapes.centroid("LineString", [[np.array([(0, 0), (2, 0), (2, 2)], float)]]) == pytest.approx((1.5, 0.5))
    assert shapes.meets_box("Polygon", [square], (1, 1, 2, 2))
    assert not shapes.meets_box("LineString", [[np.array([(0, 0), (4, 4)], float)]], (3, 0, 4, 1))
    assert shapes.meets_box("LineString", [[np.array([(0, 0), (4, 4)], float)]], (1, 0, 2, 2))
    pieces = shapes.clip_line(np.array([(-1, 1), (5, 1), (5, 2), (-1, 2)], float), (0, 0, 4, 4))
    assert [p.tolist() for p in pieces] == [[[0, 1], [4, 1]], [[4, 2], [0, 2]]]
