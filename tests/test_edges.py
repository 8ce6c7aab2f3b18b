"""Places that lie on edges of tiles: queries against their SQL, and the encoder alone."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cartolith.functions import geo
from cartolith.sources import tiles

SF = "/root/testdata/sf0.001"


def against_sql(spark, tmp_path, name, keys):
    """Query and SQL over customers of these keys."""
    keyed = spark.createDataFrame([(k,) for k in keys], "c_custkey long")
    rows = spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey = 1").drop("c_custkey").crossJoin(keyed)
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    wanted = con.execute(entry.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.execute(entry.oracle_sql()[name]).description]
    return sorted(tuple(r) for r in got.select(*columns).collect()), sorted(wanted)


def test_points_on_edges_are_encoded(spark, tmp_path):
    got, wanted = against_sql(spark, tmp_path, "mvt_roundtrip", [1, 2250, 4500, 6750, 13500, 20250])
    assert got == wanted and len(got) == 6


def test_points_on_edges_of_any_tile_are_in_the_tile_of_their_place():
    for z in range(15):
        n = 1 << z
        for i in {0, 1, n // 3, n // 2, n - 2, n - 1} & set(range(n)):
            lon, lat = i / n * 360 - 180, geo.unproject(0, geo.HALF - i * geo.WORLD / n)[1]
            for x, y in ((lon, 10.0), (10.0, lat)):
                tile = z, *geo.tile_at(x, y, z)
                row = {"layer": "a", "ordinal": 0, "fid": None, "fid_text": "p", "srid": 4326, "geom_type": "Point", "parts": [[[{"x": x, "y": y}]]], "layer_extent": 4096, "props_json": "{}"}
                assert len(list(tiles.decode_tile(tiles.encode_tile([row], *tile, tiles.ExportOptions()), "s", *tile, 0))) == 1, (tile, x, y)
    # A line that ends on the edge from outside has no length inside.
    assert tiles.clipped("LineString", [[tiles.np.array([(-10.0, 10.0), (0.0, 10.0)])]], 1, 1, 0, 4326, 0) is None


def test_points_on_edges_are_counted(spark, tmp_path):
    got, wanted = against_sql(spark, tmp_path, "wire_counts", [1, 2250, 4500, 6750, 13500, 20250])
    assert got == wanted and sum(r[5] for r in got) == 6


def test_points_of_all_keys_are_counted(spark, tmp_path):
    # A key's longitude repeats after 36000 keys, its latitude after 17000, and a point is clipped by each alone: no key from 0 has other ones.
    got, wanted = against_sql(spark, tmp_path, "wire_counts", range(36000))
    assert got == wanted and sum(r[5] for r in got) == 36000


def test_boxes_that_end_at_edges(spark, tmp_path):
    # 3220, 5470 and 7720 end short of an edge, once rounded; the others at one.
    got, wanted = against_sql(spark, tmp_path, "least_tile", [1, 970, 3220, 5470, 7720, 9970, 12220])
    assert got == wanted and dict(got)[3220] == 9


def test_many_points_against_shapes_of_all_kinds(spark):
    import numpy as np

    from cartolith import schema
    from cartolith.functions import shapes
    from cartolith.operators import select

    def ring(x, y, *corners):
        return [{"x": float(x + a), "y": float(y + b)} for a, b in corners]

    rng, rows = np.random.default_rng(5), []
    square, hole = ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ((1, 1), (3, 1), (3, 3), (1, 3), (1, 1))
    for i, (x, y) in enumerate(rng.uniform(-9, 9, (120, 2)).round(2)):
        walk = np.cumsum(rng.uniform(-1, 1, (12, 2)), 0)
        kind, parts = [
            ("Point", [[ring(x, y, (0, 0))]]), ("LineString", [[ring(x, y, (0, 0), (3, 0), (3, 4))]]), ("LineString", [[ring(x, y, *walk)]]), ("LineString", [[ring(x, y, (0, 0))]]),
            ("Polygon", [[ring(x, y, *square)]]), ("Polygon", [[ring(x, y, *square), ring(x, y, *hole)]]), ("MultiPolygon", [[ring(x, y, *square)], [ring(x + 6, y, *square)]]),
            ("MultiLineString", [[ring(x, y, (0, 0), (2, 5))], [ring(x, y, (1, 0), (3, 5))]]), ("MultiPoint", [[ring(x, y, (0, 0))], [ring(x, y, (5, 5))]]), ("MultiPoint", [[ring(x, y, (0, 0), (5, 5))]]),
        ][i % 10]
        rows.append((i, kind, parts))
    df = spark.createDataFrame(rows, f"k long, kind string, p {schema.PARTS}")
    df = schema.features(df, srid=4326, layer=F.lit("l"), ordinal=F.col("k"), fid_text=F.col("k").cast("string"), geom_type=F.col("kind"), parts=F.col("p"), bbox=schema.bbox_of(F.col("p")), props_json=F.lit("{}"))
    asked = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-9, 9, (60, 2)).round(2))]
    found = select.around_many(df, spark.createDataFrame(asked, "point_idx int, px double, py double"), 30_000)
    wanted = {(i, str(k)) for i, x, y in asked for k, kind, parts in rows if shapes.meets_box(kind, tiles.from_parts(parts), geo.point_box(x, y, 30_000, 4326))}
    got = [(r.point_idx, r.fid_text) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 60
    # Pairs are made by a join that shuffles both sides, and folds over shapes are no part of it.
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line and "cx" in line]
    assert joins and all("SortMergeJoin" in line and "lambda" not in line for line in joins)
