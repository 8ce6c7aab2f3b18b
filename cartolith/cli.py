"""Command line: dump, info, query, merge, import, export. ``python -m cartolith.cli <command> ...``"""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith import schema
from cartolith.operators import profile, restructure, select
from cartolith.sources import geojson, mvt
from cartolith.sources.tiles import ExportOptions, unzipped

POINT = re.compile(r"\s*(-?[0-9.]+),(-?[0-9.]+),([0-9.]+)\s*")


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="cartolith")
    commands = root.add_subparsers(dest="command")

    def command(name: str, *, out: str | None = None, layers: bool = True, shape: str = "", props: str = "") -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for n in "xyz":
            p.add_argument(f"-{n}", type=int)
        p.add_argument("-v", "--verbose", action="store_true")
        if out:
            p.add_argument("-o", "--output", required=out == "required")
            p.add_argument("-f", "--force-overwrite", action="store_true")
            p.add_argument("-oC", "--compression-level", type=int)
        if layers:
            p.add_argument("-l", "--layer", action="append", default=[])
            p.add_argument("-d", "--drop-layer", action="append", default=[])
        if "b" in shape:
            p.add_argument("-oBe", "--buffer-extents", type=int)
            p.add_argument("-oBp", "--buffer-pixels", type=int)
            p.add_argument("-oSe", "--simplify-extents", type=int)
            p.add_argument("-a", "--append", action="store_true")
        if "m" in shape:
            p.add_argument("-oSm", "--simplify-meters", type=float)
        if props:
            p.add_argument("-P", "--property-name", default=schema.LAYER_PROPERTY)
        if "i" in props:
            p.add_argument("-Di", "--disable-input-layer-property", action="store_true")
        if "o" in props:
            p.add_argument("-Do", "--disable-output-layer-property", action="store_true")
        if "p" in props:
            p.add_argument("-p", "--pretty-print", action="store_true")
        return p

    command("dump", shape="m", props="io").add_argument("path")
    info = command("info", layers=False)
    info.add_argument("-i", "--info-tables", default="features")
    info.add_argument("-p", "--property")
    info.add_argument("path")
    asked = command("query", out="optional", shape="m", props="iop")
    asked.add_argument("path")
    asked.add_argument("terms", nargs="+")
    merged = command("merge", out="optional", shape="bm", props="iop")
    merged.add_argument("-O", "--output-format", choices=("auto", "geojson", "mvt"), default="auto")
    merged.add_argument("paths", nargs="+")
    into = command("import", out="required", shape="bm", props="i")
    into.add_argument("-L", "--layer-name")
    into.add_argument("paths", nargs="+")
    command("export", out="required", shape="m", props="op").add_argument("path")
    return root


def _tile(args: argparse.Namespace, paths: list[str]) -> tuple[int, int, int] | None:
    """The options if all are given, else the first path that names a tile."""
    if None not in (args.x, args.y, args.z):
        at = (args.z, args.x, args.y)
    else:
        at = next((t for t in map(mvt.tile_in, paths) if t), None)
    if at and not (at[0] >= 0 and 0 <= at[1] < 1 << at[0] and 0 <= at[2] < 1 << at[0]):
        raise SystemExit(f"no tile {at[0]}/{at[1]}/{at[2]}")
    return at


def _resolved(path: str) -> str:
    if path.startswith("http") or "://" in path:
        return path
    if not os.path.exists(path):
        raise SystemExit(f"no file {path}")
    return "file://" + os.path.abspath(path)


def _read(spark: SparkSession, args: argparse.Namespace, paths: list[str]) -> DataFrame:
    prop = None if getattr(args, "disable_input_layer_property", False) else getattr(args, "property_name", schema.LAYER_PROPERTY)
    if args.verbose:
        _report(geojson.unreadable(spark, [_resolved(p) for p in paths], 4326, _tile(args, paths)))
    df = geojson.read_auto(spark, [_resolved(p) for p in paths], 4326, _tile(args, paths), layer_property=prop)
    return restructure.choose_layers(df, getattr(args, "layer", []), getattr(args, "drop_layer", []))


def _report(problems: DataFrame) -> None:
    for r in problems.toLocalIterator():
        print(f"{r.source}: {r.problem}", file=sys.stderr)


def _put(data: bytes, args: argparse.Namespace, append: bool = False) -> None:
    if not getattr(args, "output", None):
        sys.stdout.write(data.decode())
        sys.stdout.write("\n")
        return
    if os.path.exists(args.output) and not (args.force_overwrite or append):
        raise SystemExit(f"{args.output} exists; --force-overwrite replaces it")
    with open(args.output, "wb") as f:
        f.write(data)


def _options(args: argparse.Namespace, tile: bool = False) -> ExportOptions:
    extents, pixels = getattr(args, "buffer_extents", None), getattr(args, "buffer_pixels", None)
    level = getattr(args, "compression_level", None)
    if not getattr(args, "output", None):
        level = None
    return ExportOptions(
        buffer_extents=(512 if tile else 0) if extents is None else extents, buffer_pixels=pixels if extents is None else None,
        simplify_extents=getattr(args, "simplify_extents", None), simplify_meters=getattr(args, "simplify_meters", None), compression=9 if level is None and tile and getattr(args, "output", None) else level,
    )


def _document(df: DataFrame, args: argparse.Namespace, pretty: bool) -> bytes:
    prop = None if getattr(args, "disable_output_layer_property", False) else args.property_name
    return geojson.document(df, _options(args), layer_property=prop, pretty=pretty)


def _one_tile(df: DataFrame, at: tuple[int, int, int], options: ExportOptions) -> bytes:
    placed = df.withColumns({n: F.lit(v) for n, v in zip("zxy", at)})
    rows = mvt.encode(placed, options).collect()  # one tile: one row
    for fid in rows[0].left_out if rows else []:
        print(f"{fid}: steps beyond 32 bits, left out", file=sys.stderr)
    return bytes(rows[0].data) if rows else b""


def run(argv: list[str], spark: SparkSession | None = None) -> None:
    known = {"dump", "info", "query", "merge", "import", "export", "-h", "--help"}
    args = parser().parse_args(argv if argv and argv[0] in known else ["dump", *argv])
    spark = spark or SparkSession.builder.appName("cartolith").getOrCreate()
    if args.command == "dump":
        _put(_document(_read(spark, args, [args.path]), args, True), args)
    elif args.command == "info":
        wanted, keys = profile.tables(args.info_tables, args.property)
        df = _read(spark, args, [args.path])
        for name, make in (("features", lambda: profile.layer_counts(df)), ("properties", lambda: profile.property_table(df)), ("property", lambda: profile.value_table(df, keys))):
            if name in wanted:
                print(profile.text_table(make()), end="\n\n")
    elif args.command == "query":
        text = " ".join(args.terms)
        df = _read(spark, args, [args.path])
        m = POINT.fullmatch(text)
        values = [float(v) for v in m.groups()] if m and all(v.count(".") <= 1 and v.strip(".-") for v in m.groups()) else None
        if values and abs(values[0]) <= 90 and abs(values[1]) <= 180 and round(values[2]) > 0:
            df = select.around(df, values[1], values[0], round(values[2]))
        else:
            df = select.query(df, text)
        _put(_document(df, args, args.pretty_print), args)
    elif args.command == "export":
        _put(_document(_read(spark, args, [args.path]), args, args.pretty_print), args)
    elif args.command == "merge":
        paths = [*args.paths]
        existing = args.append and args.output and os.path.exists(args.output)
        first = args.output if existing else paths[0]
        with open(first, "rb") as f:
            head = unzipped(f.read())[:512].lstrip()[:1]
        kind = args.output_format if args.output_format != "auto" else "geojson" if head == b"{" else "mvt"
        if existing and (kind == "geojson") != (head == b"{") and not args.force_overwrite:
            raise SystemExit("the output has another format; --force-overwrite changes it")
        at = _tile(args, paths)
        df = _read(spark, args, ([args.output] if existing else []) + paths)
        if at is None or kind == "geojson":
            data = _document(df, args, args.pretty_print)
        else:
            data = _one_tile(df, at, _options(args, True))
        _put(data, args, args.append)
    else:
        prop = None if args.disable_input_layer_property else args.property_name
        at = _tile(args, [*args.paths, args.output])
        if at is None:
            raise SystemExit("import needs a tile: -x, -y and -z, or a path that names it")
        if args.verbose:
            _report(geojson.unreadable(spark, [_resolved(p) for p in args.paths], tile=at))
        df = geojson.read(spark, [_resolved(p) for p in args.paths], layer_property=prop, layer_name=args.layer_name)
        if args.append and os.path.exists(args.output):
            df = mvt.read(spark, _resolved(args.output), tile=at).unionByName(df)
        df = restructure.choose_layers(df, args.layer, args.drop_layer)
        _put(_one_tile(df, at, _options(args, True)), args, args.append)


if __name__ == "__main__":
    run(sys.argv[1:])
