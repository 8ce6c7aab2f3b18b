"""Tiles to rows of features and rows of features to tiles, in Arrow workers."""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np

from cartolith.functions import geo, shapes
from cartolith.sources import commands, wire

EXTENT = 4096
UINT64 = (1 << 64) - 1
ROUNDING = geo.WORLD / (1 << 48)  # metres, about a ten-thousandth of a millimetre


@dataclass(frozen=True)
class ExportOptions:
    """How tiles are written. Buffers and simplification in tile units (of 4096) unless named otherwise."""

    buffer_extents: int = 0
    buffer_pixels: int | None = None
    simplify_extents: int | None = None
    simplify_meters: float | None = None
    compression: int | None = None  # gzip level, 0 to 9

    @property
    def buffer(self) -> int:
        return self.buffer_extents if self.buffer_pixels is None else int(self.buffer_pixels / geo.TILE_PIXELS * EXTENT)

    def tolerance(self, z: int) -> float:
        """Metres."""
        if self.simplify_extents is not None:
            return geo.WORLD / (1 << z) / EXTENT * self.simplify_extents
        return self.simplify_meters or 0.0


def unzipped(data: bytes) -> bytes:
    """Of gzipped bytes the content; what can't be unzipped as it is."""
    if data[:2] == b"\x1f\x8b":
        try:
            return gzip.decompress(data)
        except (OSError, EOFError):
            return data
    return data


def rehydrated(value: wire.Scalar) -> object:
    """A string that holds a JSON array or object becomes that."""
    if isinstance(value, str) and value[:1] in ("[", "{"):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def json_text(value: object) -> str:
    """JSON for VARIANT: non-finite numbers have no JSON form and become text."""

    def fit(x: object) -> object:
        if isinstance(x, float) and not math.isfinite(x):
            return str(x)
        if isinstance(x, dict):
            return {str(k): fit(v) for k, v in x.items()}
        return [fit(v) for v in x] if isinstance(x, list) else x

    return json.dumps(fit(value), ensure_ascii=False, separators=(",", ":"))


def to_srid(points: np.ndarray, z: int, x: int, y: int, extent: int, srid: int) -> np.ndarray:
    """Tile units to metres or degrees; y grows downwards in tiles."""
    if srid == 0:
        return points
    u = geo.WORLD / (1 << z)
    out = np.empty_like(points, dtype=np.float64)
    out[:, 0] = -geo.HALF + x * u + points[:, 0] / extent * u
    out[:, 1] = geo.HALF - y * u - points[:, 1] / extent * u
    return degrees(out) if srid == 4326 else out


def degrees(metres: np.ndarray) -> np.ndarray:
    return np.stack([np.degrees(metres[:, 0] / geo.RADIUS), np.degrees(np.arctan(np.sinh(metres[:, 1] / geo.RADIUS)))], 1)


def metres(points: np.ndarray, srid: int = 4326) -> np.ndarray:
    if srid != 4326:
        return points
    lat = np.clip(points[:, 1], -89.99, 89.99)
    return np.stack([np.radians(points[:, 0]) * geo.RADIUS, np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * geo.RADIUS], 1)


def as_parts(parts: shapes.Parts) -> list:
    return [[[{"x": float(p[0]), "y": float(p[1])} for p in ring] for ring in polygon] for polygon in parts]


def from_parts(parts: list) -> shapes.Parts:
    return [[np.array([(p["x"], p["y"]) for p in ring], np.float64).reshape(-1, 2) for ring in polygon] for polygon in parts or []]


def as_box(parts: shapes.Parts) -> dict | None:
    b = shapes.bounds(parts)
    return dict(zip(("xmin", "ymin", "xmax", "ymax"), b)) if b else None


def properties_of(f: wire.WireFeature, layer: wire.WireLayer) -> dict:
    """Pairs of places in the dictionaries; odd ends and places out of range are skipped, the last of equal keys wins."""
    return {layer.keys[k]: rehydrated(layer.values[v][1]) for k, v in zip(f.tags[::2], f.tags[1::2]) if k < len(layer.keys) and v < len(layer.values)}


def decode_tile(data: bytes, source: str, z: int, x: int, y: int, srid: int, layers: set[str] | None = None) -> Iterator[dict]:
    """Rows of the canonical schema. Of layers with one name the last counts; only version 2 with an extent is read."""
    if srid and not (z >= 0 and 0 <= x < 1 << z and 0 <= y < 1 << z):
        raise ValueError(f"no tile {z}/{x}/{y}")
    last: dict[str, bytes] = {}
    for raw in wire.raw_layers(unzipped(data)):
        name = wire.layer_name(raw)
        if layers is None or name in layers:
            last[name] = raw
    for name, raw in sorted(last.items()):
        layer = wire.read_layer(raw)
        if layer.version != 2 or not layer.extent:
            continue
        for ordinal, f in enumerate(layer.features()):
            got = commands.read_geometry(f.geometry, f.type)
            if got is None:
                continue
            kind, parts = got
            parts = [[to_srid(r, z, x, y, layer.extent, srid) for r in p] for p in parts]
            text = str(f.id) if f.id is not None else hashlib.sha256(f"{source}|{name}|{ordinal}".encode()).hexdigest()
            yield {
                "source": source, "origin": "mvt", "z": z, "x": x, "y": y, "srid": srid, "layer": name, "layer_version": layer.version, "layer_extent": layer.extent,
                "ordinal": ordinal, "fid": None if f.id is None else Decimal(f.id), "fid_text": text, "geom_type": kind, "parts": as_parts(parts), "bbox": as_box(parts),
                "props_json": json_text(properties_of(f, layer)),
            }


def left_out(data: bytes) -> list[str]:
    """Layers that ``decode_tile`` doesn't read, in words."""
    layers = [wire.read_layer(raw) for raw in wire.raw_layers(unzipped(data))]
    return [f"layer {x.name}: version {x.version}, extent {x.extent}" for x in layers if x.version != 2 or not x.extent]


def wire_profile(data: bytes, source: str) -> Iterator[dict]:
    """A row for each feature as it is on the wire: layer, version, wire type and property values; no geometry is decoded."""
    for raw in wire.raw_layers(unzipped(data)):
        layer = wire.read_layer(raw)
        for ordinal, f in enumerate(layer.features()):
            yield {"source": source, "layer": layer.name, "layer_version": layer.version, "ordinal": ordinal, "wire_type": f.type, "props_json": json_text(properties_of(f, layer))}
        if not layer.raw_features:
            yield {"source": source, "layer": layer.name, "layer_version": layer.version, "ordinal": None, "wire_type": None, "props_json": None}


def _wire_value(value: object) -> tuple[int, wire.Scalar] | None:
    if isinstance(value, bool):
        return wire.VALUE_BOOL, value
    if isinstance(value, int):
        if -(1 << 63) <= value < 1 << 63:
            return wire.VALUE_INT, value
        return (wire.VALUE_UINT, value) if 0 <= value <= UINT64 else (wire.VALUE_DOUBLE, float(value))
    if isinstance(value, float):
        return wire.VALUE_DOUBLE, value
    if isinstance(value, str):
        return wire.VALUE_STRING, value
    if isinstance(value, (list, dict)):
        return wire.VALUE_STRING, json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return None


def tile_units(points: np.ndarray, z: int, x: int, y: int, srid: int, layer_extent: int) -> np.ndarray:
    """Whole units of 4096, towards zero."""
    if srid == 0:
        return np.trunc(points * (EXTENT / layer_extent))
    m, u = metres(points, srid), geo.WORLD / (1 << z)
    return np.trunc(np.stack([((m[:, 0] + geo.HALF) / u - x) * EXTENT, ((geo.HALF - m[:, 1]) / u - y) * EXTENT], 1))


def clip_box(z: int, x: int, y: int, srid: int, buffer: int, more: float = 0.0) -> shapes.Box:
    """The tile, its diagonal longer at both ends by buffer / 4096 of its length: on each side by that share of the width, and ``more`` metres."""
    b = geo.bounds_of_tile(z, x, y, 3857)
    by = (b[2] - b[0]) * buffer / EXTENT + more
    b = (b[0] - by, b[1] - by, b[2] + by, b[3] + by)
    if srid == 3857:
        return b
    return geo.unproject(*b[:2]) + geo.unproject(*b[2:])


def clipped(kind: str, parts: shapes.Parts, z: int, x: int, y: int, srid: int, buffer: int) -> tuple[str, shapes.Parts] | None:
    """What is in the tile and its buffer. Points outside by no more than places are rounded by are inside, else those on an edge could be in no tile."""
    return shapes.clip(kind, parts, clip_box(z, x, y, srid, buffer, 0.0 if shapes.dimension(kind) else ROUNDING))


def encode_tile(rows: Iterable[dict], z: int, x: int, y: int, options: ExportOptions, lost: list[str] | None = None, in_order: bool = False) -> bytes:
    """One tile of feature rows. Without a projection nothing is clipped or simplified. Features that can't be drawn are left out; ids of
    those with steps beyond 32 bits are added to ``lost``. Rows that come in order are taken one at a time."""
    layers: dict[str, wire.WireLayer] = {}
    places: dict[str, tuple[dict, dict]] = {}
    for row in rows if in_order else sorted(rows, key=lambda r: (r["layer"] or "", r["ordinal"] or 0, r["fid_text"] or "")):
        srid, kind = row["srid"] or 0, row["geom_type"]
        number = commands.wire_type(kind) if kind else None
        if number is None:
            continue
        parts = from_parts(row["parts"])
        if srid:
            inside = clipped(kind, parts, z, x, y, srid, options.buffer)
            if inside is None:
                continue
            kind, parts = inside
            parts = shapes.simplify(kind, parts, options.tolerance(z), lambda r: metres(r, srid))
        units = [[tile_units(r, z, x, y, srid, row["layer_extent"] or EXTENT) for r in p] for p in parts]
        try:
            geometry = commands.write_geometry(kind, units)
        except OverflowError:
            if lost is not None:
                lost.append(row["fid_text"])
            continue
        if not geometry:
            continue
        name = row["layer"] or ""
        layer = layers.setdefault(name, wire.WireLayer(name, 2, EXTENT))
        keys, values = places.setdefault(name, ({}, {}))
        tags: list[int] = []
        for key, value in (json.loads(row["props_json"]) if row["props_json"] else {}).items():
            got = _wire_value(value)
            if got is not None:
                same = (got[0], struct.pack("<d", got[1]) if isinstance(got[1], float) else got[1])
                tags += [keys.setdefault(key, len(keys)), values.setdefault(same, len(values))]
                if values[same] == len(layer.values):
                    layer.values.append(got)
        fid = int(row["fid"]) if row["fid"] is not None and 0 <= row["fid"] <= UINT64 else None
        layer.raw_features.append(wire.write_feature(wire.WireFeature(fid, tags, number, geometry)))
    for name, (keys, _) in places.items():
        layers[name].keys = list(keys)
    data = wire.write_tile([layers[n] for n in sorted(layers)])
    return data if options.compression is None else gzip.compress(data, min(9, max(0, options.compression)), mtime=0)
