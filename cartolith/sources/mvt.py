"""Vector tiles as a Spark source and sink.

Files are listed and read by Spark (``binaryFile``), so any store it knows will do and small files share a task; bytes become
feature rows in one Arrow pass without a shuffle. Writing groups rows by tile, the only shuffle, and encodes each tile in a
task. ``register`` adds the format ``mvt`` for ``spark.read`` and ``df.write``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from cartolith import schema
from cartolith.sources import tiles

ROWS = 512
#: What reading bytes that are no tile, or not all of one, can raise.
UNREADABLE = (ValueError, IndexError, TypeError, OverflowError)
_PARTS_TYPE = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
_BOX_TYPE = pa.struct([(n, pa.float64()) for n in ("xmin", "ymin", "xmax", "ymax")])
_TYPES = {"z": pa.int32(), "x": pa.int32(), "y": pa.int32(), "srid": pa.int32(), "layer_version": pa.int32(), "layer_extent": pa.int32(), "ordinal": pa.int64(), "fid": pa.decimal128(20, 0), "parts": _PARTS_TYPE, "bbox": _BOX_TYPE}
ARROW = pa.schema([(n.split()[0], _TYPES.get(n.split()[0], pa.string())) for n in ("source", "origin", "z", "x", "y", "srid", "layer", "layer_version", "layer_extent", "ordinal", "fid", "fid_text", "geom_type", "parts", "bbox", "props_json")])
PROFILE = pa.schema([("source", pa.string()), ("layer", pa.string()), ("layer_version", pa.int32()), ("ordinal", pa.int64()), ("wire_type", pa.int32()), ("props_json", pa.string())])


def tile_of_path(path: Column) -> Column:
    """Struct z, x, y from ``/z/x/y/`` or ``/z/x/y.`` in a path, else from ``z_x_y``; nulls without either."""
    slashed, joined = r"/(\d+)/(\d+)/(\d+)(?:[/.])", r"(\d+)_(\d+)_(\d+)"

    def part(i: int) -> Column:
        return F.when(path.rlike(slashed), F.regexp_extract(path, slashed, i)).when(path.rlike(joined), F.regexp_extract(path, joined, i)).cast("int")

    return F.struct(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"))


def tile_in(path: str) -> tuple[int, int, int] | None:
    m = re.search(r"/(\d+)/(\d+)/(\d+)(?=[/.])", path) or re.search(r"(\d+)_(\d+)_(\d+)", path)
    return tuple(map(int, m.groups())) if m else None


def _batches(rows: Iterator[dict], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, kind)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, kind)


def decode(blobs: DataFrame, srid: int = 4326, layers: list[str] | None = None) -> DataFrame:
    """Features of rows (source, z, x, y, data). Layers that aren't asked for aren't decoded; bytes that are no tile give nothing."""
    wanted = None if layers is None else set(layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                try:
                    found = list(tiles.decode_tile(row["data"], row["source"], row["z"], row["x"], row["y"], srid, wanted))
                except UNREADABLE:
                    continue
                yield from _batches(iter(found), ARROW)

    return schema.with_properties(blobs.select("source", "z", "x", "y", "data").mapInArrow(run, schema.raw_type()))


def geometries(rows: DataFrame, commands_col: str = "commands", type_col: str = "type") -> DataFrame:
    """The rows with geom_type and parts, in tile units, in place of a command stream and a wire type; both null where nothing is drawn."""
    from cartolith.sources import commands

    others = [c for c in rows.columns if c not in (commands_col, type_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            streams, kinds = (b.column(b.schema.get_field_index(n)).to_pylist() for n in (commands_col, type_col))
            got = [commands.read_geometry(c or [], k) or (None, None) for c, k in zip(streams, kinds)]
            parts = pa.array([p and tiles.as_parts(p) for _, p in got], _PARTS_TYPE)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in others), pa.array([k for k, _ in got], pa.string()), parts], [*others, "geom_type", "parts"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in others)
    return rows.mapInArrow(run, f"{kind}, geom_type string, parts {schema.PARTS}")


def unreadable(blobs: DataFrame, srid: int = 4326) -> DataFrame:
    """source, problem: what ``decode`` gives nothing for because it can't be read, and layers that it leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[str, str]] = []
            for row in b.to_pylist():
                if row["data"] is None:
                    found.append((row["source"], "can't be got"))
                    continue
                if row["z"] is None:
                    found.append((row["source"], "no tile in its name"))
                    continue
                try:
                    for _ in tiles.decode_tile(row["data"], row["source"], row["z"], row["x"], row["y"], srid):
                        pass
                    found += [(row["source"], text) for text in tiles.left_out(row["data"])]
                except UNREADABLE as e:
                    found.append((row["source"], f"no tile: {e}"))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found)], ["source", "problem"])

    return blobs.select("source", "z", "x", "y", "data").mapInArrow(run, "source string, problem string")


def wire_profile(blobs: DataFrame) -> DataFrame:
    """source, layer, layer_version, ordinal, wire_type, props_json: a row for each wire feature; empty layers give one without a type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                try:
                    found = list(tiles.wire_profile(row["data"], row["source"]))
                except UNREADABLE:
                    continue
                yield from _batches(iter(found), PROFILE)

    return blobs.select("source", "data").mapInArrow(run, "source string, layer string, layer_version int, ordinal long, wire_type int, props_json string")


def layer_names(blobs: DataFrame) -> DataFrame:
    """source, layer: every layer's name in its place, repeated and unknown versions too; nothing else is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cartolith.sources import wire

        for b in batches:
            for row in b.to_pylist():
                try:
                    names = [wire.layer_name(x) for x in wire.raw_layers(tiles.unzipped(row["data"]))]
                except UNREADABLE:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([row["source"]] * len(names), pa.string()), pa.array(names, pa.string())], ["source", "layer"])

    return blobs.select("source", "data").mapInArrow(run, "source string, layer string")


def fetched(spark: SparkSession, urls: list[str], timeout: float = 60) -> DataFrame:
    """path, content of addresses, got by the executors; null where that fails, which ``unreadable`` tells and readers skip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import urllib.error
        import urllib.request

        for b in batches:
            for url in b.column(0).to_pylist():
                try:
                    with urllib.request.urlopen(url, timeout=timeout) as f:
                        data = f.read()
                except (urllib.error.URLError, OSError):
                    data = None
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([data], pa.binary())], ["path", "content"])

    rows = spark.createDataFrame([(u,) for u in urls], "path string")
    return rows.repartition(max(1, len(urls) // 8)).mapInArrow(run, "path string, content binary")


def files(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """path, content: files of any store that Spark knows, and addresses that begin with ``http``."""
    own = [paths] if isinstance(paths, str) else list(paths)
    urls, stored = [p for p in own if p.startswith("http")], [p for p in own if not p.startswith("http")]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = [reader.load(stored).select("path", "content")] if stored else []
    found += [fetched(spark, urls)] if urls else []
    return found[0] if len(found) == 1 else found[0].unionAll(found[1])


def blobs(spark: SparkSession, paths: str | list[str], tile: tuple[int, int, int] | None = None, pattern: str | None = None) -> DataFrame:
    """source, z, x, y, data of files; the tile from the path unless given."""
    df = files(spark, paths, pattern)
    at = F.struct(*(F.lit(v).alias(n) for n, v in zip("zxy", tile))) if tile else tile_of_path(F.col("path"))
    return df.select(F.col("path").alias("source"), at.alias("at"), F.col("content").alias("data")).select("source", "at.z", "at.x", "at.y", "data")


def read(spark: SparkSession, paths: str | list[str], srid: int = 4326, layers: list[str] | None = None, tile: tuple[int, int, int] | None = None, pattern: str | None = None) -> DataFrame:
    return decode(blobs(spark, paths, tile, pattern), srid, layers)


def empty(spark: SparkSession) -> DataFrame:
    return schema.with_properties(spark.createDataFrame([], schema.raw_type()))


def encode(features: DataFrame, options: tiles.ExportOptions = tiles.ExportOptions()) -> DataFrame:
    """z, x, y, data, left_out: rows grouped by tile, which is as much as a task ever holds. ``left_out``: ids of features with steps beyond 32 bits, which
    the format can't hold."""
    kept = features.select("z", "x", "y", "srid", "layer", "layer_extent", "ordinal", "fid", "fid_text", "geom_type", "parts", "props_json")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        z, x, y = (k.as_py() for k in key)
        lost: list[str] = []
        order = pa.table({n: pc.fill_null(table[n], v) for n, v in (("layer", ""), ("ordinal", 0), ("fid_text", ""))})
        table = table.take(pc.sort_indices(order, [(n, "ascending") for n in order.column_names]))
        data = tiles.encode_tile((r for b in table.to_batches(ROWS) for r in b.to_pylist()), z, x, y, options, lost, True)
        return pa.table({"z": pa.array([z], pa.int32()), "x": pa.array([x], pa.int32()), "y": pa.array([y], pa.int32()), "data": pa.array([data], pa.binary()), "left_out": pa.array([lost], pa.list_(pa.string()))})

    return kept.groupBy("z", "x", "y").applyInArrow(run, "z int, x int, y int, data binary, left_out array<string>")


def write(features: DataFrame, path: str, options: tiles.ExportOptions = tiles.ExportOptions(), mode: str = "error") -> None:
    """One file ``path/z/x/y.mvt`` for each tile. ``append`` adds to what the tile holds, ``overwrite`` replaces the folder."""
    spark = features.sparkSession
    register(spark)
    encode(features, options).select("z", "x", "y", "data").write.format("mvt").mode("overwrite" if mode == "overwrite" else "append").option("path", path).option("exists", mode).save()


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


class MvtReader(DataSourceReader):
    """A task for each ``filesPerTask`` files; equality and IN on the layer reach the decoder. What is no tile is skipped, as in
    ``decode``, or fails the job with the option ``unreadable`` set to ``fail``; ``unreadable`` (the function) lists it."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.layers: set[str] | None = set(options["layers"].split(",")) if options.get("layers") else None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("layer",):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.layers = named if self.layers is None else self.layers & named
            yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = _filesystem(self.options["path"])
        info = fs.get_file_info(path)
        found = [path] if info.type == pa.fs.FileType.File else sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(path, recursive=True)) if f.type == pa.fs.FileType.File and not f.base_name.startswith(("_", ".")) and "/_staging-" not in f.path)
        n = int(self.options.get("filespertask", 64))
        return [_Files(found[i : i + n]) for i in range(0, len(found), n)]

    def read(self, partition: _Files):
        fs, _ = _filesystem(self.options["path"])
        given = [int(self.options[n]) for n in "zxy"] if all(n in self.options for n in "zxy") else None
        for path in partition.paths:
            at = given or tile_in(path)
            if at is not None:
                with fs.open_input_stream(path, compression=None) as f:
                    data = f.read()
                try:
                    found = list(tiles.decode_tile(data, path, *at, int(self.options.get("srid", 4326)), self.layers))
                except UNREADABLE:
                    if self.options.get("unreadable", "skip") != "skip":
                        raise
                    continue
                yield from _batches(iter(found), ARROW)


@dataclass
class Written(WriterCommitMessage):
    """(where a task's whole file lies, where it goes)."""

    files: list[tuple[str, str]]


class MvtWriter(DataSourceArrowWriter):
    """Writes rows (z, x, y, data) as files.

    Every attempt of a task writes under names of its own in a folder of the job; only at the job's commit, with one attempt of
    each task, do files go to their places, after old ones were deleted if the mode is overwrite. Until then nothing that was there changes, so a
    task that runs again reads the same tiles to append to and finds none of its own."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite, self.staging = options, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _filesystem(self.options["path"])
        done: list[tuple[str, str]] = []
        for b in batches:
            for row in b.to_pylist():
                name = f"{root}/{row['z']}/{row['x']}/{row['y']}.mvt"
                there = not self.overwrite and fs.get_file_info(name).type == pa.fs.FileType.File
                if there and self.options.get("exists") == "error":
                    raise FileExistsError(name)
                data = row["data"]
                if there and self.options.get("exists") == "append":
                    with fs.open_input_stream(name, compression=None) as f:
                        data = merged(f.read(), data)
                folder = f"{root}/{self.staging}/{uuid.uuid4().hex[:2]}"
                fs.create_dir(folder, recursive=True)
                staged = f"{folder}/{uuid.uuid4().hex}.mvt"
                with fs.open_output_stream(staged, compression=None) as f:
                    f.write(data)
                done.append((staged, name))
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _filesystem(self.options["path"])
        if self.overwrite and fs.get_file_info(root).type == pa.fs.FileType.Directory:
            for old in fs.get_file_info(pa.fs.FileSelector(root)):
                if old.base_name != self.staging:
                    (fs.delete_dir if old.type == pa.fs.FileType.Directory else fs.delete_file)(old.path)
        files = [f for m in messages if m is not None for f in m.files]
        for folder in sorted({name.rpartition("/")[0] for _, name in files}):
            fs.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: fs.move(*f), files))
        self._clean(fs, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*_filesystem(self.options["path"]))

    def _clean(self, fs: pa.fs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.staging}").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


def merged(first: bytes, second: bytes) -> bytes:
    """Two tiles' layers; features of a layer in both follow each other in one."""
    rows = [{**r, "ordinal": i} for i, r in enumerate(r for data in (first, second) for r in tiles.decode_tile(data, "", 0, 0, 0, 0))]
    return tiles.encode_tile(rows, 0, 0, 0, tiles.ExportOptions(compression=9 if second[:2] == b"\x1f\x8b" else None))


class MvtSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mvt"

    def schema(self) -> str:
        return schema.RAW

    def reader(self, schema) -> MvtReader:
        return MvtReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> MvtWriter:
        return MvtWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MvtSource)
