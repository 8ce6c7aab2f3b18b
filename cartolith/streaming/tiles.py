"""Predicates and profiles over directories that grow: the same columns on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators.select import query
from cartolith.sources import mvt


def read_stream(spark: SparkSession, path: str, srid: int = 4326, layers: list[str] | None = None, pattern: str = "*.mvt", files_per_trigger: int = 256) -> DataFrame:
    """Features of tiles as their files arrive; the tile comes from the path."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    at = mvt.tile_of_path(F.col("path"))
    blobs = files.select(F.col("path").alias("source"), at.alias("at"), F.col("content").alias("data")).select("source", "at.z", "at.x", "at.y", "data")
    return mvt.decode(blobs, srid, layers)


def query_stream(features: DataFrame, text: str, layer: str | None = None) -> DataFrame:
    return query(features, text, layer)


def running_counts(features: DataFrame) -> DataFrame:
    """Features by layer and geometry type so far; state has a row for each pair."""
    return features.groupBy("layer", "geom_type").agg(F.count(F.lit(1)).alias("n"))
