"""Profiles: counts by geometry class, property presence, value histograms and their pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = {"point_features": ("Point", "MultiPoint"), "line_features": ("LineString", "MultiLineString"), "polygon_features": ("Polygon", "MultiPolygon")}
MOST_COLUMNS = 10_000
WIRE = {"point_features": 1, "line_features": 2, "polygon_features": 3}


def layer_counts(features: DataFrame) -> DataFrame:
    """layer, counts by class, unknown, features; version is null as rows may come from anywhere. Partial sums first; sorted by name."""
    known = [t for ts in CLASSES.values() for t in ts]
    counts = [F.count_if(F.col("geom_type").isin(*ts)).alias(n) for n, ts in CLASSES.items()]
    other = F.count_if(~F.coalesce(F.col("geom_type").isin(*known), F.lit(False))).alias("unknown_features")
    return features.groupBy("layer").agg(*counts, other, F.count(F.lit(1)).alias("features"), F.lit(None).cast("int").alias("version")).orderBy("layer")


def wire_counts(profile: DataFrame) -> DataFrame:
    """The same of ``mvt.wire_profile`` rows: wire types, and the version; nothing is left out."""
    counts = [F.count_if(F.col("wire_type") == t).alias(n) for n, t in WIRE.items()]
    other = F.count_if(F.col("wire_type").isNotNull() & ~F.col("wire_type").isin(1, 2, 3)).alias("unknown_features")
    return profile.groupBy("layer").agg(*counts, other, F.count("wire_type").alias("features"), F.max("layer_version").alias("version")).orderBy("layer")


def entries(features: DataFrame, properties: Column | str = "properties") -> DataFrame:
    """layer, key, value_text: a row for each top-level property; only these leave the row."""
    bag = (F.col(properties) if isinstance(properties, str) else properties).try_cast("map<string,variant>")
    each = features.select("layer", F.explode(bag).alias("key", "value"))
    return each.select("layer", "key", F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value")).alias("value_text"))


def property_presence(features: DataFrame) -> DataFrame:
    return entries(features).groupBy("layer", "key").agg(F.count(F.lit(1)).alias("n"))


def property_histogram(features: DataFrame, keys: list[str] | None = None) -> DataFrame:
    rows = entries(features)
    rows = rows if keys is None else rows.where(F.col("key").isin(keys))
    return rows.groupBy("layer", "key", "value_text").agg(F.count(F.lit(1)).alias("n"))


def _column_names(rows: DataFrame, column: str) -> list[str]:
    """Distinct texts, which are to be column names: ``MOST_COLUMNS`` at most come to the driver, more are an error."""
    found = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} columns; property_presence and property_histogram have them as rows")
    return sorted(found)


def property_table(features: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A row for each layer, a column for each key (sorted), 0 where there is none."""
    counted = property_presence(features)
    names = sorted(keys) if keys is not None else _column_names(counted, "key")
    return counted.groupBy("layer").pivot("key", names).sum("n").na.fill(0).orderBy("layer")


def value_table(features: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """A row for each key, a column for each value (sorted), summed over layers."""
    counted = property_histogram(features, keys)
    names = sorted(values) if values is not None else _column_names(counted, "value_text")
    return counted.groupBy("key").pivot("value_text", names).sum("n").na.fill(0).orderBy("key")


def layer_bounds(features: DataFrame) -> DataFrame:
    low = [F.min(f"bbox.{n}").alias(n) for n in ("xmin", "ymin")]
    return features.groupBy("layer").agg(*low, *(F.max(f"bbox.{n}").alias(n) for n in ("xmax", "ymax")))


def layers(features: DataFrame) -> DataFrame:
    return features.select("layer").distinct()


def has_layer(features: DataFrame, name: str) -> bool:
    return not features.where(F.col("layer") == name).isEmpty()


def describe(features: DataFrame) -> str:
    """One line for each layer."""
    return "\n".join(f"{r.layer}: {r['count']} features" for r in features.groupBy("layer").count().orderBy("layer").toLocalIterator())


def tables(text: str | None, wanted: str | None = None) -> tuple[set[str], list[str]]:
    """Of ``features,properties,property=k``: (tables, keys); what isn't one of these is ignored. A wanted key overrides."""
    named: set[str] = set()
    keys: list[str] = []
    for item in (text or "features").split(","):
        name, _, key = item.strip().partition("=")
        if name in ("features", "properties"):
            named.add(name)
        elif name == "property" and key:
            named.add("property")
            keys.append(key)
    return ({"property"}, [wanted]) if wanted else (named, sorted(set(keys)))


def text_table(df: DataFrame) -> str:
    """Padded columns."""
    rows = [list(df.columns), *([str(v) if v is not None else "" for v in r] for r in df.toLocalIterator())]
    widths = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    return "\n".join(" | ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows)
