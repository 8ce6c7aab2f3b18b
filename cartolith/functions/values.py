"""Small functions on strings, arrays and maps, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolith.plans.compile import java_pattern


def regex_find(text: Column, pattern: str) -> Column:
    """Whether the pattern, ``/pattern/`` or ``/pattern/i`` is found; a pattern that can't be compiled is never found."""
    fit = java_pattern(pattern)
    return F.lit(False) if fit is None else text.rlike(fit)


def trimmed(text: Column) -> Column:
    """Without white space and line ends at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def contains_any_case(text: Column, part: Column | str) -> Column:
    part = F.lit(part) if isinstance(part, str) else part
    return F.contains(F.lower(text), F.lower(part))


def element(array: Column, place: Column | int) -> Column:
    """Negative places count from the end; null out of range."""
    place = F.lit(place) if isinstance(place, int) else place
    return F.get(array, F.when(place < 0, F.size(array) + place).otherwise(place))


def pairs(array: Column) -> Column:
    """Structs of two neighbours each; an odd last element is left out."""
    n = F.floor(F.size(array) / 2).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.get(array, i * 2).alias("first"), F.get(array, i * 2 + 1).alias("second")))


def groups_of(text: Column, pattern: str, groups: int) -> Column:
    """All groups of all matches in a row."""
    each = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in range(1, groups + 1)]
    return F.flatten(F.transform(F.arrays_zip(*[e.alias(f"g{i}") for i, e in enumerate(each)]), lambda r: F.array(*[r[f"g{i}"] for i in range(groups)])))


def unique(array: Column) -> Column:
    return F.array_distinct(array)


def without_nulls(array: Column) -> Column:
    return F.array_compact(array)


def appended(array: Column, value: Column) -> Column:
    """With the value unless it is null."""
    return F.when(value.isNull(), array).otherwise(F.array_append(array, value))


def filled(array: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(array) > 0, array)


def has_key(map_: Column, key: str) -> Column:
    return F.map_contains_key(map_, key)


def merged_left(own: Column, other: Column) -> Column:
    """Both maps; on equal keys the first one's value."""
    return F.map_concat(own, F.map_filter(other, lambda k, v: ~F.map_contains_key(own, k)))


def merged_sum(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def ring_area(ring: Column) -> Column:
    """Twice the signed area; positive for exteriors in tile units, where y grows downwards."""
    steps = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def is_exterior(ring: Column) -> Column:
    return ring_area(ring) > 0


def asked_point(text: Column) -> Column:
    """Struct lat, lon, tolerance of ``lat,lon,tolerance`` within range and with a tolerance that rounds above 0; else null."""
    form = r"^\s*(-?[0-9.]+),(-?[0-9.]+),([0-9.]+)\s*$"
    lat, lon, tol = (F.regexp_extract(text, form, i).try_cast("double") for i in (1, 2, 3))
    fine = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & (F.round(tol) > 0)
    return F.when(fine, F.struct(lat.alias("lat"), lon.alias("lon"), F.round(tol).alias("tolerance")))
