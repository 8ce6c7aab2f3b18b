"""Connected components on the executors: alternating large and small stars until nothing changes.

Every round halves paths, so the number of rounds follows the logarithm of the longest one. Minima are taken with
partial sums before the shuffle, and a hub's edges meet only in joins, which AQE splits. Each round's edges are written
to the shared folder, so lineage stays short and a lost executor costs one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    across = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Tells whether two sets of edges are the same."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the least id): one row for every id that has an edge to another."""
    spark = edges.sparkSession
    own = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    now, path = store.save(spark, own, "edges")
    seen = _mark(now)
    while seen[0]:
        after, new_path = store.save(spark, _small_star(_large_star(now)), "edges")
        mark = _mark(after)
        store.drop(spark, path)
        now, path = after, new_path
        if mark == seen:  # stars already
            break
        seen = mark
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionAll(found.select(F.col("component").alias("id"), "component").distinct())
