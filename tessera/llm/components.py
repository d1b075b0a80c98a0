"""Connected components of an edge table by alternating large and small stars.

Every step is a group minimum (with map-side combine), which is written, and an
equi-join with it. A vertex with very many edges isn't collected: the join has
nothing but its two inputs in its stage, so that adaptive execution splits the rows
of such a vertex over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component) of every vertex that has a link to another; the component
    is its smallest vertex. Repeated links, loops and links with a null end don't
    matter; without links there are no rows."""
    edges, path = written(links.select(F.least(u, v).alias("v"), F.greatest(u, v).alias("u")).where(f"{u} != {v}").distinct().select("u", "v"), "edges")
    state = _state(edges)
    while state[0]:
        # large star: each vertex hands its larger neighbours to the smallest of all
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large, large_path = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        # small star: each vertex hands its smaller neighbours and itself to the smallest of them
        least, least_path = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges, new_path = written(small.where("u != v").distinct(), "edges")
        for done in (path, low_path, large_path, least_path):
            forget(done)
        path = new_path
        new = _state(edges)
        if new == state:
            break
        state = new
    # every edge now points from a vertex to the smallest of its component
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
