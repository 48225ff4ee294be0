"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a minimum per node (combined map-side, so a hub is no hot group) and an equi-join. Nodes of
many edges are few, so they are broadcast for that join up to a checked number, and their edges are not
dealt by node; beyond it AQE can split the join. Each round's edges are written to the shared folder.
No edge reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekmill.llm.storage import discard, materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % (1 << 40))).alias("s")).first()
    return row["n"], row["s"] or 0


HUB_EDGES, MOST_HUBS = 1024, 1 << 16


def _with_least(both: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and its neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hubs = materialize(least.where(F.col("n") > HUB_EDGES).select("u", "m"))
    if not 0 < hubs.count() <= MOST_HUBS:
        return both.join(least.drop("n"), "u")
    others = both.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.drop("n"), "u")
    return both.join(F.broadcast(hubs), "u").unionByName(others)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (u, v) of integers -> (node, component): the least node it is connected with. Nodes without edges are absent."""
    star = materialize(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(star)
    for _ in range(rounds):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, star = star, materialize(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        was, state = state, _state(star)
        if state == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
