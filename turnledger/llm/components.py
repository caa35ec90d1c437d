"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.session import materialize


def _least_neighbour(arcs: DataFrame) -> DataFrame:
    """Least of a node and its neighbours; the minimum is combined before the shuffle, so a hub is no hot key."""
    return arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (arcs.join(_least_neighbour(arcs), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger to the smaller node."""
    joined = edges.join(_least_neighbour(edges), "u")
    return (joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct())


def components(edges: DataFrame, left: str, right: str, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Each round is written to the shared folder, so a lost executor re-reads it. Only two numbers per round reach the
    driver. Rounds grow with the logarithm of the longest path.
    """
    a, b = F.col(left), F.col(right)
    state = materialize(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    seen = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if mark == seen or mark[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        state = materialize(_small_star(_large_star(state)), name)
