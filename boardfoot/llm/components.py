"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardfoot.plans.shared import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = materialize(large, "large-star")
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    kept = low.select("u", F.col("m").alias("v"))
    moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(moved).distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that links reach. Nodes without a link to another are absent.

    `edges` holds undirected links between longs; loops, repeats and null ends have no effect. The number of rounds
    grows with the logarithm of the longest path. Each round groups by node with map-side minima, so a node with very
    many links costs one row a task, and its join side can be split.
    """
    clean = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, seen = materialize(clean, "edges"), None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or state[0] == 0:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        seen, now = state, materialize(_stars(now), "stars")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
