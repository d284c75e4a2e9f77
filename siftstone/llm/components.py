"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join.

The edges shrink to stars around each component's smallest node in a few rounds (two or three for star-shaped
input).  Every round is a written table; nothing but its row count and checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import durable


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of long nodes: (node, root) for every node with an edge to another; root is the smallest node reachable."""
    ordered = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = durable(ordered(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join's sides come from plain exchanges, which adaptive execution splits where a node has most edges
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = durable(ordered(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large-star")
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = ordered(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
        now, before = durable(small, "small-star"), state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
