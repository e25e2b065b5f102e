"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, with_group, written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def components(edges: DataFrame) -> DataFrame:
    """(u, label): the least node of u's component, for every node of edges (u, v) but the least ones themselves.

    Edges have no direction; loops and repeats do not matter. Each round is a few shuffles of the edges; high
    degrees are spread over cells, and rounds grow with the logarithm of a component's size.
    """
    pair = lambda df: df.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(pair(edges), "stars")
    state = _state(now)
    while state[0]:
        # large star: neighbours above a node are tied to the least neighbour of the node, or to itself
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_group(both, "u", "v", {"low": ("min", "v")}).filter("v > u")
        large = large.select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        # small star: neighbours below a node, and the node, are tied to the least of them
        small = with_group(pair(large), "u", "v", {"low": ("min", "v")})
        tied = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(small.select("u", F.col("low").alias("v")))
        after = written(pair(tied), "stars")
        new = _state(after)
        discard(now)
        now = after
        if new == state:
            break
        state = new
    return now.select("u", F.col("v").alias("label"))
