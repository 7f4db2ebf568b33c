"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Rows for one task of a table that is small enough to be read by few.
TASK_ROWS = 200_000


def compact(table: DataFrame) -> DataFrame:
    """A saved table in as many partitions as its rows need, TASK_ROWS for each. One
    partition needs no exchange for what follows; the logic is the same for any number."""
    parts = max(1, math.ceil(table.count() / TASK_ROWS))
    return table.coalesce(parts)


def _star(edges: DataFrame) -> DataFrame:
    """A large and a small star step on edges ``(u, v)`` with u > v.

    Large: every larger neighbour of a node goes to the node's smallest neighbour.
    Small: a node and its smaller neighbours go to the smallest of them.
    Smallest neighbours come from a pre-aggregating group-by and return by an equi-join,
    so a node with very many neighbours is never gathered in one place.
    """
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return moved.where("u != v").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node points to one root, and no root points on."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e")).select("e.n", "e.up")
    counts = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.count_if(F.col("up") == 0).alias("downs"))
    return counts.where("ups > 1 or (ups = 1 and downs > 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that has an edge: the smallest node reachable.

    Each round is written to the shared folder, so no lineage grows and a lost executor
    costs a round's tasks at most. Rounds end when the edges are stars; their number
    grows with the logarithm of the longest path. Loops, repeated edges and an empty
    table are allowed; edges with a null end are left out.
    """
    edges = edges.where(f"{a} is not null and {b} is not null and {a} != {b}")
    now = compact(saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"))
    while not _is_forest_of_stars(now):
        now = compact(saved(_star(now), "edges"))
    return now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("e")).select("e.node", "e.component").distinct()
