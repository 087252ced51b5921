"""Connected components of a large graph as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import durable


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, root)`` for every node with an edge to another; the root is the smallest
    node of its component.

    Alternates two contractions: each node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones, until every edge points at a root. The number
    of rounds grows with the logarithm of the longest path. A node with very many edges
    is reduced by partial aggregates and its edges are joined to one row, which adaptive
    execution splits. Loops, repeated edges and nulls are ignored; no edges give no rows.
    """
    now = durable(
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct()
    )
    state = _state(now)
    while True:
        now = durable(_smaller(_larger(now)))
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _larger(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v").distinct()
    )


def _smaller(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
