"""Connected components of a distributed edge list.

Alternating large-star and small-star steps, each one a grouped minimum and a
join on the node, so no neighbourhood is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b), a > b. Large: larger neighbours of each node go to its least one; small: the lesser ones do."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def roots(parents: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of (node, parent) rows, one a node, with parent < node: the end of each chain, by pointer jumping."""
    now, left = written(parents, "parents"), None
    for _ in range(most):
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        now = written(now.join(up, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent")), "parents")
        before, left = left, now.agg(F.sum(F.xxhash64("node", "parent").cast("decimal(38,0)"))).first()[0]
        if before == left:
            return now.select("node", F.col("parent").alias("component"))
    raise RuntimeError(f"chains did not end in {most} rounds")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): each node of the (a, b) long edges with the least node it can reach.

    Loops and nulls are left out; repeated and reversed edges are harmless. An
    empty edge list gives no rows. Raises if ``most`` rounds don't suffice.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = None
    for _ in range(most):
        edges = written(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {most} rounds")
