"""Chains of pointers: who is whose end, and in what order nodes hang below it.

Rows stay as wide as a pointer however long a chain is; the way from an end to a node is never written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import kept


def ends(pointers: DataFrame) -> DataFrame:
    """(node, end) of pointers (node, parent), one a node: where each chain ends.

    Pointers double in each round, so a chain of n takes log n rounds. In each, fewer nodes still move on; where their
    number stays, pointers run in a circle, which raises.
    """
    now, before = kept(pointers.select("node", F.col("parent").alias("end")), "chains"), None
    while True:
        up = now.select(F.col("node").alias("end"), F.col("end").alias("_next"))
        joined = now.join(up, "end", "left")
        now = kept(joined.select("node", F.coalesce("_next", "end").alias("end"), F.col("_next").isNotNull().alias("_moved")), "chains")
        moved = now.where("_moved").count()
        now = now.drop("_moved")
        if not moved:
            return now
        if moved == before:
            raise ValueError("pointers run in a circle")
        before = moved


def places(pointers: DataFrame) -> DataFrame:
    """(node, place) of pointers (node, parent, step) without circles: below one end, nodes in the order of the steps from there to them.

    That is each node before those below it, and neighbours by step. A walk round each tree enters and leaves every node
    once; how many nodes are still to be entered follows by doubling, in log n rounds over two rows a node.
    """
    below = Window.partitionBy("parent").orderBy("step")
    own = kept(pointers.select("node", "parent", F.row_number().over(below).alias("_nth"), F.lead("node").over(below).alias("_beside")), "steps")
    first = own.where("_nth = 1").select(F.col("parent").alias("node"), F.col("node").alias("_first"))
    # up: whether the parent is a pointer too, so that the walk goes on there
    rows = own.join(first, "node", "left").join(own.select(F.col("node").alias("parent"), F.lit(True).alias("_up")), "parent", "left")
    at = lambda node, left: F.struct(node.alias("node"), F.lit(left).alias("left"))
    enter = F.struct(at(F.col("node"), False).alias("at"), F.when(F.col("_first").isNotNull(), at(F.col("_first"), False)).otherwise(at(F.col("node"), True)).alias("next"), F.lit(1).cast("long").alias("n"))
    leave = F.struct(at(F.col("node"), True).alias("at"), F.when(F.col("_beside").isNotNull(), at(F.col("_beside"), False)).when(F.col("_up"), at(F.col("parent"), True)).alias("next"), F.lit(0).cast("long").alias("n"))
    now = kept(rows.select(F.inline(F.array(enter, leave))), "walk")
    while now.where("next is not null").limit(1).count():
        on = now.select(F.col("at").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"))
        now = kept(now.join(on, "next", "left").select("at", F.col("_next").alias("next"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")), "walk")
    return now.where("not at.left").select("at.node", (-F.col("n")).alias("place"))
