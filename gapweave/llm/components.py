"""Connected components by random-order contraction, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``u, v``); a component is its smallest node.

    In each round every node joins the neighbour (or itself) that comes first in that round's random order, and edges are
    redrawn between the groups; a constant share of the groups that still have edges vanishes per round. Only edges between
    groups are kept, stored in the shared folder, so a lost executor costs one round at most. Self-loops give a node its own component.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    live = stage_table(both.distinct(), "cc-edges")
    group = live.select(F.col("u").alias("node"), F.col("u").alias("g")).distinct()
    live = live.filter("u != v")
    for i in range(rounds):
        if live.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(i), c).alias("r"), c.alias("x"))
        step = live.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m")).select("u", F.least("m", rank(F.col("u")))["x"].alias("to"))
        step = stage_table(step, "cc-step")
        group = stage_table(group.join(step.withColumnRenamed("u", "g"), "g", "left").select("node", F.coalesce("to", "g").alias("g")), "cc-group")
        left = live.join(step, "u").select(F.col("to").alias("u"), "v")
        moved = left.join(step.withColumnRenamed("u", "v").withColumnRenamed("to", "w"), "v").select("u", F.col("w").alias("v"))
        live = stage_table(moved.filter("u != v").distinct(), "cc-edges")
    else:
        if not live.isEmpty():
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    least = group.groupBy("g").agg(F.min("node").alias("component"))
    return group.withColumn("x", F.xxhash64("g")).join(least.withColumn("x", F.xxhash64("g")), ["g", "x"]).select("node", "component")
