"""Connected components of a link table, without bringing links to the driver or a node's links to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pregame.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b long); component is a node of it.

    Contraction: every node points to the smallest of itself and its neighbours (in a fixed pseudorandom
    order, so that chains do not stay long), links are moved to where their ends point, loops go, and so on
    until no link is left. Minima are summed map-side; each round is written to the shared folder.
    """
    order = lambda c: F.struct(F.xxhash64(F.lit(41), c).alias("rank"), F.col(c).alias("node"))
    edges = settle(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    names = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = (
            both.groupBy("a").agg(F.min(order("b")).alias("m"))
            .select(F.col("a").alias("node"), F.least(order("a"), F.col("m")).getField("node").alias("to"))
        )
        to = settle(to)
        if names is None:
            names = to.select("node", F.col("to").alias("component"))
        else:
            step = to.withColumnRenamed("node", "component")
            names = names.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        names = settle(names)
        edges = settle(
            edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .filter(F.col("a") != F.col("b")).distinct()
        )
    return names if names is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
