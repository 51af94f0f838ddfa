"""Connected components by alternating large and small stars, DataFrame operations only.

Edges turn into stars around each component's smallest node in a number of rounds that
grows with the logarithm of its diameter.  Each round is two aggregations with partial
counts on the map side and two equality joins, which Spark splits where a node is hot;
nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b) but the roots themselves.

    root is the smallest node reachable.  Edges with a null end and loops are passed over.
    """
    ends = edges.where(F.col("a") != F.col("b"))
    e = durable(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _mark(e)
    if not seen[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        e = durable(_small_star(_large_star(e)))
        if (now := _mark(e)) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components didn't settle")


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours, moved to the smallest of it and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = durable(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m")))
    # the larger neighbours of a node are the rows of e in which it is v
    return e.join(low, e["v"] == low["at"]).select("u", F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and the node itself, moved to the smallest of them."""
    low = durable(e.groupBy("u").agg(F.min("v").alias("m")))
    others = e.join(low.withColumnRenamed("u", "at"), e["u"] == F.col("at")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionByName(others).distinct()
