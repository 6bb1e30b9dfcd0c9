"""Connected components of a graph that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscope.llm.scratch import materialise


def _links(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _relink(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of every node on the smallest node of its neighbourhood: the larger ones, or the smaller ones.

    A hub is one key with many rows: its minimum is combined before the shuffle, and the join back on it is a join
    that adaptive execution may split.
    """
    around = _both_ways(edges) if large else edges
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = around.join(least, "a")
    if large:
        return _links(joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")))
    hung = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _links(hung.union(least.select("a", F.col("least").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """`node` and `component`, the smallest node it reaches, for every node but the smallest of each component.

    `edges` has the LONG columns `a` and `b`. Alternates the two steps until nothing changes, about log(n) rounds;
    each round is a written table, and only the sums that tell whether it has changed come to the driver.
    """
    current = materialise(_links(edges), "links")
    seen = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
        current = materialise(_relink(_relink(current, True), False), "links")
