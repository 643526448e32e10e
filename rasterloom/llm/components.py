"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import checkpointed

#: Edges of a node that one task gets, about; nodes with more are hubs, at most twice as many as ``HUBS``.
OF_NODE, HUBS = 200, 5000


def with_least(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """``edges`` with the columns of ``least`` (``a``, the number ``n`` of its edges, ``least``) of their ``a``.

    The edges of a node that has more than ``most`` are dealt to several tasks, each with a copy of
    the node's row. Only these nodes are broadcast: at most the number of edges by ``most``.
    """
    hubs = F.broadcast(least.where(F.col("n") > most).select("a", F.ceil(F.col("n") / most).cast("int").alias("ways")))
    left = edges.join(hubs, "a", "left").withColumn("way", F.coalesce(F.pmod(F.xxhash64("b"), F.col("ways")).cast("int"), F.lit(0))).drop("ways")
    right = least.join(hubs, "a", "left").withColumn("way", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).select("a", "way", "least")
    return left.join(right, ["a", "way"])


def large_star(edges: DataFrame, most: int) -> DataFrame:
    """Each neighbour of a node that is larger than the node is linked to the node's least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"), F.count("*").alias("n"))
    return with_least(both.where("b > a"), least, most).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a > b").distinct()


def small_star(edges: DataFrame, most: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these; ``a > b`` in ``edges``."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
    among = with_least(edges, least, most).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a > b")
    return among.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, of_node: int = OF_NODE, hubs: int = HUBS) -> DataFrame:
    """``node, root`` of each node that has an edge and isn't the least of its component.

    ``edges`` has ``a`` and ``b`` of one orderable type; loops and repeats are ignored. Rounds go on
    until none changes the edges, a number that grows as the logarithm of the longest path. Each is
    cut from its lineage with a checkpoint, and the driver reads a count and a sum only.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, most = state, max(of_node, state[0] // hubs)
        now = checkpointed(small_star(checkpointed(large_star(now, most)), most))
