"""Connected components as joins, in a number of rounds that grows with the logarithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.stored import stored



def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node with an edge, and the smallest node it is connected with.

    Contraction: each round every node points to the least of its neighbours and itself, and edges are
    drawn between what nodes point to, until none is left. Rounds go by the nodes themselves and by a
    hash of them in turn: the first kind ends stars and cliques at once, the second shortens chains
    by a constant share whatever their order. Minima are combined before the shuffle, and a hub is a
    hot key only in joins with one row per node on the other side, which Spark splits. Self edges and
    null ends are left out; repeated edges count once.
    """
    a, b = F.col(a), F.col(b)
    left = stored(
        edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    )
    label = None
    turn = 0
    while not left.isEmpty():
        mark = (lambda name: F.xxhash64(name, F.lit(turn))) if turn % 2 else (lambda _: F.lit(0))
        order = lambda name: F.struct(mark(name).alias("mark"), F.col(name).alias("node"))  # noqa: E731,B023
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            left.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        best = ends.groupBy("node").agg(F.min(order("other")).alias("best"))
        step = stored(best.select("node", F.least("best", order("node"))["node"].alias("to")))
        to = lambda end: step.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}"))
        left = stored(
            left.join(to("a"), "a")
            .join(to("b"), "b")
            .where(F.col("to_a") != F.col("to_b"))
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct()
        )
        if label is None:
            label = step
        else:
            moved = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            label = label.join(moved, "to", "left").select(
                "node", F.coalesce("next", "to").alias("to")
            )
        turn += 1
    if label is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = stored(label)
    least = label.groupBy("to").agg(F.min("node").alias("component"))
    return label.join(least, "to").select("node", "component")
