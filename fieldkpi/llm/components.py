"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldkpi.llm.common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``id, component`` (smallest id reachable) for every id in ``edges`` (a, b).

    Each round every id points to its smallest neighbour, pointers are followed to their
    ends (each step doubles the reach, so a chain of n takes log n steps), and edges between
    those ends remain: at most half as many ids, each round. A star is gone after one. Minima are taken partly before the shuffle, and
    the other joins have one row per id on one side, so a hub is split at run time.
    Every round is checkpointed. No edges give no rows.
    """
    edges = checkpointed(
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(
            edges.select(F.col("b").alias("id"), F.col("a").alias("to"))
        )
        up = checkpointed(
            both.groupBy("id").agg(F.min("to").alias("to")).select(
                "id", F.least("id", "to").alias("up")
            )
        )
        while True:
            above = up.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            jumped = checkpointed(up.join(above, "up").select("id", "up", "upper"))
            up = jumped.select("id", F.col("upper").alias("up"))
            if jumped.where(F.col("up") != F.col("upper")).isEmpty():
                break
        if labels is None:
            labels = up.select("id", F.col("up").alias("component"))
        else:
            step = up.select(F.col("id").alias("component"), "up")
            labels = checkpointed(
                labels.join(step, "component", "left").select(
                    "id", F.coalesce("up", "component").alias("component")
                )
            )
        at_a = up.select(F.col("id").alias("a"), F.col("up").alias("x"))
        at_b = up.select(F.col("id").alias("b"), F.col("up").alias("y"))
        edges = checkpointed(
            edges.join(at_a, "a")
            .join(at_b, "b")
            .where(F.col("x") != F.col("y"))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
