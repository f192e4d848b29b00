"""Connected components of an edge table, by contraction.

In a round each node points at its smallest neighbour, or at itself if it is
smaller; following the pointers to their roots gives trees, which become the
nodes of the next round. At least half of the nodes of a component go each
round, and none that is the smallest of its component. The work is in joins
and partial aggregations over edges, so a hub costs one row a task, or is a
skewed join side that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import Scratch


def _roots(pointers: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, to with every pointer followed to its root."""
    turn = 0
    while True:
        on = pointers.select(F.col("id").alias("at"), F.col("to").alias("next"))
        moved = scratch.save(pointers.join(on, F.col("to") == F.col("at")).select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), f"{name}-{turn}")
        pointers, turn = moved.select("id", "to"), turn + 1
        if not moved.where("moved").take(1):
            return pointers


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, component (smallest id) of every node of edges (a, b: bigint). Loops and
    repeated edges do not matter; an edge with a null end is dropped."""
    left = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    done, turn = None, 0
    while left.take(1):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("to"))
        roots = _roots(scratch.save(nearest, f"{name}-{turn}"), scratch, f"{name}-{turn}-to")
        if done is None:
            done = roots
        else:
            on = roots.select(F.col("id").alias("at"), F.col("to").alias("next"))
            done = scratch.save(done.join(on, F.col("to") == F.col("at"), "left").select("id", F.coalesce("next", "to").alias("to")), f"{name}-{turn}-done")
        a, b = (roots.select(F.col("id").alias(c), F.col("to").alias(f"m{c}")) for c in ("a", "b"))
        moved = left.join(a, "a").join(b, "b").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).where("a <> b").distinct()
        left, turn = scratch.save(moved, f"{name}-{turn}-left"), turn + 1
    if done is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return done.select("id", F.col("to").alias("component"))
