"""Connected components by randomised contraction, with joins and minimum aggregates only.

In each round every node points at the neighbour (or itself) that a hash of the round orders
first, and edges are rewritten to those representatives. The expected number of nodes that still
have edges shrinks by a constant factor a round, whatever the shape (paths, stars, cliques). Each
aggregate is a min with map-side combine and each join can be split by skew handling, so that a
hub with very many edges doesn't meet in one task. No list of members is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import apart, checkpointed

#: Rows of a checkpoint's file, about.
PER_FILE = 100_000


def connected(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node long, root long), a row for each node that has an edge to another.

    Loops and repeated edges do no harm. `root` is some node of the component, the same for all
    of its nodes. An empty table gives an empty table.
    """
    edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while n := edges.count():
        few = n // PER_FILE + 1  # what follows has no more rows than that: small tables needn't have a file for each partition
        turn = F.lit(len(steps))
        ordered = lambda c: F.struct(F.xxhash64(c, turn).alias("p"), F.col(c).alias("n"))  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(ordered("b")).alias("m"))
        step = best.select(F.col("a").alias("node"), F.least(ordered("a"), F.col("m")).getField("n").alias("root"))
        steps.append(step := checkpointed(step.coalesce(few)))
        left = step.select(apart("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(apart("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = checkpointed(moved.where("a <> b").distinct().coalesce(few))
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[-1]
    for step in steps[-2::-1]:
        later = found.select(apart("node").alias("root"), F.col("root").alias("final"))
        found = step.join(later, "root", "left").select("node", F.coalesce("final", "root").alias("root"))
    return found
