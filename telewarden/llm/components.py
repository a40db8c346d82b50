"""Connected components of a stored edge table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telewarden.session import cut_lineage

MAX_ROUNDS = 100


def connected_components(edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``node, root`` for each node of the ``long`` columns ``a, b`` of ``edges``; nodes are connected just if their roots agree.

    In each round a node joins the one among itself and its neighbours whose hash, another one each round, is smallest. That
    shrinks a graph of any shape by a constant factor in expectation, so rounds grow with its logarithm. A hub is only ever the key of an
    aggregate, which combines before the shuffle, or of a join to one row, which Spark splits.
    """
    left = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    for turn in range(rounds):
        if left.isEmpty():
            break
        order = lambda node, turn=turn: F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), F.col(node).alias("n"))
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        step = cut_lineage(nearest.select(F.col("a").alias("node"), F.least(order("a"), F.col("near"))["n"].alias("root")), "contraction")
        steps.append(step)
        ends = left.join(step.withColumnsRenamed({"node": "a", "root": "ra"}), "a").join(step.withColumnsRenamed({"node": "b", "root": "rb"}), "b")
        moved = ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        left = cut_lineage(moved, "edges")
    else:
        raise RuntimeError(f"not contracted after {rounds} rounds")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # From the last round back: where the roots of a round went afterwards.
    final = steps[-1]
    for step in reversed(steps[:-1]):
        later = final.select(F.col("node").alias("root"), F.col("root").alias("later"))
        final = step.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return final
