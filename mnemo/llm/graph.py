"""Connected components of a link table, by repeated contraction of randomly ranked stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import written

SMALL_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint for a written table of at most ``rows`` narrow rows, else the table as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it is connected to.

    In each round a node moves to the lowest-ranked node among its neighbours and itself; ranks are
    hashes drawn anew each round, so long chains shrink by a constant factor too. Each round's
    tables are written to the shared folder.
    """
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    assigned, r = None, 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(c, F.lit(r))
        best = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("rank"), F.col("b").alias("to"))).alias("_best"))
        moves = written(best.select(F.col("a").alias("node"), F.when(rank(F.col("a")) <= F.col("_best.rank"), F.col("a")).otherwise(F.col("_best.to")).alias("to")), "cc-moves")
        near = broadcast_if_small(moves)
        if assigned is None:
            assigned = moves
        else:
            step = near.select(F.col("node").alias("_at"), F.col("to").alias("_next"))
            assigned = written(assigned.join(step, F.col("to") == F.col("_at"), "left").select("node", F.coalesce("_next", "to").alias("to")), "cc-assigned")
        to_a, to_b = near.select(F.col("node").alias("a"), F.col("to").alias("_a")), near.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        left = written(left.join(to_a, "a").join(to_b, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "cc-edges")
        r += 1
    if assigned is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    lowest = written(assigned.groupBy("to").agg(F.min("node").alias("component")), "cc-lowest")
    return assigned.join(broadcast_if_small(lowest), "to").select("node", "component")
