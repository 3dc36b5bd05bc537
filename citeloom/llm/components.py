"""Connected components by rounds of contraction, with nothing gathered outside Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: nodes share a root if linked.

    Each round every node moves to the neighbour of least hash, if that is less
    than its own; edges follow their ends and loops go. The hash changes with the
    round, so long chains shrink as fast as stars. Minima are combined before
    the shuffle, so a node with very many edges needs no large group.
    """
    ends = (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = materialize(edges.filter(F.col(a) != F.col(b)).select(*ends).distinct())
    moves: list[DataFrame] = []
    while not left.isEmpty():
        seed = F.lit(len(moves))
        order = lambda c: F.struct(F.xxhash64(seed, c).alias("col1"), c.alias("col2"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        closer = F.col("m") < order(F.col("a"))
        move = best.select(F.col("a").alias("node"), F.when(closer, F.col("m")["col2"]).otherwise(F.col("a")).alias("to"))
        moves.append(move := materialize(move))
        after = left.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        after = after.join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x != y")
        left = materialize(after.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def follow(labels: DataFrame, move: DataFrame) -> DataFrame:
        step = move.select(F.col("node").alias("root"), "to")
        return labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))

    return reduce(follow, moves[1:], moves[0].withColumnRenamed("to", "root"))
