"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, component) for the nodes of (a, b); component is the smallest node reachable.

    Each round rewires edges to smallest neighbours: the number of edges never grows and the rounds
    are about the logarithm of the longest path. Minima are partial aggregates and the joins are
    plain equi-joins, so a star with very many leaves is combined before, or split by, the
    exchange. Edges are written between rounds, which go on until the edges are settled; if they aren't
    after ``most_rounds``, where given, that is an error. Null ends and loops are ignored; an empty table
    gives an empty result.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = common.materialize(pairs, "edges")
    seen = None
    for turn in count():
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        if turn == most_rounds:
            raise RuntimeError(f"components are not settled after {most_rounds} rounds")
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.apart(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), 2 * state[0])
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = common.apart(large.groupBy("a").agg(F.min("b").alias("m")), state[0])
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = common.materialize(small.where("a <> b").distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("b").alias("component")))
