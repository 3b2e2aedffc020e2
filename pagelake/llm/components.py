"""Distributed connected components by alternating large-star and small-star rounds.

Each round is a partial-aggregated minimum and one equi-join, so no group is ever collected; nodes
with very many neighbours are few and joined by broadcast. The number of rounds grows with
the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, join_unique, written


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """One star round over (a, b) with a > b; every node is tied to its smallest neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        tied = join_unique(both, low, ["a"], "n", 2 * total)
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        tied = join_unique(edges, low, ["a"], "n", total)
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the BIGINT edge table (a, b); root is the smallest node reachable.

    Self loops, repeated and reversed edges are allowed; rows with a null end are ignored; an
    empty table gives an empty result. Nodes without an edge do not occur.
    """
    known = edges.where("a is not null and b is not null and a <> b")
    now = written(
        known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        star = written(_star(now, mark[0], True), "edges")
        after = written(_star(star, mark[0], False), "edges")
        drop_written(now)
        drop_written(star)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
