"""Connected components of an edge table with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_path, written


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """For each node, links from its neighbours (and itself) to the least node around it.

    A node's least neighbour is found by a map-side combined min and joined back to its edges, so that a node with very
    many edges is never gathered in one task; the join can be split where it is skewed.
    """
    if larger_only:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(least, "a")
    if larger_only:
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges; component is the least node that links reach.

    Alternates two contractions (towards the least neighbour, from larger and from smaller neighbours) until the edge set
    is a forest of stars, which takes about log2 of the longest path. Each round is a table in the shared folder that takes the place
    of the one before; repeated links go once a round, as either contraction gives one link for each that it reads.
    Edges with a null end and self-links are left out; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b")
    at = fresh_path(spark, "links")
    now = written(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "", at)
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        after = fresh_path(spark, "links")
        now = written(_to_least(_to_least(now, True), False).distinct(), "", after)
        discard(spark, at)
        at = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
