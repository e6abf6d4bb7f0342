"""Connected components of an edge table by alternating large-star and small-star steps, all of it as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b long) to rows (node, component): the smallest node reachable. Nodes are those of the edges.

    Each round links every node's larger neighbours to the smallest neighbour (large star), then every node's smaller neighbours and the node itself
    to the smallest (small star). Sums of the edge table show the fixed point. Null ends are dropped, self-links and repeats have no effect,
    an empty table gives an empty result. Minimums are computed by partial aggregates, so a node with very many links costs no large group.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, seen = stored(e, "cc"), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s")).select("s.*").where("a <> b").distinct()
        e = stored(small, "cc")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
