"""Connected components of a graph by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): its component's least node.

    Large-star links each node's greater neighbours to the least it knows of, small-star the
    lesser ones; neither adds edges, and both together end in stars after about log n rounds
    (Kiveris et al., 2014). Each round is written to the checkpoint folder.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(least, "a").select("b", "m").where("b <> m").union(least).toDF("a", "b").distinct()
        edges = cut(edges)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
