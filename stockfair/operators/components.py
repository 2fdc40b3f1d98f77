"""Connected components of a graph whose nodes are tied by shared things (batches
by products they both ask for).

Every round points each node at the smallest node it knows: first all larger
neighbours of a node are pointed at the smallest one around it, then each node's
smaller neighbours are.  The graph keeps its components and becomes a star for
each of them; rounds grow with the logarithm of a component's length.  A node's
smallest neighbour is a partial aggregate, and joined back as one value, so a node with
a third of all edges meets no other hub's rows; AQE splits its side of the join.
Each round's edges are written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockfair.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), both of one type; ``root`` is
    the smallest node of the component."""
    cur = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        sides = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m"))
        large = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")) \
            .unionByName(cur.where("a = b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.*")
        cur = stored(small.distinct())
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # a star: every node but the root has one edge to it
    return cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")) \
        .unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()) \
        .groupBy("node").agg(F.min("root").alias("root"))
