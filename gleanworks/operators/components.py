"""Connected components of a graph of links, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.session import staged


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of a link; ``component`` is the smallest node reachable.

    Rounds of large-star and small-star: every node hands its larger, then its smaller
    neighbours to the smallest one it sees. The links of a round are a table in the staging
    folder; a round ends the work when it changes nothing. A node's neighbours are never
    gathered, only their minimum, so a hub costs no more than any other node.
    """
    own = links.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    edges = staged(own, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = staged(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
