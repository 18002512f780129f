"""Connected components of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.session import materialise_at, new_shared_path, remove_shared


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (one, other); root is a component's least node.

    Each round ties the larger neighbours of a node to its least one, then the smaller ones
    (large star, small star). Rounds end when all links are stars around least nodes. Only
    links move; they are written after each round, and the round before is removed.
    """
    spark = links.sparkSession
    path = new_shared_path(spark, "links")
    edges = materialise_at(
        links.where("one <> other").select(F.greatest("one", "other").alias("one"), F.least("one", "other").alias("other")).distinct(), path
    )
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("other").alias("one"), F.col("one").alias("other")))
        least = both.groupBy("one").agg(F.min("other").alias("least"))
        large = (
            both.where("other > one")
            .join(least.select("one", F.least("one", "least").alias("least")), "one")
            .select(F.col("other").alias("one"), F.col("least").alias("other"))
            .distinct()
        )
        least = large.groupBy("one").agg(F.min("other").alias("least"))
        tied = F.explode(F.array(F.struct("one", "least"), F.struct(F.col("other").alias("one"), "least")))
        small = large.join(least, "one").select(tied.alias("e")).select("e.one", F.col("e.least").alias("other"))
        before, path = path, new_shared_path(spark, "links")
        edges = materialise_at(small.where("one <> other").distinct(), path)
        remove_shared(spark, before)
    roots = edges.select("other").distinct().select(F.col("other").alias("node"), F.col("other").alias("root"))
    return edges.select(F.col("one").alias("node"), F.col("other").alias("root")).unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one link to a smaller node, which has none itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("one").alias("node"), F.lit(1).alias("down")), F.struct(F.col("other").alias("node"), F.lit(0).alias("down")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.down").alias("down"), F.min("e.down").alias("root"))
    return nodes.where("down > 1 OR (down = 1 AND root = 0)").isEmpty()
