"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellwatch.llm.shared import stored


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each child has one parent and no parent is a child."""
    children = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    parents = edges.select(F.col("dst").alias("src")).distinct().withColumn("is_parent", F.lit(True))
    found = children.join(parents, "src", "left").where("n > 1 or is_parent").limit(1)
    return not found.take(1)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of an edge; the component is its smallest node.

    ``edges`` has columns ``src`` and ``dst`` of one orderable type, in any direction.
    Null ends, loops and repeated edges are passed over.  A round ties all neighbours of
    a node to the smallest one, first larger neighbours, then smaller ones; the number of
    rounds grows with the logarithm of the longest chain.  Each round is one minimum per
    node (combined before the exchange) and one join, both of which leave a hub's rows
    to Spark's skew handling; its result is a table in the shared folder.
    """
    kept = (
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    )
    kept = stored(kept, "edges")
    while not _is_star_forest(kept):
        both = kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low"))
        large = (
            both.join(low, "src").where("dst > src")
            .select(F.col("dst").alias("src"), F.least("low", "src").alias("dst")).distinct()
        )
        large = stored(large, "large-star")
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src")
        small = (
            small.select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .unionByName(small.select("src", F.col("low").alias("dst"))).where("src <> dst").distinct()
        )
        kept = stored(small, "small-star")
    roots = kept.select(F.col("dst").alias("node")).distinct()
    return (
        kept.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        .unionByName(roots.withColumn("component", F.col("node")))
    )
