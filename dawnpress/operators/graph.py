"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnpress.session import cut_lineage


def connected_components(edges: DataFrame, nodes: DataFrame, node: str = "item_id", name: str = "component") -> DataFrame:
    """Label every node with the smallest node of its component; ``edges`` is (src, dst) of integer nodes.

    Large-star and small-star steps alternate until the edges no longer change, which takes a logarithmic number of
    rounds also on long chains. Each round works on distinct edges and is checkpointed.
    """
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    pairs = cut_lineage(pairs)
    mark = _digest(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut_lineage(
            hung.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        now = _digest(pairs)
        if now == mark:
            break
        mark = now
    roots = pairs.groupBy(F.col("u").alias(node)).agg(F.min("v").alias(name))
    return nodes.select(node).distinct().join(roots, node, "left").withColumn(name, F.coalesce(name, node))


def _digest(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def sized_components(labelled: DataFrame, min_size: int, name: str = "component") -> DataFrame:
    """Members of the components of at least ``min_size`` nodes, with the size."""
    sizes = labelled.groupBy(name).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return labelled.join(sizes, name)
