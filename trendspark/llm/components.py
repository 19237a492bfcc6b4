"""Connected components of a graph that is far larger than one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trendspark.session import stage


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Label nodes with the smallest node they can reach: (node, root), for nodes other than their root.

    ``links`` holds pairs of bigint nodes in either order; repeats, loops and nulls do no harm. Nodes
    without a link, and the roots themselves, get no row.

    Large-star and small-star rounds alternate: first every link (big, small) is moved on to the
    smallest neighbour of its small end, then all smaller neighbours of a node are hung below the
    smallest of them. A graph of n nodes takes about log n rounds. Both tables of a round are written
    before they are joined, so lost executors cost little, plans stay short, and since the node
    with the most links keys both sides of a plain join, adaptive execution can split it.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = stage(links.where(F.col(a) != F.col(b)).select(high.alias("big"), low.alias("small")).distinct(), "links")
    while True:
        lowest = stage(edges.groupBy("big").agg(F.min("small").alias("low")), "lowest")
        seen = edges.alias("e").join(lowest.alias("l"), F.col("e.small") == F.col("l.big"), "left")
        moved = stage(
            seen.select(
                F.col("e.big").alias("big"), F.coalesce("low", "e.small").alias("small"),
                F.col("low").isNotNull().alias("moved"),
            ),
            "large-star",
        )
        counts = moved.agg(F.count("*").alias("n"), F.count_if("moved").alias("moved")).first()
        if counts["moved"] == 0 and counts["n"] == lowest.count():
            return edges.select(F.col("big").alias("node"), F.col("small").alias("root"))
        lowest = stage(moved.groupBy("big").agg(F.min("small").alias("low")), "lowest")
        hung = moved.alias("m").join(lowest.alias("l"), F.col("m.big") == F.col("l.big"))
        ends = F.explode(F.array(F.col("m.big"), F.col("m.small"))).alias("big")
        edges = stage(
            hung.select(ends, F.col("low").alias("small")).where("big <> small").distinct(), "small-star"
        )
