"""Connected components by contraction, for links of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulelens.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of ``links`` (a, b): the smallest node that it is connected with.

    Each round every node points to its smallest neighbour, pointers are followed to their ends by doubling, and the links
    are redrawn between the ends. The nodes that still have links at least halve each round, so a chain takes as many rounds
    as its length has bits; each round is a written table.
    """
    links = saved(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = saved(links.selectExpr("a as node").union(links.selectExpr("b")).distinct().selectExpr("node", "node as label"), "labels")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        points = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).selectExpr("a as at", "to")
        while True:
            further = points.selectExpr("at as at2", "to as to2")
            points = saved(points.join(further, F.col("to") == F.col("at2")).select("at", "to", "to2"), "points")
            moved = not points.where("to <> to2").isEmpty()
            points = points.selectExpr("at", "to2 as to")
            if not moved:
                break
        labels = saved(labels.join(points, F.col("label") == F.col("at"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = points.selectExpr("at as at2", "to as b2")
        links = saved(links.join(points, F.col("a") == F.col("at")).join(ends, F.col("b") == F.col("at2")).selectExpr("to as a", "b2 as b").where("a <> b").distinct(), "links")
    return labels
