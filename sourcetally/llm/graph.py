"""Connected components of links between numbered things."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcetally.session import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id that it reaches.

    Each round every vertex takes its smallest smaller neighbour as parent, parents are followed to
    their roots by doubling, and links between roots go on to the next round.  A hub's links are
    rows of joins and of aggregates that combine before the shuffle; nothing gathers them.  Steps
    are written to the shared folder.  Links that repeat or lead to themselves are harmless.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = stored(links.where("a != b").select(high.alias("u"), low.alias("v")).distinct(), "graph-edges")
    labels = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct().select("id", F.col("id").alias("component"))
    while not edges.isEmpty():
        parents = stored(edges.groupBy("u").agg(F.min("v").alias("p")), "graph-parents")
        while True:
            above = parents.select(F.col("u").alias("p"), F.col("p").alias("q"))
            doubled = stored(parents.join(above, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "graph-parents")
            parents = doubled.select("u", "p")
            if doubled.where("moved").isEmpty():
                break
        rooted = lambda rows, column: (rows.join(parents.select(F.col("u").alias(column), "p"), column, "left")
                                       .withColumn(column, F.coalesce("p", column)).drop("p"))
        labels = stored(rooted(labels, "component").select("id", "component"), "graph-labels")
        moved = rooted(rooted(edges, "u"), "v").where("u != v")
        edges = stored(moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "graph-edges")
    return labels
