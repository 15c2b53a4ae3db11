"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is one of its nodes.

    Each round maps every node to its least neighbour or itself and replaces both ends of every edge by their images; edges
    within one image go.  Node names are digests, so a round takes about a third of the nodes off a path and a whole star
    at once, and the number of rounds grows with the logarithm of the longest path.  Only a row count reaches the driver.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct())
    image = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
        if image is None:
            image = step
        else:
            later = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
            image = image.join(later, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        a, b = (step.select(F.col("node").alias(c), F.col("component").alias(f"{c}_image")) for c in "ab")
        edges = written(edges.join(a, "a").join(b, "b").select(F.col("a_image").alias("a"), F.col("b_image").alias("b")).where("a <> b").distinct())
        if edges.isEmpty():
            return written(image)
