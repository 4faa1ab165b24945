"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for (a, b) edges: the smallest node that can be reached.

    Every round takes the smallest label among neighbours and then the label of that label, so rounds grow
    with the logarithm of the distances; each writes its labels to the shared folder.  A node with very
    many edges is combined on the map side.
    """
    edges = edges.where("a != b")
    edges = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        nearby = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("nearby"))
        hooked = labels.join(nearby, "node").select("node", F.col("component").alias("before"), F.least("component", "nearby").alias("hook"))
        roots = hooked.select(F.col("node").alias("hook"), F.col("hook").alias("root"))
        jumped = written(hooked.join(roots, "hook").select("node", "before", F.col("root").alias("component")), "labels")
        if jumped.where("before != component").isEmpty():
            return jumped.select("node", "component")
        labels = jumped.select("node", "component")
