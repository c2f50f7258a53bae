"""Connected components of an edge table by hooking on smaller labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of an edge.

    Each round a node takes the least label among its neighbours' and its own, and then the label of its label; rounds grow
    with the logarithm of the longest way in practice. Joins are by node, minima are combined map-side, and each round is
    written once; only the number of changes reaches the driver.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    nodes = both.groupBy("u").agg(F.min("v").alias("least"))
    labels = written(nodes.select(F.col("u").alias("node"), F.least("u", "least").alias("component")), "labels")
    while True:
        seen = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("least"))
        own = labels.withColumnRenamed("component", "before")
        hooked = own.join(seen, own["node"] == seen["u"]).select("node", "before", F.least("before", "least").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        jumped = hooked.join(target, "label", "left").select("node", "before", F.least("label", F.coalesce("further", "label")).alias("component"))
        jumped = written(jumped, "labels")
        changed = jumped.where("component <> before").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
