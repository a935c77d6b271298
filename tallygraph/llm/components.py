"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """v, label for each end of links(a, b): label is the least v that links reach.

    Every round takes each node's least label among its neighbours, then that label's own label, so paths halve.
    Rounds are written to the shared folder; nothing but the number of changed rows comes to the driver.
    """
    edges = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(edges, "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["v"] == near["a"]).select("v", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        owner = labels.select(F.col("v").alias("mid"), F.col("label").alias("owner"))
        step = step.join(owner, "mid").select("v", "old", F.least("mid", "owner").alias("label"))
        step = materialize(step, "labels")
        changed = step.filter("label <> old").limit(1).count()
        labels = step.drop("old")
        if not changed:
            return labels
