"""Connected components of a link table, in Spark rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeloom.llm.common import shared


def connected(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, for every node of ``links`` (a, b).

    A round gives every node the least label among itself and its neighbours, then the
    label of that label, so paths shrink by more than half a round. Each round is a
    written table; only the count of changes reaches the driver.
    """
    edges = shared(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = shared(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(seen, "node").select("node", F.least("label", "near").alias("near"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        new = shared(near.join(jump, "near").select("node", F.least("near", "far").alias("label"), "old"), "labels")
        if not new.where("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
