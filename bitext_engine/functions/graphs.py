"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext_engine.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v), the component being its least node.

    Every round a node takes the least label around it, and then the label that its label has, so that chains are
    halved. Rounds end when no label changes; only that count reaches the driver. A null end is no link.
    """
    valid = links.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    both = cut_lineage(valid.select("u", "v").unionByName(valid.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("node"), F.least("u", "_m").alias("component")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("_least"))
        near = labels.join(around.withColumnRenamed("u", "node"), "node").select("node", F.col("component").alias("_was"), F.least("component", "_least").alias("_now"))
        far = near.select(F.col("node").alias("_now"), F.col("_now").alias("_then"))
        rows = cut_lineage(near.join(far, "_now").select("node", "_was", F.col("_then").alias("component")))
        labels = rows.select("node", "component")
        if not rows.where(F.col("_was") != F.col("component")).limit(1).count():
            return labels
