"""Connected components of a table of links, by joins: no task sees all links of a vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmill.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``v, label`` for every vertex of ``links(a, b)``; the label is the least vertex of its component.

    Each round takes the least label among neighbours and then the label of that label, so long
    chains shorten by half; it ends when no label changes. Repeated links and loops do no harm.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v"), "label")
        least = labels.withColumn("old", F.col("label")).unionByName(near.withColumn("old", F.lit(None).cast("long"))).groupBy("v").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        heads = labels.select(F.col("v").alias("label"), F.col("label").alias("head"))
        labels_next = checkpointed(least.join(heads, "label").select("v", F.least("label", "head").alias("label"), "old"))
        changed = labels_next.where("label <> old").limit(1).count()
        labels = labels_next.select("v", "label")
        if not changed:
            return labels
