"""Connected components as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node of its component.

    Every round, each node takes the least label among its neighbours' and its own, then the label of
    its label, so labels travel twice as far each round. Rounds are stored tables.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node")
                         .withColumn("moved", F.lit(True)), "labels")
    while labels.filter("moved").limit(1).count():
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.select("node", "label").join(seen.withColumnRenamed("a", "node"), "node") \
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # what a label stands for has itself moved on: a node that is taken for a root may point further
        onward = hooked.groupBy(F.col("old").alias("label")).agg(F.min("label").alias("further"))
        jumped = hooked.join(onward, "label", "left").select("node", "old", F.coalesce(F.least("label", "further"), "label").alias("label"))
        labels = materialize(jumped.select("node", "label", (F.col("old") != F.col("label")).alias("moved")), "labels")
    return labels.select("node", F.col("label").alias("root"))
