"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import is_empty, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): the smallest node of each component. Links with a null end are left out.

    Each round takes the least label among the neighbours, then jumps to the label's own label, until a round changes
    nothing. Rounds are written to the shared folder, and every join is between two written tables, so that Spark can
    split the partitions of nodes with very many links.
    """
    links = links.where("a is not null and b is not null and a <> b")
    both = materialize(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("root")))
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "dst"), "dst")
            .select(F.col("src").alias("node"), "root")
            .union(labels)
            .groupBy("node")
            .agg(F.min("root").alias("root"))
        )
        heard = materialize(heard)
        far = heard.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = heard.join(far, "root").select("node", F.least("root", "far").alias("root"))
        before = labels.select("node", F.col("root").alias("was"))
        after = materialize(jumped.join(before, "node").select("node", "root", (F.col("root") != F.col("was")).alias("moved")))
        labels = after.select("node", "root")
        if is_empty(after.where("moved")):
            return labels
