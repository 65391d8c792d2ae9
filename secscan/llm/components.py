"""Connected components of a link table by label propagation with shortcuts, lineage cut at every pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secscan.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): label is the smallest node of the component.

    A pass takes each node's smallest neighbouring label, then its label's label.  Rows per pass are those of the
    links; a node with very many links is one key of a join that adaptive execution splits, and one combined minimum.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")), "labels")
    if labels.isEmpty():
        discard(both)
        return labels
    last = labels
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "m").alias("m"))
        up = labels.select(F.col("node").alias("m"), F.col("label").alias("up"))
        new = written(step.join(up, "m").select("node", F.col("label").alias("old"), F.least("m", "up").alias("label")), "labels")
        discard(last)
        labels, last = new.select("node", "label"), new
        if new.filter("label < old").isEmpty():
            discard(both)
            return labels
