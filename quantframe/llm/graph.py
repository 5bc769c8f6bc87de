"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, component (its smallest node), for the nodes that have links.

    Each round a node takes the smallest label among its neighbours, then the label of that label, so long chains halve.
    A node with very many links is a hot key of a plain sort-merge join, which adaptive execution splits, and its incoming
    labels are reduced before the exchange.
    """
    both = materialise(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(labels, both["a"] == labels["node"]).groupBy("b").agg(F.min("component").alias("heard"))
        near = labels.join(heard, labels["node"] == heard["b"], "left").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("now"))
        of = labels.select(F.col("node").alias("now"), F.col("component").alias("beyond"))
        moved = materialise(near.join(of, "now", "left").select("node", "was", F.least("now", "beyond").alias("component")), "labels")
        if moved.filter("was <> component").limit(1).count() == 0:
            return moved.select("node", "component")
        labels = moved.select("node", "component")
