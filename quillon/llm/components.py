"""Connected components by DataFrame joins: every node gets the smallest id of its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import materialise, release


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, label). Rounds hook nodes and their labels' nodes (FastSV), until none changes, however long a chain is.

    Each round a node takes the least of its label, its label's label and its neighbours' labels' labels; the last goes to the
    node that its label names too, so whole trees of labels move at once and a shuffled chain takes about log2 of its length.
    Links and labels stay distributed, and each round's labels are written, so no lineage grows; the round before is deleted.
    A link from a node to itself gives the node a label; links with a null end give none; no links give an empty table.
    """
    links = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    both = materialise(links.union(links.select("b", "a")).distinct(), "links")
    labels = table = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        grand = labels.join(jump, "label").select("node", "label", "further")
        near = both.join(grand.select(F.col("node").alias("b"), "further"), "b").groupBy(F.col("a").alias("node")).agg(F.min("further").alias("near"))
        own = F.struct(F.col("node"), F.col("label").alias("old"), F.least("label", "further", "near").alias("label"))
        hook = F.struct(F.col("label").alias("node"), F.lit(None).cast("long").alias("old"), F.col("near").alias("label"))
        offers = grand.join(near, "node").select(F.explode(F.array(own, hook)).alias("o")).select("o.*")
        following = materialise(offers.groupBy("node").agg(F.max("old").alias("old"), F.min("label").alias("label")), "labels")
        changed = following.filter("old <> label").limit(1).count()
        release(table)
        table, labels = following, following.select("node", "label")
        if not changed:
            release(both)
            return labels
