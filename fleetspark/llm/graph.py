"""Connected components of an edge table, by rounds of smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import cut
from fleetspark.sources.storage import drop, shuffled, written

#: Rows up to which a table is sent to all tasks and worked on in ``SLIM`` of them: a hundred shuffles of a few rows each
#: through all partitions cost more than the work.
FEW, SLIM = 100_000, 8


def few(df: DataFrame) -> bool:
    """Whether ``df`` has no more than ``FEW`` rows."""
    return df.limit(FEW + 1).count() <= FEW


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b), undirected; a component is its smallest node.

    Each round gives a node the smallest label of its neighbours and then the label of that label, so
    long chains halve; labels only fall, so the rounds end. Labels stay in tables, written anew each round: a checkpoint would carry on the
    product of its inputs' estimated sizes, a number whose digits double each round and fill the driver. Only the number of
    changed rows comes to the driver.
    Loops and repeated edges do no harm; an empty table gives an empty table. Few edges go through few tasks.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    slim, sent = (lambda df: df.coalesce(SLIM), F.broadcast) if few(both) else (lambda df: df, shuffled)
    both = slim(both)
    labels, path = written(slim(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))))
    while True:
        offered = slim(both.join(sent(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offer")))
        lower = labels.join(sent(offered), "node", "left").select("node", F.col("component").alias("old"), F.least("component", "offer").alias("near"))
        hop = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        after, new = written(lower.join(sent(hop), "near", "left").select("node", "old", F.least("near", "far").alias("component")))
        drop(edges.sparkSession, path)
        changed = after.filter("old <> component").limit(1).count()
        labels, path = after.select("node", "component"), new
        if not changed:
            return labels
