"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import discard, written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the links: root is the smallest node reachable.

    Labels fall to the least label among neighbours and then to the label of
    that label, so paths halve each round. A round joins, takes minima by a
    map-side combine and writes its labels to the shared folder; nothing but the
    number of changed labels reaches the driver.
    """
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = ends.union(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node <> other").distinct()
    both, both_path = written(both, "links")
    start = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root"))
    labels, path = written(start, "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("via")), "other")
                .groupBy("node").agg(F.min("via").alias("near")))
        down = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("root").alias("jump"))
        step = down.join(jump, "now").select("node", F.least("now", "jump").alias("root"), "was")
        after, after_path = written(step, "labels")
        changed = after.where("root <> was").limit(1).count()
        discard(labels.sparkSession, path)
        labels, path = after.select("node", "root"), after_path
        if not changed:
            discard(labels.sparkSession, both_path)
            return labels
