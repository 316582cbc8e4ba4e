"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import dropped, saved


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of `links` (a, b): `component` is the smallest node that is reachable.

    Rounds of the smallest label among neighbours, then a jump to that label's own label, until nothing changes. Each round is a table in the shared folder.
    Null ends are ignored; repeated links and loops change nothing; no links give no rows.
    """
    links = links.where("a is not null and b is not null")
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        after = saved(low.join(jump, "low").select("node", "was", F.least("low", "jump").alias("component")), "labels")
        changed = after.where("was <> component").limit(1).count()
        dropped(labels)
        labels = after
        if not changed:
            dropped(both)
            return labels.select("node", "component")
