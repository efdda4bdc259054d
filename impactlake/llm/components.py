"""Connected components of a link table, by hooking to minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stage


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a long, b long); component: its smallest id.

    Each round every node takes the smallest label among its neighbours' and its own
    (an aggregation that combines before it shuffles, so hubs do not matter), then
    the label of its label.  Rounds end when no label changes; each is written to the
    shared folder.  No links: no rows.  Loops and repeated links do no harm.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "cc-links")
    held = labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "cc-0")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("low"))
        hooked = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "low").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("component").alias("top"))
        new = hooked.join(up, "c", "left").select("id", "was", F.least("c", F.coalesce("top", "c")).alias("component"))
        new = stage(new, "cc-round")
        done = new.filter("was <> component").limit(1).count() == 0
        dropped(held)
        held, labels = new, new.select("id", "component")
        if done:
            dropped(both)
            return labels
