"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

HUB = 1000  # links of one id that a task takes


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in ``links`` (columns a, b): label is the least id of its component.

    Labels travel over links and then jump to their own label, so long chains halve each
    round. The links of an id with more than HUB of them (a hub) are dealt to as many tasks as they need. Every
    round is written to the shared folder. No links give no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = stored(both)
    hubs = stored(both.groupBy("b").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1"))
    if not hubs.isEmpty():
        both = stored(both.join(hubs, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")))
    else:
        hubs, both = None, both.withColumn("part", F.lit(0))
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        told = labels.select(F.col("id").alias("b"), "label")
        if hubs is not None:  # a hub's label goes to all its tasks
            told = told.join(hubs, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
            near = both.join(told, ["b", "part"])
        else:
            near = both.join(told, "b")
        near = near.groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        # many ids have the label of a large component: heads are few where they matter, and taken once each
        heads = labels.select(F.col("id").alias("label"), F.col("label").alias("head"))
        changed = heads.where("label != head")
        new = stored(
            labels.join(near, "id").join(changed, "label", "left").select("id", F.col("label").alias("old"), F.least("label", "near", "head").alias("label"))
        )
        labels = new.select("id", "label")
        if new.where("label != old").isEmpty():
            return labels
