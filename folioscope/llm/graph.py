"""Connected components by label propagation with pointer jumping, every round cut by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id each linked id is connected to; unlinked ids are not returned.

    Rounds: every id takes the smallest label among its neighbours, then the label of its label. The
    number of rounds grows with the logarithm of the longest chain; minima are combined map-side, so a
    hub is no hot group.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    e = cut(e.union(e.select("v", "u")).distinct())
    labels = cut(e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        seen = e.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(seen, "u").select("u", "label", F.least("label", "near").alias("next"))
        jump = step.join(labels.select(F.col("u").alias("next"), F.col("label").alias("far")), "next", "left").select("u", "label", F.least("next", F.coalesce("far", "next")).alias("next"))
        jump = cut(jump)
        changed = jump.where("next != label").limit(1).count()
        labels = jump.select("u", F.col("next").alias("label"))
        if not changed:
            return labels.select(F.col("u").alias("id"), F.col("label").alias("component"))
