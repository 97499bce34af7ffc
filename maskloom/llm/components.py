"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.store import dropped, saved


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b): label is the smallest id that can be reached.

    Each round takes the smallest label among neighbours (pre-aggregated in the tasks), then the
    label of that label. Nothing but the number of changed labels reaches the driver. Links that run
    both ways, repeat or lead from an id to itself do no harm; no links give no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = saved(both, "links")
    now = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(now.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = now.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        jump = now.select(F.col("id").alias("new"), F.col("label").alias("far"))
        step = step.join(jump, "new").select("id", F.least("new", "far").alias("new"), "label")
        step = saved(step.select("id", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")), "labels")
        dropped(now)
        now = step
        if not now.where("moved").count():
            dropped(both)
            return now.select("id", "label")
