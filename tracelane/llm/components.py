"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import Scratch


def reach(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(set, label) of the sets in ``links`` (a, b): the smallest set that their links reach, itself included.

    Each round a set takes the smallest label next to it and then its label's label, so a chain of n links takes about
    log n rounds. No links give no rows; repeated links and links of a set with itself are harmless.
    """
    both = scratch.save(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"both{label}")
    now = both.groupBy(F.col("a").alias("set")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    now, turn = scratch.save(now, f"labels{label}-0"), 0
    while True:
        turn += 1
        near = both.join(now.withColumnRenamed("set", "b"), "b").groupBy(F.col("a").alias("set")).agg(F.min("label").alias("near"))
        step = now.join(near, "set").select("set", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("set").alias("label"), F.col("label").alias("next"))
        step = scratch.save(step.join(jump, "label").select("set", "before", F.least("label", "next").alias("label")), f"labels{label}-{turn}")
        settled = step.where("label <> before").isEmpty()
        now = step.select("set", "label")
        if settled:
            return now
