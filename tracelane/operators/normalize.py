"""One label for all spellings of an activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.functions.size import bounded
from tracelane.functions.text import activity_key, tidy


def labels(events: DataFrame) -> DataFrame:
    """``key``, ``activity`` (its most frequent tidy spelling, ties to the first in order) and all ``spellings`` as supplied."""
    found = events.groupBy("original_activity").agg(F.count("*").alias("n"))
    spelled = found.withColumns({"key": activity_key("original_activity"), "tidy": tidy("original_activity")})
    best = spelled.groupBy("key", "tidy").agg(F.sum("n").alias("n")).withColumn("place", F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "tidy"))).where("place = 1")
    originals = spelled.groupBy("key").agg(F.array_sort(F.collect_set("original_activity")).alias("spellings"))
    return best.select("key", F.col("tidy").alias("activity")).join(originals, "key")


def normalize(events: DataFrame) -> DataFrame:
    """``events`` (with ``original_activity``) and the shared label as ``activity``; case ids become text without outer blanks.

    Spellings are folded once each. The map from spelling to label is a constant of the plan if it is small, so the log
    is not shuffled by a handful of hot labels; else it is joined, and adaptive execution may split it.
    """
    spelled = bounded(labels(events).select("activity", F.explode("spellings").alias("original_activity")))
    return events.drop("activity").withColumn("case_id", F.trim(F.col("case_id").cast("string"))).join(spelled, "original_activity")


def merges(events: DataFrame) -> DataFrame:
    """Labels that stand for several spellings."""
    return labels(events).where(F.size("spellings") > 1).select("activity", "spellings")
