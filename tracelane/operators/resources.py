"""What is observed per resource. Differences can come from case mix or recording; they do not rate anybody."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.functions.time import mean_hours
from tracelane.operators.quantiles import event_spread, of_kind


def resources(frame: DataFrame, cases: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """Per resource: events, cases, activities, waits, processing, mean duration of its cases, rework rate, top activities, department.

    Empty if no event has a resource. Ties of the top three and of the modal department go to the smaller name.
    """
    if "resource" not in frame.columns:
        return frame.sparkSession.createDataFrame([], "resource string, events long")
    own = frame.where("resource IS NOT NULL")
    base = own.groupBy("resource").agg(
        F.count("*").alias("events"), mean_hours("wait_us").alias("mean_wait_h"), mean_hours("proc_us").alias("mean_proc_h"),
        (100 * F.count_if(F.col("occurrence") > 0) / F.count("*")).alias("rework_rate_pct"),
    )
    spread = event_spread(frame, ["resource"]) if spread is None else spread
    base = base.join(of_kind(spread, "resource", {"median_wait_h": 0.5}, "resource"), "resource", "left")
    joined = own.select("resource", "case_id").distinct().join(cases.select("case_id", "duration_us"), "case_id")
    per_case = joined.groupBy("resource").agg(F.count("*").alias("cases"), mean_hours("duration_us").alias("mean_case_duration_h"))
    steps = own.groupBy("resource", "activity").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("resource").orderBy(F.desc("n"), "activity"))
    tops = steps.withColumn("place", place).groupBy("resource").agg(
        F.count("*").alias("activities"), F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "activity")))), lambda x: x.activity).alias("top_activities")
    )
    out = base.join(per_case, "resource").join(tops, "resource")
    if "department" not in frame.columns:
        return out.withColumn("department", F.lit(None).cast("string"))
    counted = own.where("department IS NOT NULL").groupBy("resource", "department").agg(F.count("*").alias("n"))
    modal = counted.groupBy("resource").agg(F.min(F.struct(-F.col("n"), "department")).alias("m")).select("resource", "m.department")
    return out.join(modal, "resource", "left")


def available(frame: DataFrame) -> bool:
    return "resource" in frame.columns and not frame.where("resource IS NOT NULL").isEmpty()


