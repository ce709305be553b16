"""The directly-follows graph and per-activity, per-transition and per-case metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.functions.time import hours, mean_hours
from tracelane.operators.quantiles import event_spread, in_hours, of_kind, quantiles


def _total(cases: DataFrame):
    return cases.agg(F.count("*")).scalar()


def edges(frame: DataFrame, cases: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """Per pair of neighbours: frequency, cases, share of cases, and mean, median and P90 of the time between.

    Distinct cases are counted by the first row of each (case, pair), within the frame's partitioning. ``spread``: the
    frame's ``event_spread``, if it is known already.
    """
    pair = W.partitionBy("case_id", "prev_activity", "activity").orderBy("ts_us", "source_row")
    steps = frame.where("prev_activity IS NOT NULL").withColumn("first_in_case", F.row_number().over(pair) == 1)
    found = steps.groupBy("prev_activity", "activity").agg(
        F.count("*").alias("frequency"), F.count_if("first_in_case").alias("cases"), mean_hours("gap_us").alias("mean_h"),
    )
    return _with_gaps(frame, found, spread).select(
        F.concat("prev_activity", F.lit("→"), "activity").alias("id"), F.col("prev_activity").alias("source"), F.col("activity").alias("target"), "frequency", "cases",
        (100 * F.col("cases") / _total(cases)).alias("case_pct"), "mean_h", "median_h", "p90_h",
    )


def _with_gaps(frame: DataFrame, found: DataFrame, spread: DataFrame | None) -> DataFrame:
    spread = event_spread(frame, ["pair"]) if spread is None else spread
    return found.join(of_kind(spread, "pair", {"median_h": 0.5, "p90_h": 0.9}, "prev_activity", "activity"), ["prev_activity", "activity"])


def activity_metrics(frame: DataFrame, cases: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """Per activity: frequency, cases, waits before it, processing time, mean position and repeats."""
    spread = event_spread(frame, ["wait", "proc"]) if spread is None else spread
    found = frame.groupBy("activity").agg(
        F.count("*").alias("frequency"), F.count_if(F.col("occurrence") == 0).alias("cases"), mean_hours("wait_us").alias("mean_wait_h"),
        mean_hours("proc_us").alias("mean_proc_h"), F.avg("pos").alias("mean_pos"), F.count_if(F.col("occurrence") > 0).alias("repeats"),
    )
    found = found.join(of_kind(spread, "wait", {"median_wait_h": 0.5, "p90_wait_h": 0.9}, "activity"), "activity", "left").join(of_kind(spread, "proc", {"median_proc_h": 0.5}, "activity"), "activity", "left")
    return found.select(
        "activity", "frequency", "cases", (100 * F.col("cases") / _total(cases)).alias("case_pct"), "mean_wait_h", "median_wait_h", "p90_wait_h",
        "mean_proc_h", "median_proc_h", "mean_pos", "repeats",
    )


def start_end(cases: DataFrame) -> DataFrame:
    """Per activity that starts or ends a case: how many, and their share."""
    both = cases.select(F.explode(F.array(F.struct(F.col("first_activity").alias("activity"), F.lit("start").alias("at")), F.struct(F.col("last_activity").alias("activity"), F.lit("end").alias("at")))).alias("x"))
    counted = both.groupBy("x.activity").agg(F.count_if(F.col("x.at") == "start").alias("start_count"), F.count_if(F.col("x.at") == "end").alias("end_count"))
    total = _total(cases)
    return counted.withColumns({"start_pct": 100 * F.col("start_count") / total, "end_pct": 100 * F.col("end_count") / total})


def top_start_end(cases: DataFrame, most: int = 5) -> DataFrame:
    """One row: ``start_activities`` and ``end_activities``, the most frequent ones with their counts, ties by name."""

    def top(count: str) -> Column:
        own = F.filter(F.collect_list(F.struct((-F.col(count)).alias("n"), "activity")), lambda x: x.n < 0)
        return F.transform(F.slice(F.array_sort(own), 1, most), lambda x: F.struct(x.activity.alias("activity"), (-x.n).alias("cases")))

    return start_end(cases).agg(top("start_count").alias("start_activities"), top("end_count").alias("end_activities"))


def nodes(frame: DataFrame, cases: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """``activity_metrics`` with how many cases start and end at the activity."""
    ends = start_end(cases).select("activity", "start_count", "end_count")
    zero = F.lit(0).cast("long")
    joined = activity_metrics(frame, cases, spread).join(ends, "activity", "left")
    counts = {c: F.coalesce(c, zero) for c in ("start_count", "end_count")}
    return joined.withColumns(counts | {"is_start": F.coalesce("start_count", zero) > 0, "is_end": F.coalesce("end_count", zero) > 0})


def filtered_graph(frame: DataFrame, cases: DataFrame, min_case_pct: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): edges of at least that rounded share of cases, and the nodes they touch."""
    kept = edges(frame, cases).where(F.round("case_pct", 2) >= min_case_pct)
    touched = kept.select(F.explode(F.array("source", "target")).alias("activity")).distinct()
    return nodes(frame, cases).join(touched, "activity", "left_semi"), kept


def transition_metrics(frame: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """Per pair of neighbours: frequency, and mean, median and P90 of the time between."""
    found = frame.where("prev_activity IS NOT NULL").groupBy("prev_activity", "activity").agg(F.count("*").alias("frequency"), mean_hours("gap_us").alias("mean_h"))
    return _with_gaps(frame, found, spread).select(F.col("prev_activity").alias("source"), F.col("activity").alias("target"), "frequency", "mean_h", "median_h", "p90_h")


def case_metrics(cases: DataFrame, ends: DataFrame, size: int | None = None, kept: bool = False) -> DataFrame:
    """One row of totals and durations; ``ends``: the completion activities; ``size``: the number of cases at most, if known; ``kept``: they are persisted."""
    done = cases.join(F.broadcast(ends.select(F.col("activity").alias("last_activity"), F.lit(True).alias("done"))), "last_activity", "left")
    finished = F.when(F.col("done"), F.col("duration_us"))
    both = done.select(F.explode(F.array(F.struct(F.lit("all").alias("kind"), F.col("duration_us").alias("v")), F.struct(F.lit("completed").alias("kind"), finished.alias("v")))).alias("x")).select("x.*")
    spread = quantiles(both, ["kind"], "v", size=None if size is None else 2 * size, kept=kept)
    found = done.agg(
        F.count("*").alias("total_cases"), F.count("done").alias("completed_cases"), (F.count("*") - F.count("done")).alias("incomplete_cases"),
        mean_hours("duration_us").alias("mean_duration_h"),
        hours(F.sum(finished) / F.count(finished)).alias("completed_mean_duration_h"),
        (F.sum("n_events") / F.count("*")).alias("mean_events_per_case"), F.sum("n_events").alias("total_events"), F.min("start_us").alias("first_event_us"), F.max("end_us").alias("last_event_us"),
    )
    names = {"median_duration_h": 0.5, "p90_duration_h": 0.9, "p95_duration_h": 0.95}
    own = spread.agg(
        *[F.max(F.when(F.col("kind") == "all", in_hours(F.col("q"), s))).alias(k) for k, s in names.items()],
        F.max(F.when(F.col("kind") == "completed", in_hours(F.col("q"), 0.5))).alias("completed_median_duration_h"),
    )
    return found.withColumn("__q", own.select(F.struct("*")).scalar()).select("*", "__q.*").drop("__q")
