"""The event frame: a log in case order with its timing columns; and cases, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.functions.size import bounded
from tracelane.functions.time import micros


#: Events of a case that one task should hold in order, and cuts of a case that has more.
SEGMENT_EVENTS, SEGMENTS = 1_000_000, 100


def event_frame(events: DataFrame) -> DataFrame:
    """``events`` with ``ts_us``, ``pos``, ``prev_activity``, ``gap_us``, ``wait_us``, ``proc_us``, ``occurrence``.

    A case is ordered by timestamp, then source_row. ``gap_us``: since the previous event. ``wait_us``: the same up to
    the start of this event where ``start_timestamp`` is known, never below 0. ``proc_us``: from that start on.
    ``occurrence``: how often the case had this activity before. What a first event lacks is null.

    One shuffle, by case_id: the windows by (case_id, activity) sort within it.
    """
    timed = _timed(events)
    case = W.partitionBy("case_id").orderBy("ts_us", "source_row")
    same = W.partitionBy("case_id", "activity").orderBy("ts_us", "source_row")
    placed = timed.withColumns({
        "pos": (F.row_number().over(case) - 1).cast("long"),
        "prev_activity": F.lag("activity").over(case),
        "prev_us": F.lag("ts_us").over(case),
        "occurrence": (F.row_number().over(same) - 1).cast("long"),
    })
    return _with_gaps(placed)


def segmented_frame(events: DataFrame, segment: int = SEGMENT_EVENTS) -> DataFrame:
    """``event_frame`` for logs with cases of more than ``segment`` events, which are cut by time and dealt to several tasks.

    A long case is cut at SEGMENTS - 1 places of about equal spacing in its events; equal times stay together. Windows run
    within the cuts. What they need of earlier ones is carried over: the number of events, the last one, and how often
    each activity occurred, a row for each cut. Other cases are one cut each, as before.

    Costs beside ``event_frame``: a job that counts the events of each case and finds the cuts of the long ones, which are
    constants of the plan if they are few, so that no event is shuffled for them; and a second reading of the long cases.
    """
    timed = _timed(events)
    long = timed.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") > segment).select("case_id")
    shares = F.array(*[F.lit(i / SEGMENTS) for i in range(1, SEGMENTS)])
    cuts = timed.join(long, "case_id", "left_semi").groupBy("case_id").agg(F.percentile_approx("ts_us", shares, F.lit(10 * SEGMENTS)).alias("__cuts"))
    dealt = timed.join(bounded(cuts), "case_id", "left")
    own = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("ts_us"))), F.lit(0))
    dealt = dealt.withColumns({"__cut": own, "__long": F.col("__cuts").isNotNull()}).drop("__cuts")
    cut = W.partitionBy("case_id", "__cut").orderBy("ts_us", "source_row")
    same = W.partitionBy("case_id", "__cut", "activity").orderBy("ts_us", "source_row")
    placed = dealt.withColumns({
        "pos": (F.row_number().over(cut) - 1).cast("long"), "prev_activity": F.lag("activity").over(cut), "prev_us": F.lag("ts_us").over(cut), "occurrence": (F.row_number().over(same) - 1).cast("long"),
    })

    step = F.struct("ts_us", "source_row", "activity")
    steps = dealt.where("__long").groupBy("case_id", "__cut", "activity").agg(F.count("*").alias("n"), F.max(step).alias("last"))
    before = W.partitionBy("case_id", "activity").orderBy("__cut").rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    carried = steps.groupBy("case_id", "__cut").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.map_from_entries(F.collect_list(F.struct("activity", "earlier"))).alias("__earlier"))
    above = W.partitionBy("case_id").orderBy("__cut")
    carried = carried.select("case_id", "__cut", "__earlier", (F.sum("n").over(above) - F.col("n")).alias("__start"), F.lag("last").over(above).alias("__last"))
    joined = placed.join(carried, ["case_id", "__cut"], "left")
    first, zero = F.col("pos") == 0, F.lit(0).cast("long")
    whole = joined.withColumns({
        "prev_activity": F.when(first, F.col("__last.activity")).otherwise(F.col("prev_activity")), "prev_us": F.when(first, F.col("__last.ts_us")).otherwise(F.col("prev_us")),
        "occurrence": F.col("occurrence") + F.coalesce(F.try_element_at("__earlier", "activity"), zero), "pos": F.col("pos") + F.coalesce("__start", zero),
    })
    return _with_gaps(whole.select(*timed.columns, "pos", "prev_activity", "prev_us", "occurrence"))


def _timed(events: DataFrame) -> DataFrame:
    start = micros(events, "start_timestamp") if "start_timestamp" in events.columns else F.lit(None).cast("long")
    return events.withColumns({"ts_us": micros(events, "timestamp"), "start_us": start})


def _with_gaps(placed: DataFrame) -> DataFrame:
    wait = F.coalesce("start_us", "ts_us") - F.col("prev_us")
    return placed.withColumns({
        "gap_us": F.col("ts_us") - F.col("prev_us"),
        "wait_us": F.when(F.col("prev_us").isNotNull(), F.greatest(wait, F.lit(0).cast("long"))),
        "proc_us": F.col("ts_us") - F.col("start_us"),
    }).drop("prev_us")


def steps(events: DataFrame) -> DataFrame:
    """What ``cases`` reads of a frame, for a log whose frame nobody else needs."""
    return _timed(events).select("case_id", "ts_us", "source_row", "activity")


def trace_id(trace: str) -> Column:
    """16 bytes that tell a list of activities from any other."""
    return F.substring(F.unhex(F.sha2(F.to_json(trace), 256)), 1, 16)


def cases(frame: DataFrame) -> DataFrame:
    """One row per case: ``trace``, ``trace_id``, ``times_us``, ``start_us``, ``end_us``, ``duration_us``, ``n_events``, first and last activity.

    Reads the frame's partitioning by case_id, so it adds no shuffle. A case's events meet in one row. Equal traces have
    equal identifiers, and different ones differ (128 bits of SHA-256); what follows compares and joins those.
    """
    steps = F.array_sort(F.collect_list(F.struct("ts_us", "source_row", "activity")))
    folded = frame.groupBy("case_id").agg(steps.alias("steps"))
    folded = folded.select(
        "case_id", F.transform("steps", lambda s: s.activity).alias("trace"), F.transform("steps", lambda s: s.ts_us).alias("times_us"),
        F.element_at("steps", 1).ts_us.alias("start_us"), F.element_at("steps", -1).ts_us.alias("end_us"), F.size("steps").cast("long").alias("n_events"),
    )
    return folded.withColumns({
        "trace_id": trace_id("trace"),
        "duration_us": F.col("end_us") - F.col("start_us"),
        "first_activity": F.element_at("trace", 1),
        "last_activity": F.element_at("trace", -1),
    })
