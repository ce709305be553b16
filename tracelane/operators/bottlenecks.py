"""Ranking of activities by the waiting before them, and the slowest transitions."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.config import DEFAULT, AnalysisConfig
from tracelane.functions.time import hours, mean_hours
from tracelane.operators.quantiles import event_spread, micros, of_kind


def wait_stats(frame: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """Per activity what the score is made of; scoring with other weights can start here.

    A wait counts as long beyond the P90 of all waits of the log; a case counts once per activity.
    """
    waits = frame.where("wait_us IS NOT NULL")
    spread = event_spread(frame, ["wait", "proc", "log"]) if spread is None else spread
    log_p90 = spread.where("kind = 'log'").agg(F.coalesce(F.max(micros(F.col("q"), 0.9)), F.lit(0.0))).scalar()
    late = waits.where(F.col("wait_us") > log_p90).select("activity", "case_id").distinct().groupBy("activity").agg(F.count("*").alias("long_wait_cases"))
    found = frame.groupBy("activity").agg(
        F.count("*").alias("frequency"), F.count_if(F.col("occurrence") == 0).alias("affected_cases"),
        mean_hours("wait_us").alias("mean_wait_h"), F.sum("wait_us").alias("sum_us"), mean_hours("proc_us").alias("mean_proc_h"), F.count_if(F.col("pos") == 0).alias("starts"),
    )
    found = found.join(of_kind(spread, "wait", {"median_wait_h": 0.5, "p90_wait_h": 0.9, "p95_wait_h": 0.95}, "activity"), "activity", "left")
    found = found.join(of_kind(spread, "proc", {"median_proc_h": 0.5}, "activity"), "activity", "left")
    every = W.partitionBy()
    return found.join(late, "activity", "left").select(
        "activity", "frequency", "affected_cases", F.coalesce("long_wait_cases", F.lit(0).cast("long")).alias("long_wait_cases"), "mean_wait_h",
        "median_wait_h", "p90_wait_h", "p95_wait_h", "mean_proc_h", "median_proc_h",
        (F.col("affected_cases") / F.sum("starts").over(every)).alias("case_coverage"),
        (hours("sum_us") / _or_one(hours(F.coalesce(F.sum("sum_us").over(every), F.lit(0))))).alias("wait_share"),
    )


def _or_one(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(x)


def score(stats: DataFrame, config: AnalysisConfig = DEFAULT) -> DataFrame:
    """``stats`` with the five scaled components, ``score``, ``indicator`` and ``not_scored_reason``; one row per activity.

    Components are scaled from 0 to 1 over the scored activities; a constant one is 0 everywhere. Without any processing
    time its weight goes to the others. The indicator looks at the exact score, the order at the rounded one.
    """
    scored = (F.col("frequency") >= config.min_activity_support) & F.col("median_wait_h").isNotNull()
    every = W.partitionBy()
    has_proc = F.max(F.col("mean_proc_h").isNotNull()).over(every)
    weights = asdict(config.weights)
    sources = {"median_wait": "median_wait_h", "p90_wait": "p90_wait_h", "processing": "median_proc_h", "case_coverage": "case_coverage", "wait_share": "wait_share"}

    def scaled(name: str) -> Column:
        own = F.when(scored, F.col(name))
        low, span = F.min(own).over(every), F.max(own).over(every) - F.min(own).over(every)
        return F.when(scored, F.coalesce(F.when(span >= 1e-12, (own - low) / span), F.lit(0.0)))

    parts = stats.withColumns({f"c_{k}": scaled(v) for k, v in sources.items()} | {"has_proc": has_proc})
    weight = {k: F.when(F.col("has_proc"), F.lit(v)).otherwise(F.lit(0.0)) if k == "processing" else F.lit(v) for k, v in weights.items()}
    total = _or_one(sum((weight[k] for k in sources), F.lit(0.0)))
    exact = sum((weight[k] * F.col(f"c_{k}") for k in sources), F.lit(0.0)) / total
    parts = parts.withColumn("exact", exact)
    level = F.when(F.col("exact") >= config.high, "HIGH").when(F.col("exact") >= config.medium, "MEDIUM").when(F.col("exact").isNotNull(), "LOW").otherwise("NOT_SCORED")
    reason = F.when(F.col("exact").isNotNull(), None).when(F.col("median_wait_h").isNull(), "No waiting time (only occurs as first event)").otherwise(f"Fewer than {config.min_activity_support} events")
    return parts.withColumns({"score": F.round("exact", 3), "indicator": level, "not_scored_reason": reason}).drop("exact")


def ranked(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc_nulls_last("score"), "activity")


def slow_transitions(frame: DataFrame, config: AnalysisConfig = DEFAULT, limit: int = 10, spread: DataFrame | None = None) -> DataFrame:
    """The transitions of most median time, of those with enough events. Their share is of all waiting, so it may exceed 100."""
    total = _or_one(hours(F.coalesce(F.lit(frame.agg(F.sum("wait_us")).scalar()), F.lit(0))))
    spread = event_spread(frame, ["pair"]) if spread is None else spread
    found = frame.where("prev_activity IS NOT NULL").groupBy(F.col("prev_activity").alias("source"), F.col("activity").alias("target"))
    found = found.agg(F.count("*").alias("frequency"), F.sum("gap_us").alias("sum_us")).where(F.col("frequency") >= config.min_activity_support)
    found = found.join(of_kind(spread, "pair", {"median_h": 0.5, "p90_h": 0.9}, "source", "target"), ["source", "target"])
    found = found.select("source", "target", "frequency", "median_h", "p90_h", (100 * hours("sum_us") / total).alias("wait_share_pct"))
    return found.orderBy(F.desc("median_h"), "source", "target").limit(limit)
