"""Variants (cases of one exact trace), completion, and the dominant path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.config import DEFAULT, AnalysisConfig
from tracelane.functions.time import hours
from tracelane.operators.quantiles import FEW_ROWS, quantiles

#: Variants of equal count are ranked within cells of this mean duration.
CELL_US = 60_000_000


def variants(cases: DataFrame, size: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``trace``, ``trace_id``, ``last_activity``, ``case_count``, mean and median duration, ``rank``, ``variant_id``, ``pct``, ``cum_pct``.

    V1 is the most frequent variant; ties go to the shorter mean duration, then to the smallest case_id.

    ``size``: how many cases there are at most, if that is known. Up to FEW_ROWS of them, or without ``keep``, ranks are
    two-level: cells of equal count and equal whole minutes of mean duration are ordered among themselves, and variants
    within their cell. Beyond, with ``keep`` (which persists a table), variants are ranked by ranges, however many of them
    agree in count and duration; see ``ranges``. The results are the same.
    """
    found = cases.groupBy("trace_id").agg(
        F.count("*").alias("case_count"), (F.sum("duration_us") / F.count("*")).alias("mean_us"),
        F.min("case_id").alias("least_case"), F.first("trace").alias("trace"),
    )
    found = found.join(quantiles(cases, ["trace_id"], "duration_us", (0.5,), size), "trace_id").withColumn("cell", F.floor(F.col("mean_us") / CELL_US))
    large = keep is not None and (size is None or size > FEW_ROWS)
    ranked = ranges(found, keep) if large else two_level(found)
    return ranked.select(
        "trace", "trace_id", F.element_at("trace", -1).alias("last_activity"), "case_count", hours("mean_us").alias("mean_duration_h"), hours(F.col("q")[0]).alias("median_duration_h"),
        "rank", F.concat(F.lit("V"), "rank").alias("variant_id"), (100 * F.col("case_count") / F.col("total_cases")).alias("pct"),
        (100 * F.col("cases_upto") / F.col("total_cases")).alias("cum_pct"), "total_cases",
    )


def two_level(found: DataFrame) -> DataFrame:
    """``found`` with ``rank``, ``cases_upto`` and ``total_cases``, from ranks of cells and ranks within a cell."""
    cells = found.groupBy("case_count", "cell").agg(F.count("*").alias("n"), F.sum("case_count").alias("n_cases"))
    order = W.orderBy(F.desc("case_count"), "cell")
    above = order.rowsBetween(W.unboundedPreceding, -1)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    cells = cells.select(
        "case_count", "cell", F.coalesce(F.sum("n").over(above), zero).alias("rank_above"),
        F.coalesce(F.sum("n_cases").over(above), zero).alias("cases_above"), F.sum("n_cases").over(whole).alias("total_cases"),
    )
    inside = W.partitionBy("case_count", "cell").orderBy("mean_us", "least_case")
    ranked = found.join(cells, ["case_count", "cell"]).withColumn("place", F.row_number().over(inside))
    return ranked.withColumns({"rank": F.col("rank_above") + F.col("place"), "cases_upto": F.col("cases_above") + F.col("place") * F.col("case_count")})


def ranges(found: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same from ranges of the whole order, which ends with the smallest case, so no two variants are equal in it.

    Spark cuts the order into ranges of about equal size and sorts each; a variant's place in its range and what the
    ranges before it hold give its rank. Both readings must see the same ranges, so the ranges are kept: a part that is lost
    is made again from the same cuts.
    """
    order = [F.desc("case_count"), F.asc("mean_us"), F.asc("least_case")]
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = keep(dealt.withColumns({"part": F.shiftright("at", 33), "place": F.col("at").bitwiseAND((1 << 33) - 1) + 1}))
    above = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum("case_count").alias("cases"))  # a row for each range
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(above), zero).alias("rank_above"), F.coalesce(F.sum("cases").over(above), zero).alias("cases_above"), F.sum("cases").over(whole).alias("total_cases"))
    upto = F.sum("case_count").over(W.partitionBy("part").orderBy("place"))
    return dealt.withColumn("cases_upto", upto).join(sizes, "part").withColumns({"rank": F.col("rank_above") + F.col("place"), "cases_upto": F.col("cases_above") + F.col("cases_upto")})


def variant_summary(found: DataFrame) -> DataFrame:
    """One row: number of variants, most common one, coverage of the first ten, how many cover 80 %, singletons."""
    count = F.count("*")
    return found.agg(
        count.alias("unique_variants"), F.min_by("trace", "rank").alias("most_common"), F.max("pct").alias("most_common_pct"),
        F.coalesce(F.sum(F.when(F.col("rank") <= 10, F.col("pct"))), F.lit(0.0)).alias("top10_coverage_pct"),
        F.least(F.count_if(F.col("cum_pct") < 80) + 1, count).alias("variants_for_80pct"), F.count_if(F.col("case_count") == 1).alias("singletons"),
    )


def end_shares(cases: DataFrame) -> DataFrame:
    """``last_activity``, ``n`` and ``share`` of the cases that end with it."""
    ends = cases.groupBy("last_activity").agg(F.count("*").alias("n"))
    return ends.withColumn("share", F.col("n") / ends.agg(F.sum("n")).scalar())


def completion(cases: DataFrame, found: DataFrame | None = None, config: AnalysisConfig = DEFAULT) -> DataFrame:
    """``activity``: what ends a completed case. At most 1 / completion_share rows unless configured, and one more.

    If ``found`` (variants) is given and nothing was configured, the last step of the dominant path belongs to it.
    """
    if config.completion:
        return cases.sparkSession.createDataFrame([(x,) for x in config.completion], "activity string")
    own = end_shares(cases).where(F.col("share") >= config.completion_share).select(F.col("last_activity").alias("activity"))
    if found is None:
        return own
    return with_dominant(own, first_completed(found, own))


def with_dominant(ends: DataFrame, dominant: DataFrame) -> DataFrame:
    """``ends`` and the last step of the dominant path."""
    return ends.unionByName(dominant.select(F.col("last_activity").alias("activity"))).distinct()


def first_completed(found: DataFrame, ends: DataFrame) -> DataFrame:
    """The first variant that ends with one of ``ends``, else the first of all: one row, none for an empty log."""
    marked = found.join(F.broadcast(ends.withColumn("done", F.lit(True))), F.col("last_activity") == F.col("activity"), "left")
    return marked.orderBy(F.col("done").isNull(), "rank").limit(1).select(*found.columns)


def first_of_cases(cases: DataFrame, ends: DataFrame) -> DataFrame:
    """``trace`` and ``last_activity`` of ``first_completed``, without ranking all variants."""
    found = cases.groupBy("trace_id").agg(F.count("*").alias("n"), (F.sum("duration_us") / F.count("*")).alias("mean_us"), F.min("case_id").alias("least_case"), F.first("trace").alias("trace"))
    found = found.withColumn("last_activity", F.element_at("trace", -1))
    marked = found.join(F.broadcast(ends.withColumn("done", F.lit(True))), F.col("last_activity") == F.col("activity"), "left")
    return marked.orderBy(F.col("done").isNull(), F.desc("n"), "mean_us", "least_case").limit(1).select("trace", "last_activity")


def dominant_path(found: DataFrame, cases: DataFrame, config: AnalysisConfig = DEFAULT) -> DataFrame:
    """The first variant that ends a completed case, else the first of all: one row, none for an empty log."""
    return first_completed(found, completion(cases, None, config))
