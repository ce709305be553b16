"""Drill-downs and lookups over a ProcessLog."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.functions.size import bounded
from tracelane.functions.text import activity_key, casefold, likeness
from tracelane.functions.time import hours, iso_time
from tracelane.operators import bottlenecks, deviations, findings, ingest, mentions, normalize
from tracelane.operators.variants import variant_summary
from tracelane.plans.log import ProcessLog, by_frequency

MAX_PAGE, MAX_VARIANTS = 1000, 200


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in an order that must be total."""
    if offset < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"offset must not be negative, and limit must be 1 to {MAX_PAGE}")
    return rows.orderBy(*order).offset(offset).limit(limit)


@dataclass(frozen=True)
class Key:
    """A column of a total order; unknown values come last either way."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        return F.desc_nulls_last(self.column) if self.descending else F.asc_nulls_last(self.column)

    def same(self, value: object) -> Column:
        return F.col(self.column).isNull() if value is None else F.col(self.column) == F.lit(value)

    def beyond(self, value: object) -> Column:
        if value is None:  # nothing comes after the unknown ones
            return F.lit(False)
        c = F.col(self.column)
        return c.isNull() | (c < F.lit(value) if self.descending else c > F.lit(value))


def page_after(rows: DataFrame, keys: list[Key], after: tuple | None = None, limit: int = 100) -> DataFrame:
    """The ``limit`` rows that follow the row whose keys are ``after``, or the first ones; keys must tell all rows apart.

    Where ``page`` sorts and skips what came before, this filters it: a page far behind costs what the first one does, each
    task keeps ``limit`` rows, and rows that were added meanwhile do not shift later pages. ``key_of`` gives the next ``after``.
    """
    if not 1 <= limit <= MAX_PAGE or (after is not None and len(after) != len(keys)):
        raise ValueError(f"limit must be 1 to {MAX_PAGE}, and after must have a value for each key")
    if after is not None:
        ways, so_far = [], F.lit(True)
        for key, value in zip(keys, after, strict=True):
            ways.append(so_far & key.beyond(value))
            so_far = so_far & key.same(value)
        rows = rows.where(reduce(or_, ways))
    return rows.orderBy(*[k.order() for k in keys]).limit(limit)


def key_of(page: DataFrame, keys: list[Key]) -> tuple | None:
    """The keys of a page's last row, None if it has no row."""
    last = page.select(*[F.col(k.column) for k in keys]).tail(1)
    return tuple(last[0]) if last else None


BY_WAIT = [Key("wait_us", True), Key("case_id"), Key("pos")]


def closest(names: DataFrame, wanted: str, cutoff: float) -> str | None:
    """Of ``name``, ``key`` the name whose key is or comes nearest to ``wanted`` and is at least ``cutoff`` like it."""
    rated = names.withColumn("like", F.when(F.col("key") == wanted, 2.0).otherwise(likeness("key", wanted)))
    best = rated.where(F.col("like") >= cutoff).orderBy(F.desc("like"), F.desc("key"), "name").select("name").first()
    return best.name if best else None


def resolve_activity(log: ProcessLog, name: str, cutoff: float = 0.75) -> str | None:
    """The activity of that key, else the closest spelling by Ratcliff-Obershelp ratio; the distinct names are rated in tasks."""
    names = log.frame.select(F.col("activity").alias("name")).distinct().withColumn("key", activity_key("name"))
    return closest(names, log.events.sparkSession.range(1).select(activity_key(F.lit(name)).alias("key")).first().key, cutoff)


def resolve_resource(log: ProcessLog, name: str, cutoff: float = 0.6) -> str | None:
    """The resource of that name in any case, else the closest spelling."""
    names = log.frame.where("resource IS NOT NULL").select(F.col("resource").alias("name")).distinct().withColumn("key", casefold("name"))
    return closest(names, name.casefold(), cutoff)


def variant_cases(log: ProcessLog, variant_id: str) -> DataFrame:
    """Cases of a variant; page them by duration descending, then case_id."""
    one = log.variants.where(F.col("variant_id") == variant_id).select("trace_id", "variant_id")
    return log.cases.join(one, "trace_id").select("case_id", "variant_id", hours("duration_us").alias("duration_h"), "n_events")


def events_at(log: ProcessLog, activity: str | None = None, source: str | None = None, target: str | None = None, resource: str | None = None) -> DataFrame:
    """Events of an activity, of a transition, or of a resource; all given conditions hold."""
    wanted = {"activity": activity if activity is not None else target, "prev_activity": source, "resource": resource}
    out = log.frame
    for column, value in wanted.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def by_wait(rows: DataFrame) -> list[Column]:
    return [F.desc_nulls_last("wait_us"), F.col("case_id"), F.col("pos")]


def by_time(rows: DataFrame) -> list[Column]:
    return [F.col("ts_us"), F.col("case_id"), F.col("pos")]


def deviation_rows(log: ProcessLog, type: str | None = None, activity: str | None = None, case_id: str | None = None) -> DataFrame:
    out = log.deviations
    for column, value in (("type", type), ("activity", activity), ("case_id", case_id)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def count_cases(
    log: ProcessLog, has_activity: str | None = None, deviation_type: str | None = None, deviation_activity: str | None = None,
    min_hours: float | None = None, max_hours: float | None = None, variant_id: str | None = None,
) -> DataFrame:
    """One row: ``count``, ``total_cases``, ``pct`` of the cases that meet all given conditions. Type and activity of a deviation must meet on one record."""
    rows, total = log.cases, log.cases.agg(F.count("*")).scalar()
    if has_activity is not None:
        rows = rows.where(F.array_contains("trace", has_activity))
    if min_hours is not None:
        rows = rows.where(hours("duration_us") >= float(min_hours))
    if max_hours is not None:
        rows = rows.where(hours("duration_us") <= float(max_hours))
    if deviation_type is not None or deviation_activity is not None:
        rows = rows.join(deviation_rows(log, deviation_type, deviation_activity).select("case_id"), "case_id", "left_semi")
    if variant_id is not None:
        rows = rows.join(log.variants.where(F.col("variant_id") == variant_id).select("trace_id"), "trace_id", "left_semi")
    return rows.agg(F.count("*").alias("count")).withColumns({"total_cases": total, "pct": F.try_divide(100 * F.col("count"), total)})


def case_detail(log: ProcessLog, case_id: str) -> dict[str, DataFrame]:
    """``events``, ``case`` (with its variant) and ``deviations`` of one case; the filter reaches the scan."""
    one = log.cases.where(F.col("case_id") == case_id)
    return {
        "events": log.frame.where(F.col("case_id") == case_id).orderBy("pos"),
        "case": one.join(log.variants.select("trace_id", "variant_id"), "trace_id"),
        "deviations": deviation_rows(log, case_id=case_id),
    }


def _known(log: ProcessLog, name: str) -> str:
    found = resolve_activity(log, name)
    if found is None:
        raise LookupError(f"No activity is like '{name}'.")
    return found


def activity_stats(log: ProcessLog, activity: str) -> DataFrame:
    """Metrics and bottleneck score of the activity of that name or the closest one."""
    own = log.activities().where(F.col("activity") == _known(log, activity))
    return own.join(log.bottlenecks.select("activity", "score", "indicator", "long_wait_cases", "wait_share"), "activity", "left")


def transition_stats(log: ProcessLog, source: str, target: str) -> DataFrame:
    """Metrics of the transition between the activities of these names or the closest ones; no row if there is none."""
    return log.transitions().where((F.col("source") == _known(log, source)) & (F.col("target") == _known(log, target)))


def top_bottlenecks(log: ProcessLog, limit: int = 5) -> DataFrame:
    return bottlenecks.ranked(log.bottlenecks.where("score IS NOT NULL")).limit(max(1, min(limit, 20)))


def bottleneck_report(log: ProcessLog, limit: int = 5) -> dict[str, DataFrame]:
    """Scored activities, ``limit`` from 1 to 20 of them, and the five slowest transitions."""
    return {"activities": top_bottlenecks(log, limit), "slow_transitions": log.slow_transitions(5)}


def top_variants(log: ProcessLog, limit: int = 5) -> DataFrame:
    return log.variants.where(F.col("rank") <= max(1, min(limit, 20))).orderBy("rank")


def variants_page(log: ProcessLog, offset: int = 0, limit: int = 50) -> dict[str, DataFrame]:
    """``summary`` of all variants and a page of 1 to 200 of them by rank; ranks need no sort to be paged."""
    if offset < 0 or not 1 <= limit <= MAX_VARIANTS:
        raise ValueError(f"offset must not be negative, and limit must be 1 to {MAX_VARIANTS}")
    return {"summary": variant_summary(log.variants), "items": log.variants.where(F.col("rank").between(offset + 1, offset + limit)).orderBy("rank")}


def metrics(log: ProcessLog) -> dict[str, DataFrame]:
    """Cases, activities, transitions and the summary of variants."""
    return {"cases": log.overview(), "activities": by_frequency(log.activities(), "activity"), "transitions": by_frequency(log.transitions(), "source", "target"), "variants": variant_summary(log.variants)}


def deviation_report(log: ProcessLog, type: str | None = None) -> dict[str, DataFrame]:
    """``by_type`` (or one type), the deviation ``rate`` of all cases, and ``conformance``."""
    found = deviations.summary(log.deviations, log.cases)
    return {"by_type": (found if type is None else found.where(F.col("type") == type)).orderBy("ordinal"), "rate": deviations.deviation_rate(log.deviations, log.cases), "conformance": log.conformance()}


def resource_stats(log: ProcessLog, resource: str | None = None, limit: int = 10) -> DataFrame:
    """Resources by events, or the one of that name or the closest to it; none if the log has no resources."""
    rows = log.resources()
    if resource is not None and "resource" in log.frame.columns:
        rows = rows.where(F.col("resource") == F.lit(resolve_resource(log, resource)))
    return by_frequency(rows, "resource", count="events").limit(max(1, min(limit, 50)))


def data_quality(marked: DataFrame, file_facts: DataFrame | None = None) -> dict[str, DataFrame]:
    """``counts`` of rows by issue, ``columns`` of each file, ``warnings``, and ``merges`` of spellings of one activity."""
    counts = bounded(ingest.report(marked))  # one row, made once for itself and the warnings
    out = {"counts": counts, "warnings": ingest.warnings(file_facts, counts), "merges": normalize.merges(ingest.events(marked))}
    return out if file_facts is None else out | {"columns": file_facts}


def event_records(rows: DataFrame) -> DataFrame:
    """Event rows as text for people: the known fields that are there, times in ISO 8601 (UTC), figures to two decimals."""
    wanted = {
        "case_id": F.col("case_id"), "activity": F.col("activity"), "original_activity": F.col("original_activity") if "original_activity" in rows.columns else None, "timestamp": iso_time("ts_us"), "prev_activity": F.col("prev_activity"),
        "wait_h": F.round(hours("wait_us"), 2), "gap_h": F.round(hours("gap_us"), 2), **{c: F.col(c) for c in ("resource", "department")}, "amount": F.round("amount", 2) if "amount" in rows.columns else None,
        **{c: F.col(c) for c in ("priority", "location", "source_row")},
    }
    derived = {"timestamp", "wait_h", "gap_h"}
    return rows.select(*[c.alias(k) for k, c in wanted.items() if c is not None and (k in derived or k in rows.columns)])


def facts(log: ProcessLog) -> DataFrame:
    """``fact_id``, ``label``, ``value``, ``unit``: the bounded sheet of figures a report may quote; unknown ones are left out."""
    long = lambda df, ids, labels, units: df.select(F.explode(F.array(*[
        F.struct(F.concat(*i).alias("fact_id"), F.concat(*t).alias("label"), v.cast("double").alias("value"), F.lit(u).alias("unit")) for i, t, (v, u) in zip(ids, labels, units, strict=True)
    ])).alias("f")).select("f.*")
    lit, col = F.lit, F.col
    o = log.overview()
    totals = [("total_cases", "cases"), ("completed_cases", "cases"), ("mean_duration_h", "hours"), ("median_duration_h", "hours"), ("p95_duration_h", "hours"), ("unique_variants", ""), ("deviation_rate_pct", "%"), ("conformance_rate_pct", "%")]
    sheet = long(o, [[lit(f"overview.{k}")] for k, _ in totals], [[lit(k.replace("_", " "))] for k, _ in totals], [(col(k), u) for k, u in totals])
    parts = [
        (top_bottlenecks(log, 8), "activity", [col("activity")], [("score", ""), ("median_wait_h", "hours"), ("long_wait_cases", "cases")]),
        (log.slow_transitions(6), "transition", [col("source"), lit("→"), col("target")], [("median_h", "hours"), ("p90_h", "hours")]),
        (log.variants.where("rank <= 8"), "variant", [col("variant_id")], [("case_count", "cases"), ("pct", "%")]),
        (resource_stats(log, limit=10), "resource", [col("resource")], [("cases", "cases"), ("median_wait_h", "hours")]),
        (deviations.summary(log.deviations, log.cases), "deviation", [col("type")], [("cases", "cases"), ("case_pct", "%")]),
    ]
    for df, kind, name, figures in parts:
        if all(c in df.columns for c, _ in figures):
            sheet = sheet.unionByName(long(df, [[lit(f"{kind}."), *name, lit(f".{c}")] for c, _ in figures], [[*name, lit(f" — {c.replace('_', ' ')}")] for c, _ in figures], [(col(c), u) for c, u in figures]))
    return sheet.where("value IS NOT NULL")


def levels(log: ProcessLog) -> DataFrame:
    """``fact_id``, ``level``: whether a bottleneck score is HIGH, MEDIUM or LOW, which the exact score tells."""
    return log.bottlenecks.where("score IS NOT NULL").select(F.concat(F.lit("activity."), "activity", F.lit(".score")).alias("fact_id"), F.col("indicator").alias("level"))


def report_findings(log: ProcessLog) -> DataFrame:
    """Findings of a log whose evidence resolves to its facts, with what to look at."""
    sheet = facts(log)
    return findings.resolved(findings.findings(sheet, levels(log)), sheet)


def mentioned(log: ProcessLog, texts: DataFrame, ids: list[str], text_col: str = "text", limit: int = 3) -> DataFrame:
    """The activity of the log that each text mentions, else those that share a telling word with it."""
    return mentions.activities_mentioned(texts, ids, mentions.labels(log.events), log.bottlenecks, text_col, limit)
