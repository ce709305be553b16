"""The registered queries: operators over logs made from the driver's tables."""

from __future__ import annotations

import datetime as dt
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.config import AnalysisConfig, Weights
from tracelane.functions import text
from tracelane.functions.time import hours
from tracelane.operators import deviations as dv
from tracelane.operators import findings, graph, ingest, mentions, normalize, variants
from tracelane.operators.frame import event_frame
from tracelane.plans import tools
from tracelane.plans.log import ProcessLog
from tracelane.sources import adapters

DIGITS = 4
NOW = dt.datetime(2030, 1, 1, tzinfo=dt.timezone.utc)
REWEIGHTED = AnalysisConfig(weights=Weights(0.5, 0.1, 0.1, 0.2, 0.1), high=0.7, min_activity_support=500)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS decimals, so that summing in another order makes no difference."""
    return df.select(*[F.round(c, DIGITS).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def held(df: DataFrame, log: ProcessLog) -> DataFrame:
    """``df``, which keeps what the log has persisted until nobody holds ``df`` any more."""
    weakref.finalize(df, log.release).atexit = False
    return df


def daily(spark, d, start=False, keep=False) -> ProcessLog:
    """``keep``: frame, cases and variants are persisted, for plans that read them several times; see ``held``."""
    return ProcessLog(adapters.daily(spark, d, start), persist=keep)


def conv(spark, d, keep=False) -> ProcessLog:
    return ProcessLog(adapters.conv(spark, d), persist=keep)


def order(spark, d) -> ProcessLog:
    return ProcessLog(adapters.order(spark, d))


def _frame(log: ProcessLog) -> DataFrame:
    return log.frame.select("case_id", "source_row", "activity", "pos", "prev_activity", "gap_us", "wait_us", "proc_us", "occurrence")


def event_frame_order(spark, d):
    return event_frame(adapters.order(spark, d)).select("case_id", "source_row", "activity", "pos", "prev_activity", "gap_us", "wait_us", "occurrence")


def traces_daily(spark, d):
    return daily(spark, d).cases.select("case_id", text.trace_text("trace").alias("trace_text"), "n_events", "duration_us", "first_activity", "last_activity")


def variants_daily(spark, d):
    v = daily(spark, d).variants
    return rounded(v.select(text.trace_text("trace").alias("trace_text"), "variant_id", "case_count", "mean_duration_h", "median_duration_h", "pct", "cum_pct"))


def variant_coverage(spark, d):
    v = variants.variant_summary(daily(spark, d).variants)
    return rounded(v.select("unique_variants", text.trace_text("most_common").alias("most_common"), "most_common_pct", "top10_coverage_pct", "variants_for_80pct", "singletons"))


def completion_activities(spark, d):
    return rounded(variants.end_shares(daily(spark, d).cases).where("share >= 0.02"))


def dominant_path_conv(spark, d):
    log = conv(spark, d, keep=True)
    return held(log.dominant.select(text.trace_text("trace").alias("trace_text"), "variant_id", "case_count"), log)


def case_metrics(spark, d):
    log = daily(spark, d, keep=True)
    return held(rounded(log.case_metrics_alone()), log)


def dfg_edges(spark, d):
    return rounded(daily(spark, d).edges())


def dfg_nodes(spark, d):
    return rounded(daily(spark, d, True).nodes())


def dfg_start_end(spark, d):
    return rounded(graph.start_end(daily(spark, d).cases))


def dfg_filtered(spark, d):
    log = conv(spark, d)
    kept_nodes, kept_edges = graph.filtered_graph(log.frame, log.cases, 20.0)
    e = kept_edges.select(F.lit("edge").alias("kind"), "id", "frequency", "cases")
    return e.unionByName(kept_nodes.select(F.lit("node").alias("kind"), F.col("activity").alias("id"), "frequency", "cases"))


def activity_metrics(spark, d):
    log = ProcessLog(adapters.user(spark, d))
    return rounded(log.activities().drop("mean_proc_h", "median_proc_h"))


def transition_metrics(spark, d):
    return rounded(ProcessLog(adapters.user(spark, d)).transitions())


_SCORES = ["activity", "frequency", "affected_cases", "long_wait_cases", "mean_wait_h", "median_wait_h", "p90_wait_h", "p95_wait_h", "wait_share", "score", "indicator", "not_scored_reason"]


def bottlenecks(spark, d):
    return rounded(daily(spark, d).bottlenecks.select(*_SCORES))


def bottlenecks_start(spark, d):
    return rounded(daily(spark, d, True).bottlenecks.select(*_SCORES, "median_proc_h"))


def bottlenecks_reweighted(spark, d):
    return rounded(ProcessLog(adapters.daily(spark, d, True), REWEIGHTED).bottlenecks.select(*_SCORES))


def slow_transitions(spark, d):
    return rounded(daily(spark, d).slow_transitions())


def loops(spark, d):
    return dv.loops(daily(spark, d).frame).select("case_id", "activity", "pos")


def rework(spark, d):
    return dv.rework(daily(spark, d).frame).select("case_id", "activity", "pos", "prev_activity")


def alignment_deviations(spark, d):
    log = conv(spark, d, keep=True)
    return held(log.deviations.select("case_id", "type", "activity", "ts_us", "description", "hours"), log)


def alignment_daily(spark, d):
    log = daily(spark, d, keep=True)
    return held(log.aligned.select(text.trace_text("trace").alias("trace_text"), "type", "activity", "position", "description"), log)


def path_coverage(spark, d):
    log = conv(spark, d, keep=True)
    return held(rounded(log.aligned.select(text.trace_text("trace").alias("trace_text"), "coverage").distinct()), log)


def case_outcomes(spark, d):
    log = conv(spark, d, keep=True)
    return held(dv.outcomes(log.cases, log.dominant, log.completion).select("case_id", "type", "activity", "ts_us"), log)


def long_transitions(spark, d):
    log = ProcessLog(adapters.user(spark, d))
    return rounded(dv.long_transitions(log.frame, spread=log.spread("pair")).select("case_id", "activity", "ts_us", "hours"))


def deviation_summary(spark, d):
    log = conv(spark, d, keep=True)
    return held(rounded(dv.summary(log.deviations, log.cases).select("ordinal", "type", "occurrences", "cases", "case_pct", F.array_join(F.transform("top_activities", lambda t: F.concat(t.activity, F.lit(":"), t.occurrences)), ", ").alias("top"))), log)


def deviation_summary_sql(spark, d):
    log = conv(spark, d, keep=True)
    s = dv.summary(log.deviations.where(F.col("type").isin("loop", "rework", "long_transition", "alternative_outcome", "incomplete_case")), log.cases)
    return held(rounded(s.select("type", "occurrences", "cases", "case_pct")), log)


def conformance(spark, d):
    log = conv(spark, d, keep=True)
    return held(rounded(log.conformance()), log)


def conformance_rate(spark, d):
    log = conv(spark, d, keep=True)
    return held(rounded(log.conformance().select("conformance_rate_pct")), log)


def conformance_sql(spark, d):
    log = daily(spark, d, keep=True)
    return held(rounded(log.conformance().select("conformance_rate_pct", "cases_rework", "cases_loop")), log)


def resources(spark, d):
    r = daily(spark, d, True).resources()
    return rounded(r.select("resource", "events", "cases", "activities", "mean_wait_h", "median_wait_h", "mean_proc_h", "rework_rate_pct", "mean_case_duration_h"))


def resource_top_activities(spark, d):
    return daily(spark, d).resources().select("resource", F.array_join("top_activities", ", ").alias("top"), "department")


def _respelled(spark, d):
    e = adapters.daily(spark, d)
    k = F.col("source_row") % 7
    spelled = F.when(k == 0, F.upper("activity")).when(k == 1, F.concat(F.lit("  "), "activity", F.lit(" "))).when(k == 2, F.concat(F.initcap("activity"), F.lit("_"))).otherwise(F.col("activity"))
    return e.withColumn("original_activity", spelled)


def normalize_labels(spark, d):
    out = normalize.normalize(_respelled(spark, d))
    return out.groupBy("activity").agg(F.count("*").alias("n_events"), F.count_distinct("original_activity").alias("n_spellings"))


def label_merges(spark, d):
    return normalize.merges(_respelled(spark, d)).select("activity", F.array_join("spellings", "|").alias("spellings"))


def _marked(spark, d):
    """The lines as texts, with gaps and copies: every 13th row twice, some without case or activity, some with a bad time."""
    o = adapters.order(spark, d, by_case=False)
    k = F.col("case_id").cast("long") * 10 + F.col("source_row")
    raw = o.select(
        (k * 2).alias("source_row"), F.when(k % 17 == 0, F.lit("  ")).otherwise(F.col("case_id")).alias("case_id"), F.when(k % 19 == 0, F.lit("")).otherwise(F.col("activity")).alias("activity"),
        F.when(k % 23 == 0, F.lit("not a date")).otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), F.date_format("start_timestamp", "yyyy-MM-dd HH:mm:ss").alias("start_timestamp"),
        F.col("resource"), (k % 29 == 0).alias("malformed"), k.cast("string").alias("line"),
    )
    twice = F.when(F.col("source_row") % 26 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    raw = raw.withColumn("copy", F.explode(twice)).withColumn("source_row", F.col("source_row") + F.col("copy")).drop("copy")
    return ingest.mark(raw, ["case_id", "activity", "timestamp", "start_timestamp", "resource", "line"], now=NOW, rows=adapters.order_rows(spark, d))


def reject_cascade(spark, d):
    return _marked(spark, d).select("source_row", "issue").where("issue IS NOT NULL")


def validation_report(spark, d):
    return ingest.report(_marked(spark, d)).drop("unreadable_starts", "unreadable_amounts")


def data_quality(spark, d):
    """Counts, and with them the warnings and how many labels stand for several spellings."""
    o = _marked(spark, d).withColumn("amount", F.when(F.col("source_row") % 7 == 0, "n/a").otherwise(F.col("source_row").cast("string")))
    o = o.withColumn("activity", F.when(F.col("source_row") % 5 == 0, F.lower("activity")).otherwise(F.col("activity")))
    found = tools.data_quality(o)
    said = found["warnings"].agg(F.array_join(F.array_sort(F.collect_list("warning")), " ").alias("warnings"))
    merged = found["merges"].agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "activity", F.array_join("spellings", "/")))), ",").alias("merges"))
    return found["counts"].drop("unreadable_starts").crossJoin(said).crossJoin(merged)  # one row each


def rejected_export(spark, d):
    m = _marked(spark, d)
    raw = F.when(F.col("malformed"), F.create_map(F.lit("raw_fields"), F.concat_ws(" | ", "case_id", "line"))).otherwise(F.create_map(F.lit("case_id"), F.col("case_id"), F.lit("Line"), F.col("line")))
    return ingest.rejected_export(m.withColumn("raw", raw))


def event_records(spark, d):
    return tools.event_records(daily(spark, d, True).frame)


def variants_page(spark, d):
    found = tools.variants_page(daily(spark, d), 5, 20)
    return rounded(found["items"].select("variant_id", text.trace_text("trace").alias("trace_text"), "case_count", "pct"))


def tool_activity_stats(spark, d):
    log = daily(spark, d, keep=True)
    return held(rounded(tools.activity_stats(log, "Purchas_").select("activity", "frequency", "cases", "median_wait_h", "p90_wait_h", "score", "indicator", "long_wait_cases", "wait_share")), log)


def tool_transition_stats(spark, d):
    log = daily(spark, d, keep=True)
    return held(rounded(tools.transition_stats(log, "VIEW", "purchse")), log)


def tool_bottlenecks(spark, d):
    log = daily(spark, d, keep=True)
    found = tools.bottleneck_report(log, 3)
    own = found["activities"].select(F.lit("activity").alias("kind"), F.col("activity").alias("name"), F.col("median_wait_h").alias("median_h"), "score")
    return held(rounded(own.unionByName(found["slow_transitions"].select(F.lit("transition").alias("kind"), F.concat("source", F.lit("→"), "target").alias("name"), "median_h", F.lit(None).cast("double").alias("score")))), log)


def tool_resource_stats(spark, d):
    return rounded(tools.resource_stats(daily(spark, d), "r33").select("resource", "events", "cases", "activities", "median_wait_h", "rework_rate_pct"))


def count_cases_filters(spark, d):
    log = conv(spark, d, keep=True)
    return held(rounded(tools.count_cases(log, has_activity="assistant", deviation_type="rework", min_hours=2, max_hours=20)), log)


def variant_cases_page(spark, d):
    log = daily(spark, d, keep=True)
    return held(rounded(tools.page(tools.variant_cases(log, "V1"), [F.desc("duration_h"), F.col("case_id")], 5, 20)), log)


def events_drilldown(spark, d):
    rows = tools.events_at(daily(spark, d), source="view", target="purchase")
    return rounded(tools.page(rows, tools.by_wait(rows), 0, 50).select("case_id", "pos", hours("wait_us").alias("wait_h")))


def events_page_after(spark, d):
    """The third page of a drill-down, each page found from the last row of the one before."""
    rows, after = tools.events_at(daily(spark, d), activity="view").select("case_id", "pos", "wait_us"), None
    for _ in range(2):
        after = tools.key_of(tools.page_after(rows, tools.BY_WAIT, after, 40), tools.BY_WAIT)
    return tools.page_after(rows, tools.BY_WAIT, after, 40)


def case_detail(spark, d):
    log = conv(spark, d)
    return tools.case_detail(log, "7")["events"].select("case_id", "pos", "activity", "ts_us", "prev_activity", "wait_us")


def deviations_page(spark, d):
    log = conv(spark, d, keep=True)
    rows = tools.deviation_rows(log, type="rework")
    return held(tools.page(rows, [F.col("case_id"), F.col("ts_us").asc_nulls_last(), F.col("ordinal")], 10, 100).select("case_id", "type", "activity", "ts_us"), log)


def formula_escape(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet")
    sign = F.element_at(F.array(*map(F.lit, ("=", "+", "-", "@", "x", "\t"))), (F.col("turn") % 6 + 1).cast("int"))
    return t.select("conv_id", "turn", text.escape_formula(F.concat(sign, "text")).alias("safe"))


def numbers_in_text(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.array_join(text.numbers_in("text"), "|").alias("numbers"))


def causal_terms(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet")
    said = F.concat("text", F.when(F.col("turn") % 3 == 0, " Due to this, because of that.").otherwise(" It results from the LAZY way."))
    return t.select("conv_id", "turn", F.array_join(text.causal_terms(said), "|").alias("terms"))


def fact_sheet(spark, d):
    log = conv(spark, d, keep=True)
    return held(rounded(tools.facts(log)), log)


def fact_sheet_sql(spark, d):
    """The figures that need no alignment with the dominant path."""
    log = conv(spark, d, keep=True)
    sheet = tools.facts(log).where(~F.col("fact_id").startswith("deviation.") & (F.col("fact_id") != "overview.deviation_rate_pct"))
    return held(rounded(sheet.select("fact_id", "value", "unit")), log)


def facts_shown(spark, d):
    """The figures as people read them, and what to look at for each."""
    log = conv(spark, d, keep=True)
    sheet = tools.facts(log).where(~F.col("fact_id").startswith("deviation.") & (F.col("fact_id") != "overview.deviation_rate_pct"))
    return held(rounded(sheet).select("fact_id", text.fact_value("value", "unit").alias("shown"), findings.drilldown().alias("d")).select("fact_id", "shown", "d.*"), log)


def _named(column: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x.activity, x.cases.cast("string"))), ", ").alias(column)


def overview(spark, d):
    """What SQL can say too: totals, start and end activities, the dominant path and completion activities."""
    log = daily(spark, d, keep=True)
    rest = [c for c in log.totals().columns if c not in ("start_activities", "end_activities", "engine_version")]
    return held(rounded(log.totals().select(*rest, _named("start_activities"), _named("end_activities"))), log)


def overview_full(spark, d):
    log = daily(spark, d, keep=True)
    o = log.overview()
    rest = [c for c in o.columns if c not in ("start_activities", "end_activities", "completion_activities")]
    return held(rounded(o.select(*rest, _named("start_activities"), _named("end_activities"), F.array_join("completion_activities", ", ").alias("completion_activities"))), log)


def overview_conv(spark, d):
    log = conv(spark, d, keep=True)
    o = log.overview()
    return held(rounded(o.select("total_cases", "completed_cases", "total_events", "mean_duration_h", "median_duration_h", "unique_variants", "unique_activities", "top10_coverage_pct", "most_common", "singletons", "conformance_rate_pct")), log)


def _topics(spark, d) -> ProcessLog:
    """Each label is scored, however rare."""
    return ProcessLog(adapters.topics(spark, d), AnalysisConfig(min_activity_support=1), persist=True)


def _turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")


def activity_mentions(spark, d):
    """The one activity that each turn of a conversation mentions, word for word or nearly so."""
    known = mentions.labels(adapters.topics(spark, d))
    return rounded(mentions.mentioned(_turns(spark, d), ["conv_id", "turn"], known))


def activity_mentions_exact(spark, d):
    found = mentions.mentioned(_turns(spark, d), ["conv_id", "turn"], mentions.labels(adapters.topics(spark, d)), exact_only=True)
    return found.where("how = 'exact'").select("conv_id", "turn", "activity")


def activity_candidates(spark, d):
    """The activities that share a telling word with a turn, by bottleneck score."""
    log = _topics(spark, d)
    return held(mentions.candidates(_turns(spark, d), ["conv_id", "turn"], mentions.labels(log.events), log.bottlenecks), log)


def activities_mentioned(spark, d):
    log = _topics(spark, d)
    return held(tools.mentioned(log, _turns(spark, d), ["conv_id", "turn"]), log)


def report_findings(spark, d):
    log = daily(spark, d, keep=True)
    return held(tools.report_findings(log).select("finding", "severity", "title", F.array_join("evidence", " ").alias("evidence"), "drilldown.*"), log)


def report_findings_sql(spark, d):
    """Findings from the facts that need no alignment with the dominant path."""
    log = daily(spark, d, keep=True)
    sheet = tools.facts(log).where(~F.col("fact_id").startswith("deviation.") & (F.col("fact_id") != "overview.deviation_rate_pct"))
    found = findings.resolved(findings.findings(sheet, tools.levels(log)), sheet)
    return held(found.select("finding", "severity", F.array_join("evidence", " ").alias("evidence"), "drilldown.*"), log)


def evidence_resolution(spark, d):
    """The assistant's turns as written findings: what is left of their evidence, and what is flagged."""
    log = conv(spark, d, keep=True)
    sheet = tools.facts(log).where(~F.col("fact_id").startswith("deviation."))
    t = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'assistant'")
    ids = F.array(F.concat(F.lit("variant.V"), F.col("turn"), F.lit(".pct")), F.concat(F.lit("activity."), F.substring("text", 1, 2), F.lit(".score")), F.lit("activity.assistant.score"), F.lit("overview.total_cases"))
    said = t.select(
        F.concat_ws("-", "conv_id", "turn").alias("finding"), F.when(F.col("turn") % 4 == 1, F.slice(ids, 2, 1)).when(F.col("turn") % 4 == 3, F.reverse(ids)).otherwise(ids).alias("evidence"),
        F.concat("text", F.when(F.col("turn") % 3 == 0, " Caused by delay.").otherwise("")).alias("description"),
    )
    kept = findings.resolved(said, sheet).select("finding", F.lit("kept").alias("flag"), F.array_join("evidence", ", ").alias("detail"))
    return held(kept.unionByName(findings.flags(said, sheet)), log)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "event_frame_daily": lambda s, d: _frame(daily(s, d)),
    "event_frame_start": lambda s, d: _frame(daily(s, d, True)),
} | {
    f.__name__: f
    for f in (
        event_frame_order, traces_daily, variants_daily, variant_coverage, completion_activities, dominant_path_conv, case_metrics, dfg_edges, dfg_nodes, dfg_start_end, dfg_filtered, activity_metrics,
        transition_metrics, bottlenecks, bottlenecks_start, bottlenecks_reweighted, slow_transitions, loops, rework, alignment_deviations, alignment_daily, path_coverage, case_outcomes, long_transitions,
        deviation_summary, deviation_summary_sql, conformance, conformance_rate, resources, resource_top_activities, normalize_labels, label_merges, reject_cascade, validation_report, count_cases_filters,
        variant_cases_page, events_drilldown, case_detail, deviations_page, formula_escape, numbers_in_text, causal_terms, fact_sheet, fact_sheet_sql, overview, overview_full, overview_conv, conformance_sql,
        data_quality, rejected_export, event_records, variants_page, tool_activity_stats, tool_transition_stats, tool_bottlenecks, tool_resource_stats,
        activity_mentions, activity_mentions_exact, activity_candidates, activities_mentioned, report_findings, report_findings_sql, evidence_resolution, events_page_after, facts_shown,
    )
}
