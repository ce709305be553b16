"""Findings of a report: rules over the fact sheet, and evidence that must resolve to facts."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.functions.text import causal_terms, fact_value


@dataclass(frozen=True)
class Rule:
    """A fact of ``kind`` and ``metric`` with ``low`` <= value < ``high``, among the ``most`` largest of its metric, is a finding.

    If the rule has a ``level``, the fact must have it too: it was found from the exact figure, the fact has a rounded one. In ``title`` and ``evidence`` (identifiers of facts, divided by blanks) ``{}`` is the fact's subject.
    """

    rule: str
    kind: str
    metric: str
    low: float
    high: float
    level: str | None
    most: int
    severity: str
    title: str
    evidence: str


_ANY = float("inf")
_WAITS = "activity.{}.score activity.{}.median_wait_h activity.{}.long_wait_cases"
_DEVIATES = "deviation.{}.cases deviation.{}.case_pct"


def rules() -> list[Rule]:
    """The first three activities by score unless their score is low, deviation types of 5 % of the cases and more, variants."""
    return [
        Rule("bottleneck", "activity", "score", -_ANY, _ANY, "HIGH", 3, "high", "Cases wait longest before {}", _WAITS),
        Rule("bottleneck", "activity", "score", -_ANY, _ANY, "MEDIUM", 3, "medium", "Cases wait long before {}", _WAITS),
        Rule("deviation", "deviation", "case_pct", 20.0, _ANY, None, 1 << 30, "high", "Many cases deviate: {}", _DEVIATES),
        Rule("deviation", "deviation", "case_pct", 10.0, 20.0, None, 1 << 30, "medium", "Some cases deviate: {}", _DEVIATES),
        Rule("deviation", "deviation", "case_pct", 5.0, 10.0, None, 1 << 30, "low", "A few cases deviate: {}", _DEVIATES),
        Rule("variants", "overview", "conformance_rate_pct", -_ANY, _ANY, None, 1, "low", "How far the dominant path covers the log", "overview.conformance_rate_pct overview.unique_variants variant.V1.pct"),
    ]


def parted(fact_id: Column | str = "fact_id") -> tuple[Column, Column, Column]:
    """Kind, subject (empty if there is none) and metric of an identifier ``kind.subject.metric``; subjects may have dots."""
    whole = F.col(fact_id) if isinstance(fact_id, str) else fact_id
    return F.regexp_extract(whole, r"^([^.]+)\.", 1), F.regexp_extract(whole, r"^[^.]+\.(.*)\.[^.]+$", 1), F.regexp_extract(whole, r"\.([^.]+)$", 1)


def drilldown(fact_id: Column | str = "fact_id") -> Column:
    """``kind``, ``first``, ``second``: what to look at for a fact. A transition has its source and target, null where there is none."""
    kind, subject, _ = parted(fact_id)
    ends = F.split(subject, "→", 2)
    transition = kind == "transition"
    known = kind.isin("activity", "transition", "deviation", "variant", "resource") & (subject != "") | (kind == "overview")
    own = F.struct(kind.alias("kind"), F.nullif(F.when(transition, ends[0]).otherwise(subject), F.lit("")).alias("first"), F.when(transition, F.get(ends, 1)).alias("second"))
    return F.when(known, own)


def findings(facts: DataFrame, levels: DataFrame) -> DataFrame:
    """``finding``, ``severity``, ``title``, ``evidence`` (identifiers): facts (fact_id, value) that meet a rule.

    ``levels`` (fact_id, level): of the facts that have one.

    The rules are a table of a few rows that is joined to the facts by kind, metric and range, so a sheet of any size takes
    one broadcast join. Places among the largest are by value, then by identifier.
    """
    kind, subject, metric = parted()
    place = F.row_number().over(W.partitionBy("kind", "metric").orderBy(F.desc("value"), "fact_id"))
    placed = facts.join(levels, "fact_id", "left").select("fact_id", "value", F.col("level").alias("own_level"), kind.alias("kind"), subject.alias("subject"), metric.alias("metric"))
    table = facts.sparkSession.createDataFrame([astuple(r) for r in rules()], "rule string, kind string, metric string, low double, high double, level string, most int, severity string, title string, evidence string")
    wanted = placed.join(table.select("kind", "metric").distinct(), ["kind", "metric"], "left_semi").withColumn("place", place)
    of_level = F.col("level").isNull() | (F.col("level") == F.col("own_level"))
    met = wanted.join(F.broadcast(table), ["kind", "metric"]).where(of_level & (F.col("value") >= F.col("low")) & (F.col("value") < F.col("high")) & (F.col("place") <= F.col("most")))
    named = lambda c: F.replace(F.col(c), F.lit("{}"), F.col("subject"))
    ids = F.transform(F.split("evidence", " "), lambda e: F.replace(e, F.lit("{}"), F.col("subject")))
    return met.select(F.concat_ws(".", "rule", F.nullif("subject", F.lit(""))).alias("finding"), "severity", named("title").alias("title"), ids.alias("evidence"))


def cited(found: DataFrame, facts: DataFrame, finding_col: str = "finding") -> DataFrame:
    """``finding``, ``place``, ``fact_id``, ``label``, ``shown``, ``drilldown``: each identifier that a finding cites; unknown ones have no label.

    ``found``: the finding and ``evidence``, a list. Identifiers that are cited twice count once, at their first place.
    """
    ids = found.select(finding_col, F.posexplode(F.array_distinct("evidence")).alias("place", "fact_id"))
    known = facts.select("fact_id", "label", fact_value("value", "unit").alias("shown"))
    return ids.join(known, "fact_id", "left").select(finding_col, "place", "fact_id", "label", "shown", F.when(F.col("label").isNotNull(), drilldown()).alias("drilldown"))


def resolved(found: DataFrame, facts: DataFrame, finding_col: str = "finding") -> DataFrame:
    """``found`` without the findings of which no evidence is a fact, with ``evidence`` cut to facts and ``drilldown``.

    A finding leads to the first fact that is about more than the whole log, else to its first fact. A finding whose
    evidence is null or empty goes.
    """
    facts_of = cited(found, facts, finding_col).where("label IS NOT NULL")
    whole = F.struct((F.col("drilldown.kind") == "overview").alias("whole"), "place")
    own = facts_of.groupBy(finding_col).agg(F.array_sort(F.collect_list(F.struct("place", "fact_id"))).alias("__ids"), F.min_by("drilldown", whole).alias("drilldown"))
    kept = found.drop("drilldown").join(own, finding_col)
    return kept.withColumn("evidence", F.transform("__ids", lambda x: x.fact_id)).drop("__ids")


def flags(found: DataFrame, facts: DataFrame, finding_col: str = "finding", text_col: str = "description") -> DataFrame:
    """``finding``, ``flag``, ``detail``: ``unknown_evidence`` (identifiers that are no facts), ``dropped`` (no evidence is left),
    ``causal_wording`` (of findings that stay: words that claim a cause)."""
    ids = cited(found, facts, finding_col)
    unknown = ids.where("label IS NULL").groupBy(finding_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "fact_id"))), lambda x: x.fact_id), ", ").alias("detail"))
    backed = ids.where("label IS NOT NULL").select(finding_col).distinct()
    gone = found.join(backed, finding_col, "left_anti").select(finding_col, F.lit("dropped").alias("flag"), F.lit("").alias("detail"))
    out = unknown.select(finding_col, F.lit("unknown_evidence").alias("flag"), "detail").unionByName(gone)
    if text_col not in found.columns:
        return out
    said = found.join(backed, finding_col, "left_semi").select(finding_col, F.lit("causal_wording").alias("flag"), F.array_join(causal_terms(text_col), ", ").alias("detail"))
    return out.unionByName(said.where("detail <> ''"))
