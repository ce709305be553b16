"""A log and everything that is computed from it, each as a lazy DataFrame."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.config import DEFAULT, ENGINE_VERSION, AnalysisConfig
from tracelane.functions.size import bounded
from tracelane.operators import bottlenecks, deviations, graph, ingest, normalize, resources, variants
from tracelane.operators.frame import cases, event_frame, segmented_frame, steps
from tracelane.operators.quantiles import EVENT_KINDS, event_spread
from tracelane.sources.event_csv import LogFileError


class ProcessLog:
    """``events``: case_id, activity, timestamp, source_row, and if there start_timestamp, resource, department.

    With ``persist`` the event frame and the cases are kept for several results, and small tables that several of them
    need (quantiles, dominant path, completion) are computed once, by jobs of their own; ``release`` gives all back.
    ``long_cases``: cases with very many events are cut over tasks while the frame is made (``frame.segmented_frame``).
    """

    def __init__(self, events: DataFrame, config: AnalysisConfig = DEFAULT, persist: bool = False, long_cases: bool = False):
        self.events, self.config, self._persist, self._long_cases, self._more = events, config, persist, long_cases, []
        self._spreads: dict[str, DataFrame] = {}

    def _kept(self, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK) if self._persist else df

    def _held(self, df: DataFrame) -> DataFrame:
        """A table within a plan that is kept until ``release``."""
        self._more.append(self._kept(df))
        return self._more[-1]

    @cached_property
    def size(self) -> int:
        """Number of events, by a job that reads no column of a table; it tells which plan for quantiles is the better one."""
        return self.events.count()

    @cached_property
    def frame(self) -> DataFrame:
        return self._kept(segmented_frame(self.events) if self._long_cases else event_frame(self.events))

    @cached_property
    def cases(self) -> DataFrame:
        return self._kept(cases(self.frame))

    @cached_property
    def variants(self) -> DataFrame:
        return self._kept(variants.variants(self.cases, self.size, self._held if self._persist else None))

    def _literal(self, df: DataFrame) -> DataFrame:
        """With ``persist`` a small table is read once and stands in later plans as constants."""
        return bounded(df) if self._persist else df

    def spread(self, *kinds: str) -> DataFrame:
        """Quantiles of waits, gaps and processing by activity, transition and resource, at least the asked kinds; with ``persist``
        each kind is computed once."""
        if not self._persist:
            return event_spread(self.frame, kinds, self.size)
        lacking = [k for k in kinds if k not in self._spreads]
        if lacking:
            self._spreads |= dict.fromkeys(lacking, bounded(event_spread(self.frame, lacking, self.size, kept=True)))
        first, *others = {id(self._spreads[k]): self._spreads[k] for k in kinds}.values()
        for other in others:
            first = first.unionByName(other)
        return first

    @cached_property
    def _ends(self) -> DataFrame:
        """The configured completion activities, or those at which many cases end."""
        return self._literal(variants.completion(self.cases, None, self.config))

    @cached_property
    def dominant(self) -> DataFrame:
        """At most one row."""
        return self._literal(variants.first_completed(self.variants, self._ends))

    @cached_property
    def completion(self) -> DataFrame:
        """At most 1 / completion_share rows and one."""
        return self._ends if self.config.completion else self._literal(variants.with_dominant(self._ends, self.dominant))

    @cached_property
    def deviations(self) -> DataFrame:
        return self._kept(deviations.deviations(self.frame, self.cases, self.aligned, self.dominant, self.completion, self.config, self.spread("pair")))

    @cached_property
    def bottlenecks(self) -> DataFrame:
        return self._literal(bottlenecks.score(bottlenecks.wait_stats(self.frame, self.spread("wait", "proc", "log")), self.config))

    @cached_property
    def aligned(self) -> DataFrame:
        return self._kept(deviations.aligned_variants(self.variants, self.dominant, self.completion))

    def prepare(self) -> None:
        """With ``persist``: makes the small tables that most results need, those of events beside those of cases."""
        _ = self.size, self.cases  # both sides stand on the frame
        with ThreadPoolExecutor(2) as both:
            for side in [both.submit(lambda: (self.spread(*EVENT_KINDS), self.bottlenecks)), both.submit(getattr, self, "completion")]:
                side.result()

    def conformance(self) -> DataFrame:
        return deviations.conformance(self.aligned, self.dominant)

    def edges(self) -> DataFrame:
        return graph.edges(self.frame, self.cases, self.spread("pair"))

    def nodes(self) -> DataFrame:
        return graph.nodes(self.frame, self.cases, self.spread("wait", "proc"))

    def resources(self) -> DataFrame:
        return resources.resources(self.frame, self.cases, self.spread("resource") if "resource" in self.frame.columns else None)

    def case_metrics(self) -> DataFrame:
        return graph.case_metrics(self.cases, self.completion, self.size, self._persist)

    def case_metrics_alone(self) -> DataFrame:
        """``case_metrics`` of a log of which nothing else is asked: no frame is kept, and no variant is ranked."""
        own = self._held(cases(steps(self.events)))
        ends = self._literal(variants.completion(own, None, self.config))
        if not self.config.completion:
            ends = self._literal(variants.with_dominant(ends, variants.first_of_cases(own, ends)))
        return graph.case_metrics(own, ends, self.size, self._persist)

    def activities(self) -> DataFrame:
        return graph.activity_metrics(self.frame, self.cases, self.spread("wait", "proc"))

    def transitions(self) -> DataFrame:
        return graph.transition_metrics(self.frame, self.spread("pair"))

    def slow_transitions(self, limit: int = 10) -> DataFrame:
        return bottlenecks.slow_transitions(self.frame, self.config, limit, self.spread("pair"))

    def totals(self) -> DataFrame:
        """One row: case metrics and what the log and its variants come to, without deviations.

        ``start_activities`` and ``end_activities``: the five at which most cases start and end.
        """
        found = variants.variant_summary(self.variants).select("unique_variants", "top10_coverage_pct", F.array_join("most_common", " → ").alias("most_common"), "singletons")
        has = lambda c: F.max(F.col(c).isNotNull()) if c in self.frame.columns else F.lit(False)
        steps = self.frame.agg(F.count_distinct("activity").alias("unique_activities"), F.coalesce(has("resource"), F.lit(False)).alias("resources_available"), F.coalesce(has("proc_us"), F.lit(False)).alias("processing_time_available"))
        return side_by_side(self.case_metrics(), found, steps, graph.top_start_end(self.cases)).withColumn("engine_version", F.lit(ENGINE_VERSION))

    def overview(self) -> DataFrame:
        """One row: ``totals``, the dominant path and completion activities, deviations and conformance."""
        path = self.dominant.agg(F.array_join(F.first("trace"), " → ").alias("dominant_path"))
        ends = self.completion.agg(F.array_sort(F.collect_set("activity")).alias("completion_activities"))
        rate = deviations.deviation_rate(self.deviations, self.cases)
        fit = self.conformance().select("conformance_rate_pct", "mean_coverage_pct")
        return side_by_side(self.totals(), path, ends, rate, fit)

    def release(self) -> None:
        for name in ("frame", "cases", "variants", "aligned", "deviations"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()
        for df in self._more:
            df.unpersist()


def side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Tables of one row side by side."""
    beside = [other.select(F.struct("*")).scalar().alias(f"__{i}") for i, other in enumerate(others)]
    return first.select("*", *beside).select(*first.columns, *[f"__{i}.*" for i in range(len(beside))])


def by_frequency(rows: DataFrame, *names: str, count: str = "frequency") -> DataFrame:
    """Most frequent first, ties by name: the order of every list of activities, transitions and resources."""
    return rows.orderBy(F.desc(count), *names)


def run(events: DataFrame, config: AnalysisConfig = DEFAULT) -> dict[str, DataFrame]:
    """All results by name, over persisted intermediate tables."""
    log = ProcessLog(events, config, persist=True)
    if not log.size:
        raise LogFileError("There are no valid events.")
    log.prepare()
    return {
        "overview": log.overview(), "nodes": by_frequency(log.nodes(), "activity"), "edges": by_frequency(log.edges(), "source", "target"), "activities": by_frequency(log.activities(), "activity"),
        "transitions": by_frequency(log.transitions(), "source", "target"), "variants": log.variants.orderBy("rank"), "bottlenecks": bottlenecks.ranked(log.bottlenecks), "slow_transitions": log.slow_transitions(),
        "deviations": log.deviations, "deviation_summary": deviations.summary(log.deviations, log.cases).orderBy("ordinal"), "conformance": log.conformance(),
        "resources": by_frequency(log.resources(), "resource", count="events"),
    }


def analyse(marked: DataFrame, config: AnalysisConfig = DEFAULT) -> dict[str, DataFrame]:
    """``run`` over the events of a marked log. A log without a valid event is refused with its report.

    The file is parsed once: its events are kept, like the tables of ``run``, until the session's cache is cleared.
    """
    events = ingest.events(marked).persist(StorageLevel.MEMORY_AND_DISK)
    if events.isEmpty():
        raise LogFileError("There are no valid events.", ingest.report(marked).first().asDict())
    return run(normalize.normalize(events), config)
