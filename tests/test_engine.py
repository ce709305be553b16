"""Operators on small logs whose results are known."""

import datetime as dt
import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tracelane.config import AnalysisConfig, Weights
from tracelane.operators import bottlenecks, graph, normalize
from tracelane.operators import deviations as dv
from tracelane.operators.frame import cases, event_frame
from tracelane.operators.quantiles import SHARES, quantiles
from tracelane.plans import tools
from tracelane.plans.log import ProcessLog, run

SCHEMA = "case_id string, activity string, timestamp timestamp_ntz, source_row long"


def log_of(spark, traces):
    """traces: (case, activities, first time, hour offsets)."""
    rows = []
    for case, steps, base, offsets in traces:
        for step, h in zip(steps, offsets, strict=True):
            rows.append((case, step, dt.datetime.fromisoformat(base) + dt.timedelta(hours=h), len(rows) + 2))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def simple():
    out = [(f"C{i}", "ABCD", "2026-01-01T08:00", (0, 1, 3, 4)) for i in range(6)]
    out += [(f"R{i}", "ABCBCD", "2026-01-02T08:00", range(6)) for i in (1, 2)]
    return [*out, ("S1", "ACD", "2026-01-03T08:00", (0, 2, 3)), ("U1", "ABXCD", "2026-01-03T08:00", range(5))]


@pytest.fixture(scope="module")
def log(spark):
    return ProcessLog(log_of(spark, simple()), persist=True)


def test_case_metrics(log):
    m = log.case_metrics().first()
    assert (m.total_cases, m.completed_cases, m.total_events) == (10, 10, 44)
    assert (round(m.mean_duration_h, 6), m.median_duration_h, m.p90_duration_h, m.p95_duration_h) == (4.1, 4.0, 5.0, 5.0)


def test_activities_and_first_waits_are_unknown(log):
    by = {r.activity: r for r in graph.activity_metrics(log.frame, log.cases).collect()}
    assert (by["A"].frequency, by["B"].frequency, by["X"].frequency, by["B"].repeats) == (10, 11, 1, 2)
    assert by["C"].median_wait_h == 2.0 and by["A"].median_wait_h is None


def test_variants(log):
    rows = log.variants.orderBy("rank").collect()
    assert [("".join(r.trace), r.case_count, r.variant_id) for r in rows] == [("ABCD", 6, "V1"), ("ABCBCD", 2, "V2"), ("ACD", 1, "V3"), ("ABXCD", 1, "V4")]
    assert rows[0].pct == 60.0 and rows[-1].cum_pct == 100.0


def test_edges(log):
    by = {(r.source, r.target): r for r in log.edges().collect()}
    want = {("A", "B"): 9, ("B", "C"): 10, ("C", "B"): 2, ("A", "C"): 1, ("C", "D"): 10, ("B", "X"): 1, ("X", "C"): 1}
    assert {k: r.frequency for k, r in by.items()} == want and by["B", "C"].cases == 8


def test_bottlenecks(log):
    rows = bottlenecks.ranked(log.bottlenecks).collect()
    assert [(r.activity, r.score, r.indicator) for r in rows[:3]] == [("C", 1.0, "HIGH"), ("D", 0.222, "LOW"), ("B", 0.025, "LOW")]
    assert {r.activity: r.not_scored_reason for r in rows[3:]} == {"A": "No waiting time (only occurs as first event)", "X": "Fewer than 10 events"}
    assert all(r.long_wait_cases == 0 for r in rows)


def test_weights_change_the_score(spark, log):
    other = bottlenecks.score(bottlenecks.wait_stats(log.frame), AnalysisConfig(weights=Weights(0, 0, 0, 1, 0)))
    assert {r.activity: r.score for r in other.collect() if r.score is not None}["D"] == 1.0


def test_deviation_summary_and_conformance(log):
    by = {r.type: r for r in dv.summary(log.deviations, log.cases).collect()}
    assert {k: (r.occurrences, r.cases) for k, r in by.items()} == {"rework": (4, 2), "skipped_activity": (1, 1), "unexpected_activity": (1, 1)}
    rate = dv.deviation_rate(log.deviations, log.cases).first()
    assert (rate.total_deviations, rate.cases_with_deviations, rate.deviation_rate_pct) == (6, 4, 40.0)
    c = log.conformance().first()
    assert (c.conformance_rate_pct, round(c.mean_coverage_pct, 6), c.cases_rework, c.cases_missing, c.cases_unexpected, c.cases_extra_steps) == (60.0, 97.5, 2, 1, 1, 3)


@pytest.mark.parametrize(
    ("trace", "ends", "kinds", "coverage"),
    [
        ("ABCD", "D", [], 1.0), ("ACD", "D", [("skipped_activity", "B")], 0.75), ("AB", "D", [("missing_activity", "C"), ("missing_activity", "D")], 0.5),
        ("ABXCD", "D", [("unexpected_activity", "X")], 1.0), ("ABCBCD", "D", [("rework", "B"), ("rework", "C")], 1.0), ("ABCCD", "D", [("loop", "C")], 1.0),
        ("ACBD", "D", [("out_of_order", "C")], 0.75), ("ABR", "DR", [("unexpected_activity", "R")], 0.5),
    ],
)
def test_alignment(trace, ends, kinds, coverage):
    share, found = dv.alignment(list(trace), list("ABCD"), set(ends))
    assert [(k, a) for k, a, *_ in [*dv.repeats(list(trace)), *found]] == kinds and share == coverage


def test_matching_is_not_the_longest_common_subsequence():
    assert dv.alignment(list("BDA"), list("ABCD"), {"D"})[0] == 0.25


def test_alignment_records_follow_the_opcodes():
    for trace in itertools.product("ABCX", repeat=4):
        _, found = dv.alignment(list(trace), list("ABCD"), {"D"})
        ops = SequenceMatcher(None, list("ABCD"), list(trace), autojunk=False).get_opcodes()
        inserted = {j for tag, _, _, j1, j2 in ops if tag in ("insert", "replace") for j in range(j1, j2)}
        assert {p for k, _, p, _ in found if k in ("unexpected_activity", "out_of_order")} <= inserted


def test_rework_names_the_way_round():
    assert "rework around B/C" in [d for *_, d in dv.repeats(list("ABCBCD"))][0]


def test_long_transition(spark):
    rows = [(f"N{i}", "ABC", "2026-01-01T00:00", (0, 1, 2)) for i in range(30)] + [("SLOW", "ABC", "2026-01-01T00:00", (0, 60, 61))]
    found = dv.long_transitions(event_frame(log_of(spark, rows))).collect()
    assert [(r.case_id, r.activity, r.hours) for r in found] == [("SLOW", "B", 60.0)] and "60.0h" in found[0].description


def test_order_ties_and_start_times(spark):
    t = dt.datetime(2026, 1, 1, 10)
    rows = [("1", "B", t, 3, None), ("1", "A", t, 2, None), ("1", "C", t + dt.timedelta(hours=2), 4, t - dt.timedelta(hours=1))]
    frame = event_frame(spark.createDataFrame(rows, SCHEMA + ", start_timestamp timestamp_ntz"))
    got = {r.activity: r for r in frame.collect()}
    assert [got[a].pos for a in "ABC"] == [0, 1, 2]
    assert got["C"].wait_us == 0 and got["C"].proc_us == 3 * 3_600_000_000 and got["A"].wait_us is None
    assert cases(frame).first().trace == ["A", "B", "C"]


def test_permutation_and_partitions_do_not_matter(spark):
    events = log_of(spark, simple())
    one = sorted(map(str, ProcessLog(events.repartition(7)).edges().collect()))
    assert one == sorted(map(str, ProcessLog(events.coalesce(1).orderBy(F.desc("source_row"))).edges().collect()))


def test_sums_agree(log):
    total = log.frame.count()
    assert log.edges().agg(F.sum("frequency")).first()[0] == total - log.cases.count()
    assert log.variants.agg(F.sum(F.col("case_count") * F.size("trace"))).first()[0] == total


def test_normalize(spark):
    rows = [(123, "Order Approved", 2), (123, "order  approved ", 3), (124, "order_approved", 4), (124, "Order Approved", 5)]
    out = normalize.normalize(spark.createDataFrame(rows, "case_id long, original_activity string, source_row long")).collect()
    assert {r.activity for r in out} == {"Order Approved"} and {r.case_id for r in out} == {"123", "124"}


def test_resources(spark):
    base = log_of(spark, simple()).withColumns({"resource": F.when(F.col("activity") == "A", "ann").when(F.col("activity") == "B", "bob"), "department": F.lit("d")})
    rows = {r.resource: r for r in ProcessLog(base).resources().collect()}
    assert (rows["ann"].events, rows["ann"].cases, rows["bob"].rework_rate_pct, rows["bob"].top_activities, rows["bob"].department) == (10, 10, 100 * 2 / 11, ["B"], "d")
    assert ProcessLog(log_of(spark, simple())).resources().count() == 0


def test_tools(spark, log):
    assert tools.resolve_activity(log, " a") == "A" and tools.resolve_activity(log, "zzz") is None
    n = tools.count_cases(log, deviation_type="rework").first()
    assert (n["count"], n.pct) == (2, 20.0)
    assert tools.count_cases(log, has_activity="B", deviation_type="skipped_activity").first()["count"] == 0
    assert [r.case_id for r in tools.page(tools.variant_cases(log, "V1"), [F.desc("duration_h"), F.col("case_id")], 1, 2).collect()] == ["C1", "C2"]
    with pytest.raises(ValueError):
        tools.page(log.frame, [F.col("pos")], -1, 5)
    detail = tools.case_detail(log, "R1")
    assert detail["case"].first().variant_id == "V2" and detail["deviations"].count() == 2
    assert tools.facts(log).where("fact_id = 'overview.total_cases'").first().value == 10


def test_run_gives_all_results(spark):
    assert run(log_of(spark, simple()))["overview"].first().unique_variants == 4
    with pytest.raises(ValueError):
        run(spark.createDataFrame([], SCHEMA))


def test_config_key():
    assert AnalysisConfig().key() == AnalysisConfig().key() != AnalysisConfig(high=0.7).key()
    with pytest.raises(ValueError):
        Weights(-1)


def test_quantiles_of_both_plans(spark):
    """By ranks in cells and by one aggregate, against a plain sort."""
    rnd = random.Random(8)
    rows = [(rnd.choice("abc") if i % 5 else None, rnd.choice([0, 0, 5, rnd.randrange(10**9), rnd.randrange(10**12)])) for i in range(900)] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    want = {}
    for k in {k for k, v in rows if v is not None}:
        own = sorted(v for x, v in rows if x == k and v is not None)
        at = [s * (len(own) - 1) for s in SHARES]
        want[k] = [own[int(p)] + (own[min(int(p) + 1, len(own) - 1)] - own[int(p)]) * (p - int(p)) for p in at]
    for size in (None, 10):
        got = {r.k: r.q for r in quantiles(df, ["k"], "v", size=size).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert quantiles(df, [], "v", (0.5,)).first().q[0] == quantiles(df, [], "v", (0.5,), 10).first().q[0]


def test_tools_find_close_names(log):
    assert tools.activity_stats(log, " b").first().activity == "B" and tools.transition_stats(log, "b", "c").first().frequency == 10
    with pytest.raises(LookupError):
        tools.activity_stats(log, "nothing like it")
    found = tools.bottleneck_report(log, 2)
    assert found["activities"].count() == 2 and found["slow_transitions"].count() == 2
    report = tools.deviation_report(log, "rework")
    assert report["by_type"].count() == 1 and report["conformance"].first().conformance_rate_pct == 60.0 and report["rate"].first().deviation_rate_pct == 40.0
    page = tools.variants_page(log, 1, 2)
    assert [r.variant_id for r in page["items"].collect()] == ["V2", "V3"] and page["summary"].first().unique_variants == 4
    with pytest.raises(ValueError):
        tools.variants_page(log, 0, 201)
    top = tools.metrics(log)["activities"].first()
    assert (top.activity, top.frequency) == ("C", 12)
    assert tools.event_records(log.frame.where("case_id = 'S1'")).orderBy("timestamp").first().timestamp == "2026-01-03T08:00:00+00:00"


def test_overview_names_starts_and_ends(log):
    o = log.overview().first()
    assert [(r.activity, r.cases) for r in o.start_activities] == [("A", 10)] and o.completion_activities == ["D"] and o.dominant_path == "A → B → C → D"


def plain_alignment(trace, dominant):
    """Matching blocks by the textbook recursion: the longest common run, leftmost first, then both sides."""

    def blocks(a1, a2, b1, b2):
        best = (0, 0, 0)
        for i in range(a1, a2):
            for j in range(b1, b2):
                n = 0
                while i + n < a2 and j + n < b2 and dominant[i + n] == trace[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        return [] if not n else blocks(a1, i, b1, j) + [(i, j, n)] + blocks(i + n, a2, j + n, b2)

    return sum(n for *_, n in blocks(0, len(dominant), 0, len(trace))) / len(dominant)


def test_alignment_against_a_plain_matcher():
    for trace in itertools.product("ABCX", repeat=5):
        assert dv.alignment(list(trace), list("ABCAD"), {"D"})[0] == plain_alignment(list(trace), list("ABCAD"))
