"""Plans for logs that do not look like the usual one: very long cases, variants that all agree, traces of hundreds of steps."""

import datetime as dt
import random
import re
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tracelane.functions.matching import matching_blocks
from tracelane.operators import deviations as dv
from tracelane.operators import variants as vs
from tracelane.operators.frame import cases, event_frame, segmented_frame
from tracelane.operators.quantiles import quantiles
from tracelane.plans import tools
from tracelane.plans.log import ProcessLog
from tracelane.sources import adapters
from tracelane.sources import sinks

SCHEMA = "case_id string, activity string, timestamp timestamp_ntz, start_timestamp timestamp_ntz, source_row long"


def made_log(spark, sizes, seed=1, seconds=500):
    draw, rows = random.Random(seed), []
    for case, n in enumerate(sizes):
        for _ in range(n):
            at = dt.datetime(2026, 1, 1) + dt.timedelta(seconds=draw.randrange(seconds))  # many events at one time
            rows.append((f"c{case}", draw.choice("ABCDE"), at, at - dt.timedelta(seconds=draw.randrange(60)) if draw.random() < 0.7 else None, len(rows)))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def same_rows(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("segment", [0, 40, 10_000])
def test_cut_cases_have_the_same_frame(spark, segment):
    """All cases cut, some, and none."""
    events = made_log(spark, [1, 2, 39, 40, 41, 900, 0, 3000])
    same_rows(segmented_frame(events, segment), event_frame(events))


def test_cut_cases_of_an_empty_log_and_of_one_moment(spark):
    same_rows(segmented_frame(made_log(spark, []), 5), event_frame(made_log(spark, [])))
    events = made_log(spark, [200], seconds=1)
    same_rows(segmented_frame(events, 5), event_frame(events))


def test_a_long_case_is_dealt_to_many_tasks(spark):
    """The window's exchange has the cut in its key, and cuts are of about equal size."""
    events = spark.range(200_000).select(
        F.concat(F.lit("one"), F.lit("").substr(F.lit(1), F.col("id").cast("int"))).alias("case_id"), F.concat(F.lit("A"), F.col("id") % 7).alias("activity"), (F.timestamp_micros(F.col("id") * 1_000_003)).alias("timestamp"), F.col("id").alias("source_row"),
    )
    out = segmented_frame(events, 1000)
    assert re.search(r"hashpartitioning\(case_id#\d+, __cut#\d+", out._jdf.queryExecution().executedPlan().toString())
    total = out.agg(F.count("*").alias("n"), F.sum("pos").alias("p"), F.max("occurrence").alias("o"), F.count_if(F.col("gap_us") == 1_000_003).alias("g"), F.count("prev_activity").alias("q")).first()
    assert tuple(total) == (200_000, 200_000 * 199_999 // 2, 28_571, 199_999, 199_999)
    log = ProcessLog(events, persist=True, long_cases=True)
    assert log.edges().agg(F.sum("frequency")).scalar() is not None and log.frame.count() == 200_000
    log.release()


def found_variants(spark, rows):
    """Variants as ``variants`` finds them before it ranks: (count, mean, least case)."""
    return spark.createDataFrame([(c, float(m), k, int(m // vs.CELL_US)) for c, m, k in rows], "case_count long, mean_us double, least_case string, cell long")


def plain_ranks(rows):
    out, upto = [], 0
    for rank, (c, m, k) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1], r[2])), 1):
        upto += c
        out.append((k, rank, upto, sum(r[0] for r in rows)))
    return sorted(out)


@pytest.mark.parametrize("kind", ["mixed", "same"])
def test_ranks_by_ranges_equal_plain_ranks(spark, kind):
    draw = random.Random(3)
    rows = [(1, 5e6, f"k{i:05d}") if kind == "same" else (draw.randint(1, 4), draw.choice([1e6, 2e6, 9e7, 9.1e7]), f"k{i:05d}") for i in range(3000)]
    draw.shuffle(rows)
    kept = []

    def keep(df):
        kept.append(df.persist())
        return kept[-1]

    df = found_variants(spark, rows).repartition(6)
    for ranked in (vs.ranges(df, keep), vs.two_level(df)):
        assert sorted((r.least_case, r.rank, r.cases_upto, r.total_cases) for r in ranked.collect()) == plain_ranks(rows)
    sizes = [r.n for r in kept[0].groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert vs.ranges(df.limit(0), keep).collect() == []
    for k in kept:
        k.unpersist()


def test_variants_are_the_same_either_way(spark):
    events = made_log(spark, [3] * 60 + [2] * 40 + [1] * 20).drop("start_timestamp")
    of = cases(event_frame(events))
    kept = []
    small = vs.variants(of, 5)
    large = vs.variants(of, None, lambda df: kept.append(df.persist()) or kept[-1])
    assert len(kept) == 1
    same_rows(small.orderBy("rank"), large.orderBy("rank"))
    for k in kept:
        k.unpersist()


def test_no_plan_shuffles_traces(spark, monkeypatch):
    """Cases and variants meet by the trace's identifier, also where deviations are too many to be constants."""
    events = made_log(spark, [4] * 30 + [3] * 30).drop("start_timestamp")
    log = ProcessLog(events)
    monkeypatch.setattr(dv, "bounded", lambda df: df)
    plans = [dv.structural(log.cases, log.aligned), dv.conformance(log.aligned, log.dominant), tools.variant_cases(log, "V1"), tools.count_cases(log, variant_id="V1"), tools.case_detail(log, "c1")["case"]]
    for df in plans:
        keys = re.findall(r"hashpartitioning\(([^()]*)", df._jdf.queryExecution().executedPlan().toString())
        assert any("trace_id#" in k for k in keys) and not any(re.search(r"\btrace#", k) for k in keys)
    assert log.cases.select("trace").distinct().count() == log.cases.select("trace_id").distinct().count() == log.variants.count()


def test_blocks_equal_a_plain_matcher():
    draw = random.Random(2)
    for _ in range(1500):
        k = draw.choice([2, 3, 5, 9])
        a, b = ([draw.choice("abcdefghi"[:k]) for _ in range(draw.randint(0, 24))] for _ in range(2))
        want = [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]
        for cells in (0, 40, 1 << 22):  # row by row, tables for parts, one table
            assert matching_blocks(a, b, cells) == want


def test_blocks_of_long_traces():
    draw = random.Random(4)
    ours = plain = 0.0
    for n, kinds in ((500, 4), (500, 12), (3000, 6)):
        a, b = ([f"step {draw.randrange(kinds)}" for _ in range(n)] for _ in range(2))
        began = time.perf_counter()
        want = [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]
        plain += time.perf_counter() - began
        began = time.perf_counter()
        assert matching_blocks(a, b) == want
        ours += time.perf_counter() - began
    assert ours < plain
    assert matching_blocks(a, a) == [(0, 0, 3000)] and matching_blocks(a, []) == [] == matching_blocks([], a)


def test_pages_by_key_join_to_the_whole(spark):
    """Ties, unknown values and both directions; a page far behind sorts no more than a page."""
    draw = random.Random(8)
    rows = [(draw.choice([None, 1, 2, 3]), draw.choice("ab"), i) for i in range(57)]
    df = spark.createDataFrame(rows, "wait_us long, case_id string, pos long").repartition(4)
    keys = [tools.Key("wait_us", True), tools.Key("case_id"), tools.Key("pos", True)]
    after, got = None, []
    while True:
        page = tools.page_after(df, keys, after, 10)
        if after is not None:
            assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()
        own = [tuple(r) for r in page.collect()]
        if not own:
            break
        got += own
        after = tools.key_of(page, keys)
    assert got == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], -r[2])) and after == got[-1]
    assert tools.key_of(df.limit(0), keys) is None
    for bad in ({"limit": 0}, {"limit": 1001}, {"after": (1,)}):
        with pytest.raises(ValueError, match="limit"):
            tools.page_after(df, keys, **bad)


def test_stored_events_are_framed_without_an_exchange(spark):
    """A bucketed table: equal frames and cases, no shuffle, and a data set is replaced alone."""
    logs = {name: made_log(spark, sizes, seed).persist() for name, sizes, seed in (("x", [5, 40, 1], 1), ("y", [30, 2], 2), ("x2", [7] * 9, 3))}
    spark.sql("DROP TABLE IF EXISTS test_events")
    for name, own in (("x", "x"), ("y", "y"), ("x", "x2")):  # the second x takes the place of the first
        sinks.write_event_table(logs[own], "test_events", name, buckets=4)
    for name, own in (("x", "x2"), ("y", "y")):
        stored = sinks.read_event_table(spark, "test_events", name)
        assert sorted(stored.columns) == sorted(logs[own].columns)
        stored = stored.select(*logs[own].columns)
        frame = event_frame(stored)
        for df in (frame, cases(frame)):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        same_rows(frame, event_frame(logs[own]))
        same_rows(cases(frame), cases(event_frame(logs[own])))
    assert spark.table("test_events").count() == 63 + 32
    spark.sql("DROP TABLE test_events")
    for df in logs.values():
        df.unpersist()


def test_a_large_order_log_is_dealt_by_its_rows(spark, sf, monkeypatch):
    """Tasks grow in number with the log, not in size; the frame is the same."""
    from tracelane.functions import size
    from tracelane.plans.queries import QUERIES

    key = lambda r: (r.case_id, r.source_row)
    want = sorted(QUERIES["event_frame_order"](spark, sf).collect(), key=key)
    for rows in (500, 1000):
        monkeypatch.setattr(size, "TASK_ROWS", rows)
        frame = QUERIES["event_frame_order"](spark, sf)
        assert frame.rdd.getNumPartitions() == -(-len(want) // rows)
        assert sorted(frame.collect(), key=key) == want


def test_copies_in_a_large_log_are_searched_for_in_more_tasks(spark, sf, monkeypatch):
    from tracelane.functions import size
    from tracelane.plans.queries import QUERIES

    want = sorted(map(tuple, QUERIES["reject_cascade"](spark, sf).collect()))
    monkeypatch.setattr(size, "TASK_ROWS", 800)
    marked = QUERIES["reject_cascade"](spark, sf)
    assert marked.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, marked.collect())) == want


def test_quantiles_of_kept_rows_count_cells_first(spark):
    rows = [(f"k{i % 3}" if i % 7 else None, (i * i * 7919) % (1 << 34) if i % 5 else 12345) for i in range(3000)]
    kept = spark.createDataFrame(rows, "k string, v long").persist()
    plain, cells = ({r.k: r.q for r in quantiles(kept, ["k"], "v", kept=k).collect()} for k in (False, True))
    assert cells == plain and len(plain) == 4
    kept.unpersist()


def test_case_metrics_alone_keep_no_frame(spark, sf):
    log = ProcessLog(adapters.daily(spark, sf), persist=True)
    alone = log.case_metrics_alone().first()
    assert "frame" not in log.__dict__ and "variants" not in log.__dict__
    assert alone.asDict() == pytest.approx(log.case_metrics().first().asDict())
    log.release()
