"""CSV logs, the cascade of issues, sinks and text functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracelane.functions import text, timestamps
from tracelane.operators import ingest, normalize
from tracelane.plans import tools
from tracelane.plans.log import analyse
from tracelane.sources import event_csv, sinks

NOW = dt.datetime(2026, 12, 1, tzinfo=dt.timezone.utc)
VALID = "case_id,activity,timestamp,resource,amount\n1,A,2026-09-01 10:00,ann,\"1,200.5\"\n1,B,2026-09-01T13:00:00+02:00,bob,x\n2,A,2026-09-01T10:00:00Z,,\n2,B,2026-09-02 08:30:15,ann,3\n"


def read(spark, path, body, **settings):
    path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return ingest.mark(event_csv.read_event_csv(spark, str(path)), ["row_key"], now=NOW, **settings)


def test_valid_file(spark, tmp_path):
    marked = read(spark, tmp_path / "a.csv", VALID)
    rows = ingest.events(marked).orderBy("source_row").withColumn("us", F.unix_micros("timestamp")).collect()
    assert [r.source_row for r in rows] == [2, 3, 4, 5] and [r.amount for r in rows] == [1200.5, None, None, 3.0]
    assert rows[1].us == int(dt.datetime(2026, 9, 1, 11, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert rows[2].resource is None


def test_issues_and_line_numbers(spark, tmp_path):
    body = VALID + '\n1,C,not a date,,\n1,C,2099-01-01 00:00,,\n1,A,2026-09-01 10:00,ann,"1,200.5"\n,A,2026-09-01 10:00,,\n3,,2026-09-01 10:00,,\n3,A,2026-09-01\n4,"two\nlines",2026-09-01 10:00,,\n4,Z,1.1.1969,,\n'
    marked = read(spark, tmp_path / "a.csv", body)
    assert {r.source_row: r.issue for r in ingest.rejected(marked).collect()} == {
        7: "invalid_timestamp", 8: "impossible_timestamp", 9: "duplicate", 10: "missing_case_id", 11: "missing_activity", 12: "malformed_row", 15: "impossible_timestamp",
    }
    report = ingest.report(marked).first()
    assert report.total_rows == report.valid_rows + report.invalid_rows == 12 and report.single_event_cases == 1


def test_header_aliases_and_refusals(spark, tmp_path):
    assert read(spark, tmp_path / "a.csv", "Case ID;Activity Name;Event Time\n1;A;2026-01-01\n2;B;01/02/2026 10:00\n").where("issue IS NULL").count() == 2
    for body, said in (("case_id,activity\n1,A\n", "timestamp"), (b"case_id,\0activity", "binary"), ("  \n", "empty"), ("case_id,Case ID,activity,timestamp\n", "Several")):
        with pytest.raises(Exception, match=said):
            read(spark, tmp_path / "b.csv", body).count()


def test_latin1(spark, tmp_path):
    rows = read(spark, tmp_path / "a.csv", "case_id,activity,timestamp\n1,caf\xe9,2026-01-01\n".encode("latin-1")).collect()
    assert rows[0].activity == "café"


@pytest.mark.parametrize(
    ("value", "zone", "want"),
    [
        ("2026-03-08 02:30:00", "America/New_York", None), ("2026-11-01 01:30:00", "America/New_York", None), ("2026-07-01 12:00:00", "America/New_York", "2026-07-01T16:00:00"),
        ("03/04/2026", "UTC", "2026-03-04T00:00:00"), ("1 Sep 2026", "UTC", "2026-09-01T00:00:00"), ("2026-01-01T00:00:00.25Z", "UTC", "2026-01-01T00:00:00.250000"), ("2026-01-01T00:00:00+0530", "UTC", "2025-12-31T18:30:00"), ("soon", "UTC", None), (None, "UTC", None),
    ],
)
def test_times(spark, value, zone, want):
    got = spark.createDataFrame([(value,)], "t string").select(F.unix_micros(timestamps.parse_time(F.col("t"), zone)).alias("us")).first().us
    assert got == (None if want is None else round(dt.datetime.fromisoformat(want + "+00:00").timestamp() * 1_000_000))


def test_partitioned_events_are_replaced_per_data_set(spark, tmp_path):
    events = spark.createDataFrame([("1", "A", {"k": "v"})], "case_id string, activity string, extra map<string,string>")
    path = str(tmp_path / "events")
    for name in ("x", "y", "x"):
        sinks.write_events(events, path, name)
    assert sinks.read_events(spark, path, "x").collect() == [("1", "A")] and spark.read.parquet(path).count() == 2
    sinks.write_csv(spark.createDataFrame([("=1+1", 2)], "a string, b int"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().a == "'=1+1"


def test_text_functions(spark):
    df = spark.createDataFrame([('=HYPERLINK("x")', "It took 1,234.50 h because of 7 and 12.34; results from it", "1234.5 and 12.3")], "a string, b string, c string")
    r = df.select(text.escape_formula("a"), text.numbers_in("b"), text.causal_terms("b"), text.unverified_numbers("b", "c"), text.unverified_numbers("c", "b"), text.activity_key(F.lit(" A_b--C "))).first()
    assert list(r) == ["'=HYPERLINK(\"x\")", ["12.34", "1234.5", "7"], ["because", "results from"], ["12.34"], [], "a b c"]


def test_file_facts_and_quality(spark, tmp_path):
    body = b"Case ID,Activity,Timestamp,start_time,amount,Shop\n\n1,a,2026-01-01,soon,1,x\n1,A,2026-01-02,,many,y\n\n2,B,2026-01-03,,2,\xe9\n"
    (tmp_path / "a.csv").write_bytes(body)
    facts = event_csv.file_facts(spark, str(tmp_path / "a.csv"))
    f = facts.first()
    assert f.columns_detected[0] == "Case ID" and f.optional_columns == ["start_timestamp", "amount"] and f.extra_columns == ["shop"]
    assert (f.latin1, f.blank_lines, f.n_rows) == (True, 2, 3)
    found = tools.data_quality(ingest.mark(event_csv.read_event_csv(spark, str(tmp_path / "a.csv")), ["row_key"], now=NOW), facts)
    said = " ".join(r.warning for r in found["warnings"].collect())
    assert all(x in said for x in ("Latin-1", "1 events have a start", "1 amounts", "1 cases", "2 lines are blank"))
    assert [r.spellings for r in found["merges"].collect()] == [["A", "a"]] and found["columns"].count() == 1
    assert found["counts"].first().valid_rows == 3


def test_rejected_rows_for_people(spark, tmp_path):
    marked = read(spark, tmp_path / "a.csv", VALID + ',A,2026-09-01 10:00,ann,7\n9,A,2099-01-01 00:00,,\n1,2\n1,A,2026-09-01 10:00,ann,"1,200.5"\n')
    rows = ingest.rejected_export(marked).collect()
    assert [(r.source_row, r.issue, r.resource, r.raw_fields) for r in rows] == [
        (6, "missing_case_id", "ann", None), (7, "impossible_timestamp", "", None), (8, "malformed_row", None, "1 | 2"), (9, "duplicate", "ann", None),
    ]
    assert rows[1].detail == "'2099-01-01 00:00' has not come yet." and rows[0].asDict()["case_id"] == ""


def test_rows_of_several_files_keep_their_order(spark, tmp_path):
    head = "case_id,activity,timestamp\n"
    (tmp_path / "a.csv").write_text(head + "1,A,2026-01-01\n1,B,2026-01-02\n")
    (tmp_path / "b.csv").write_text(head + "1,B,2026-01-02\n")
    marked = ingest.mark(event_csv.read_event_csv(spark, str(tmp_path / "*.csv")), ["row_key"], now=NOW)
    assert [(r.file[-5:], r.source_row) for r in marked.where("issue = 'duplicate'").collect()] == [("b.csv", 2)]


@pytest.mark.parametrize(("name", "kind", "size", "ok"), [("a.CSV", "text/csv; charset=utf-8", 5, True), ("a.xlsx", "", 5, False), ("a.csv", "image/png", 5, False), ("a.csv", "", 0, False), ("a.txt", "", 51 << 20, False)])
def test_upload_gate(name, kind, size, ok):
    if ok:
        event_csv.check_upload(name, kind, size)
    else:
        with pytest.raises(event_csv.LogFileError):
            event_csv.check_upload(name, kind, size)


def test_row_limit_and_delimiters(spark, tmp_path):
    (tmp_path / "a.csv").write_text(VALID)
    with pytest.raises(Exception, match="more than 2 rows"):
        event_csv.read_event_csv(spark, str(tmp_path / "a.csv"), max_rows=2).count()
    for sign in ",;\t|":
        assert event_csv.delimiter(VALID.replace(",", sign) if sign != "," else VALID) == sign
    assert event_csv.delimiter("alone\nhere\n") == ","


def test_no_valid_event_fails_with_its_report(spark, tmp_path):
    marked = read(spark, tmp_path / "a.csv", "case_id,activity,timestamp\n,A,2026-01-01\n")
    with pytest.raises(event_csv.LogFileError) as failed:
        analyse(marked)
    assert failed.value.report["missing_case_id"] == 1


def test_results_are_kept_by_data_set_and_configuration(spark, tmp_path):
    path = str(tmp_path / "results")
    for name, key, n in (("x", "k1", 1), ("x", "k2", 2), ("x", "k1", 3), ("y", "k1", 4)):
        sinks.write_result(spark.range(n), path, name, key)
    assert {(r.dataset_id, r.config_key): r["count"] for r in spark.read.parquet(path).groupBy("dataset_id", "config_key").count().collect()} == {("x", "k1"): 3, ("x", "k2"): 2, ("y", "k1"): 4}


def test_labels_are_folded_not_lowered(spark):
    events = spark.createDataFrame([(str(i), t) for i, t in enumerate(["Straße", "STRASSE", "straße", "Weg"])], "case_id string, original_activity string")
    assert normalize.normalize(events).select("activity").distinct().count() == 2


LAYOUTS = {
    "31/12/2026 08:00": "2026-12-31T08:00:00", "1/2/2026 3:05 PM": "2026-01-02T15:05:00", "September 3, 2026": "2026-09-03T00:00:00", "20260903": "2026-09-03T00:00:00", "3-Sep-2026": "2026-09-03T00:00:00",
    "2026.9.3": "2026-09-03T00:00:00", "03/04/2026 23:59": "2026-03-04T23:59:00", "2026-09-01T10:00:00.5+0200": "2026-09-01T08:00:00.500000", "20260903T1011": "2026-09-03T10:11:00", "20260903101112": "2026-09-03T10:11:12",
    "9/1/2026 10:00 +02:00": "2026-09-01T08:00:00", "Tue, 01 Sep 2026 10:00:00 GMT": "2026-09-01T10:00:00", "Tuesday, September 1st, 2026 at 3pm": "2026-09-01T15:00:00", "1 Sept 2026": "2026-09-01T00:00:00",
    "2026 Sep 3 23:59:59": "2026-09-03T23:59:59", "Sep 3 2026 12:00 am": "2026-09-03T00:00:00", "5/6/2026 11:59:59.1234567 p.m.": "2026-05-06T23:59:59.123456", "99/12/31": "1999-12-31T00:00:00", "10:15 on": None,
    "2026-09-01 10:00:00 UTC": "2026-09-01T10:00:00", "MAY 7 2026": "2026-05-07T00:00:00", "10:30 3 March 2026": "2026-03-03T10:30:00", "2026/09/03,7:08": "2026-09-03T07:08:00", "13 PM 1/1/2026": None, "30/30/2026": None,
    "2026-02-30": None, "Feb 30 2026": None, "2026-09-01 24:00:00": None, "32": None, "12:00": None, "not a date": None, "Sep 2026 ten": None, "1/2/2026/3": None, "": None, None: None,
}


def test_layouts_by_shape(spark):
    """Values of shapes that are in no list: parts are read each by its own."""
    df = spark.createDataFrame(list(enumerate(LAYOUTS)), "i int, t string")
    got = [r.us for r in df.select("i", F.unix_micros(timestamps.parse_time(F.col("t"))).alias("us")).orderBy("i").collect()]
    assert got == [None if w is None else round(dt.datetime.fromisoformat(w + "+00:00").timestamp() * 1_000_000) for w in LAYOUTS.values()]


def test_every_date_with_every_clock(spark):
    """All combinations of layouts give the moment that they were written from, in UTC and in a zone of its own."""
    at = dt.datetime(2026, 11, 25, 17, 4, 9)
    dates = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d.%m.%Y", "%d-%m-%Y", "%d %b %Y", "%d-%B-%Y", "%b %d, %Y", "%B %d %Y", "%Y %b %d", "%Y%m%d", "%a %d %b %Y", "%A, %B %d, %Y", "%m/%d/%y"]
    clocks = [" %H:%M:%S", "T%H:%M:%S", " %I:%M:%S %p", ", %H:%M:%S", "  %I:%M:%S%p", " at %H:%M:%S", " %H:%M:%S.000000"]
    values = [at.strftime(d + c) for d in dates for c in clocks if not (c.startswith("T") and d.endswith("%B"))]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    for zone, hours in (("UTC", 0), ("America/New_York", 5)):
        found = df.select("t", F.unix_micros(timestamps.parse_time(F.col("t"), zone)).alias("us")).collect()
        want = round((at + dt.timedelta(hours=hours)).replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
        assert [r.t for r in found if r.us != want] == []


def test_copies_are_equal_in_every_column(spark):
    """Nulls are no empty texts, parts of a key are not run together, and rejected rows are nobody's copy."""
    rows = [(1, "a", None, "b"), (2, "a", "", "b"), (3, "a", None, "b"), (4, "ab", None, ""), (5, "a", "b", ""), (6, "a", "b", ""), (7, "", None, "b"), (8, "", None, "b")]
    raw = spark.createDataFrame([(i, c, x, y, "act", "2026-01-01") for i, c, x, y in rows], "source_row long, case_id string, x string, y string, activity string, timestamp string")
    marked = ingest.mark(raw, ["case_id", "x", "y"], now=NOW)
    assert {r.source_row: r.issue for r in marked.collect() if r.issue} == {3: "duplicate", 6: "duplicate", 7: "missing_case_id", 8: "missing_case_id"}
    assert marked.columns == [*raw.columns, "parsed_timestamp", "parsed_start", "issue"]


def test_large_numbers_keep_all_their_digits(spark):
    """The JVM's formatter wrote zeros from the 17th digit on."""
    said = "5294421737731070724 and 83,688,348,825,957,207,214,838.5, 9007199254740993 or 1e5, 0.125 2.675 007 " + "9" * 400
    got = spark.createDataFrame([(said,), (None,), ("",)], "t string").select(text.numbers_in("t").alias("n")).collect()
    assert [sorted(r.n) for r in got] == [sorted({"5294421737731070976", "83688348825957200560128", "9007199254740992", "0.12", "1", "2.67", "7", "inf"}), [], []]


def test_a_log_is_marked_once_for_its_rejected_rows_and_its_counts(spark):
    """The log used to be marked again for the names of raw columns, for the places of the sort, and for the warnings."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = [(i, "" if i % 2 else f"c{i}", "A", "2026-01-01", {"Line": str(i)}) for i in range(40)]
    raw = spark.createDataFrame(rows, "source_row long, case_id string, activity string, timestamp string, raw map<string,string>").repartition(3)
    marked = ingest.mark(raw.withColumn("activity", counted.asNondeterministic()("activity")), ["case_id"], now=NOW)
    out = ingest.rejected_export(marked)
    assert [(r.source_row, r.Line) for r in out.collect()] == [(i, str(i)) for i in range(1, 40, 2)] and seen.value == 40
    found = tools.data_quality(marked)
    assert found["counts"].first().total_rows == 40 and seen.value == 80
    assert found["warnings"].count() == 1 and seen.value == 80
