"""Which rows of a raw log are events, which are rejected and why."""

from __future__ import annotations

import datetime as dt
import weakref

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.functions.size import dealt
from tracelane.functions.text import strip
from tracelane.functions.timestamps import parse_stripped

#: The first that holds is a row's issue.
ISSUES = ("malformed_row", "missing_case_id", "missing_activity", "invalid_timestamp", "impossible_timestamp", "duplicate")
OPTIONAL = ("resource", "department", "status", "customer_id", "location", "priority")


def mark(raw: DataFrame, key: list[str], zone: str = "UTC", now: dt.datetime | None = None, rows: int = 0) -> DataFrame:
    """``raw`` with its texts trimmed, ``parsed_timestamp``, ``parsed_start`` and ``issue``, null for an event.

    ``raw``: source_row, case_id, activity, timestamp as text, and if there start_timestamp and malformed (boolean).
    ``key``: the columns that make a duplicate if all are equal; the first row in the order of files (``file``, if there is
    one) and rows stays. Only rows without another issue are compared: by a hash of the key first, then by the key itself, and
    all others are dealt by a hash of their place, so rejected rows are never a hot group. Timestamps before 1970 or over a day after ``now`` are impossible, as is a start after
    its end; a start that cannot be read is dropped and the event stays. ``rows``: about how many rows ``raw`` has, where that
    is known without reading it, so that copies in a large log are searched for in tasks of bounded size.
    """
    limit = now or dt.datetime.now(dt.timezone.utc)
    text = raw.withColumns({c: strip(c) for c in ("case_id", "activity", "timestamp", "start_timestamp") if c in raw.columns})
    start = parse_stripped(F.col("start_timestamp"), zone) if "start_timestamp" in raw.columns else F.lit(None).cast("timestamp")
    text = text.withColumns({"parsed_timestamp": parse_stripped(F.col("timestamp"), zone), "parsed_start": start})
    ts, began = F.col("parsed_timestamp"), F.col("parsed_start")
    latest = F.timestamp_micros(F.lit(int(limit.timestamp() * 1_000_000) + 86_400_000_000))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    issue = (
        F.when(F.col("malformed") if "malformed" in raw.columns else F.lit(False), "malformed_row").when(blank("case_id"), "missing_case_id").when(blank("activity"), "missing_activity")
        .when(ts.isNull(), "invalid_timestamp").when((F.unix_micros(ts) < 0) | (ts > latest) | F.coalesce(began > ts, F.lit(False)), "impossible_timestamp")
    )
    marked = text.withColumn("issue", issue)
    order = [c for c in ("file", "source_row") if c in raw.columns]
    ok, names = F.col("issue").isNull(), [f"__key{i}" for i in range(len(key))]
    flat = [x for c in key for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())]  # a hash passes over nulls
    keyed = marked.withColumns({"__hash": F.when(ok, F.xxhash64(*flat)).otherwise(F.xxhash64(*order)), **{n: F.when(ok, F.col(c)) for n, c in zip(names, key, strict=True)}})
    keyed = dealt(keyed, "__hash", rows)
    copies = F.row_number().over(W.partitionBy("__hash", *names).orderBy(*order)) > 1
    return keyed.withColumn("issue", F.when(ok & copies, "duplicate").otherwise(F.col("issue"))).drop("__hash", *names)


def detail(zone: str = "UTC") -> Column:
    """What is wrong with a marked row, in words; null for an event."""
    return (
        F.when(F.col("issue") == "malformed_row", F.lit("The row has another number of fields than the header."))
        .when(F.col("issue") == "missing_case_id", "No case is named.").when(F.col("issue") == "missing_activity", "No activity is named.")
        .when(F.col("issue") == "invalid_timestamp", F.format_string("No time can be read from '%s'.", F.coalesce("timestamp", F.lit(""))))
        .when((F.col("issue") == "impossible_timestamp") & (F.col("parsed_start") > F.col("parsed_timestamp")), "It starts after its end.")
        .when((F.col("issue") == "impossible_timestamp") & (F.unix_micros("parsed_timestamp") < 0), F.format_string("'%s' lies before 1970.", F.col("timestamp")))
        .when(F.col("issue") == "impossible_timestamp", F.format_string("'%s' has not come yet.", F.col("timestamp")))
        .when(F.col("issue") == "duplicate", "An earlier row has the same values.")
    )


def events(marked: DataFrame) -> DataFrame:
    """The rows without issue in the schema of events."""
    have = set(marked.columns)
    optional = [F.nullif(strip(c), F.lit("")).alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in OPTIONAL]
    amount = number("amount") if "amount" in have else F.lit(None).cast("double")
    extra = F.col("extra") if "extra" in have else F.lit(None).cast("map<string,string>")
    return marked.where("issue IS NULL").select(
        F.col("source_row").cast("long").alias("source_row"), "case_id", F.col("activity").alias("original_activity"), F.col("parsed_timestamp").alias("timestamp"),
        F.col("parsed_start").alias("start_timestamp"), *optional, amount.alias("amount"), extra.alias("extra"),
    )


def rejected(marked: DataFrame, issue: str | None = None) -> DataFrame:
    """Rows with an issue (or one of them) and its ``detail``, in the order of files and rows."""
    return _explained(marked, issue).orderBy(*_order(marked))


def _explained(marked: DataFrame, issue: str | None = None) -> DataFrame:
    return marked.where("issue IS NOT NULL" if issue is None else F.col("issue") == issue).withColumn("detail", detail())


def _order(marked: DataFrame) -> list[str]:
    return [c for c in ("file", "source_row") if c in marked.columns]


def rejected_export(marked: DataFrame) -> DataFrame:
    """Rejected rows for people: source_row, issue, detail, a column for each raw column that any of them has, raw_fields.

    ``marked`` may have ``raw`` (map of column to text); the columns come in the order in which rows first have them. Of
    malformed rows only ``raw_fields`` is known. The names of all raw columns reach the driver, as column names must.

    The log is marked once: the rejected rows are kept while the result is held, for the names, the places and the sort.
    """
    rows, order = _explained(marked), _order(marked)
    if "raw" not in marked.columns:
        return rows.orderBy(*order).select(*order, "issue", "detail")
    rows = rows.select(*order, "issue", "detail", "raw").persist(StorageLevel.MEMORY_AND_DISK)
    names = rows.select(F.struct(*order).alias("row"), F.posexplode(F.map_keys("raw")).alias("place", "name")).groupBy("name").agg(F.min(F.struct("row", "place")).alias("first"))
    found = [r.name for r in names.where("name <> 'raw_fields'").orderBy("first").select("name").collect()]
    taken = {c.lower() for c in (*order, "issue", "detail", "raw_fields")}
    own = [F.col("raw")[n].alias(n if n.lower() not in taken else f"raw_{n}") for n in found]
    out = rows.orderBy(*order).select(*order, "issue", "detail", *own, F.col("raw")["raw_fields"].alias("raw_fields"))
    weakref.finalize(out, rows.unpersist).atexit = False
    return out


def report(marked: DataFrame) -> DataFrame:
    """One row: total, valid and invalid rows, rows by issue, cases, cases of one event, and values that were left empty.

    ``unreadable_starts``: events whose start could not be read; ``unreadable_amounts``: events whose amount is no number.
    """
    ok, zero = F.col("issue").isNull(), F.lit(0).cast("long")
    lost = lambda text, read: F.count_if(ok & (F.coalesce(F.col(text), F.lit("")) != "") & read.isNull()) if text in marked.columns else zero
    per_case = marked.groupBy(F.when(ok, F.col("case_id")).alias("case_id")).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("valid"), *[F.count_if(F.col("issue") == x).alias(x) for x in ISSUES],
        (lost("start_timestamp", F.col("parsed_start"))).alias("unreadable_starts"), (lost("amount", number("amount"))).alias("unreadable_amounts"),
    )
    own = F.col("case_id").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), zero)
    return per_case.agg(
        total("n").alias("total_rows"), total("valid").alias("valid_rows"), (total("n") - total("valid")).alias("invalid_rows"), *[total(x).alias(x) for x in ISSUES],
        F.count_if(own).alias("total_cases"), F.count_if(own & (F.col("valid") == 1)).alias("single_event_cases"), total("unreadable_starts").alias("unreadable_starts"), total("unreadable_amounts").alias("unreadable_amounts"),
    )


def number(name: str) -> Column:
    """A number that may have thousands separators; null where it is none."""
    return F.replace(F.col(name), F.lit(","), F.lit("")).try_cast("double")


def warnings(facts: DataFrame | None, counts: DataFrame) -> DataFrame:
    """``warning``: what a user should know besides the rejected rows. ``facts``: of ``event_csv.file_facts``; ``counts``: ``report``."""
    said = [
        ("unreadable_starts", "%d events have a start that is no time; their processing time is unknown."), ("unreadable_amounts", "%d amounts are no numbers and count as missing."),
        ("single_event_cases", "%d cases have a single event and so no transition."),
    ]
    own = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).alias("n"), F.format_string(t, F.col(c)).alias("warning")) for i, (c, t) in enumerate(said, 1)])).alias("w")).select("w.*")
    if facts is not None:
        blank = facts.agg(F.coalesce(F.sum("blank_lines"), F.lit(0).cast("long")).alias("n"))
        own = own.unionByName(facts.where("latin1").select(F.lit(0).alias("place"), F.lit(1).cast("long").alias("n"), F.format_string("%s was read as Latin-1, since it is no UTF-8; letters with accents may be wrong.", "file").alias("warning")))
        own = own.unionByName(blank.select(F.lit(9).alias("place"), "n", F.format_string("%d lines are blank and were passed over.", "n").alias("warning")))
    return own.where("n > 0").orderBy("place", "warning").select("warning")
