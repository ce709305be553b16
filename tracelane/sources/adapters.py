"""Event logs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.functions.size import dealt


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str, with_start: bool = False) -> DataFrame:
    """``events``: one case per user and day. ``with_start``: ``value`` minutes count as processing time."""
    e = _table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    out = e.select(
        F.col("event_id").alias("source_row"), F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("case_id"), F.col("event_type").alias("activity"),
        F.col("ts").alias("timestamp"), F.col("value").alias("amount"), F.concat(F.lit("R"), k % 10).alias("resource"), F.concat(F.lit("D"), k % 4).alias("department"),
    )
    if not with_start:
        return out
    # NTZ minus a day-time interval stays NTZ; the interval is whole microseconds.
    return out.withColumn("start_timestamp", F.col("timestamp") - F.expr("make_dt_interval(0, 0, 0, CAST(CAST(round(amount * 60000000) AS BIGINT) / 1000000BD AS DECIMAL(18, 6)))"))


def user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: one long case per user."""
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("source_row"), F.col("user_id").cast("string").alias("case_id"), F.col("event_type").alias("activity"), F.col("ts").alias("timestamp"))


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations``: a turn is an event, one hour after the turn before."""
    c = _table(spark, sf_dir, "conversations")
    at = F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, CAST(turn AS INT), 0, 0)")
    return c.select(F.col("turn").alias("source_row"), F.col("conv_id").cast("string").alias("case_id"), F.col("role").alias("activity"), at.alias("timestamp"))


#: The first two words of a text.
OPENING = r"^[^\p{L}]*(\p{L}+)[^\p{L}]+(\p{L}+)"


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations``: a turn is an event, one hour after the turn before; a user's turn is named by its first two words."""
    c = _table(spark, sf_dir, "conversations")
    at = F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, CAST(turn AS INT), 0, 0)")
    words = [F.regexp_extract("text", OPENING, i) for i in (1, 2)]
    activity = F.when((F.col("role") == "user") & (words[1] != ""), F.concat_ws("_", *words)).otherwise(F.col("role"))
    return c.select(F.col("turn").alias("source_row"), F.col("conv_id").cast("string").alias("case_id"), activity.alias("activity"), at.alias("timestamp"))


def order_rows(spark: SparkSession, sf_dir: str) -> int:
    """Events of ``order`` at most, by the files' footers."""
    return _table(spark, sf_dir, "lineitem").count()


def order(spark: SparkSession, sf_dir: str, by_case: bool = True) -> DataFrame:
    """``lineitem`` and ``orders``: a line is an event of its order, started at the order's date.

    Large logs are joined in tasks of bounded size and, ``by_case``, dealt so by case for what frames them.
    """
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    start = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = order_rows(spark, sf_dir)
    line, start = dealt(line, "l_orderkey", rows), dealt(start, "l_orderkey", rows)
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"))
    out = line.join(start, "l_orderkey").select(
        place.cast("long").alias("source_row"), F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_returnflag").alias("activity"), F.col("l_shipdate").alias("timestamp"),
        F.col("o_orderdate").alias("start_timestamp"), F.col("l_suppkey").cast("string").alias("resource"),
    )
    return dealt(out, "case_id", rows) if by_case else out
