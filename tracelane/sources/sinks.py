"""Tables of events and results, and files for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.functions.text import escape_formula


#: Buckets of a new event table: at a terabyte of events one has 4 GB, which a window sorts and spills.
BUCKETS = 256


def write_events(events: DataFrame, path: str, dataset_id: str) -> None:
    """One partition per data set; its former rows are replaced, other data sets stay."""
    events.withColumn("dataset_id", F.lit(dataset_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)


def read_events(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """Only the data set's partition is read, and ``extra`` is not."""
    return spark.read.parquet(path).where(F.col("dataset_id") == dataset_id).drop("extra", "dataset_id")


def write_result(result: DataFrame, path: str, dataset_id: str, config_key: str) -> None:
    """Results are kept by data set and configuration."""
    keyed = result.withColumns({"dataset_id": F.lit(dataset_id), "config_key": F.lit(config_key)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id", "config_key").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Text columns are made safe for spreadsheets."""
    safe = [escape_formula(c).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in rows.dtypes]
    rows.select(*safe).write.mode("overwrite").option("header", True).csv(path)


def write_event_table(events: DataFrame, table: str, dataset: str, buckets: int = BUCKETS) -> None:
    """Events into a table of the catalog that is bucketed and sorted by case; those of the same data set are replaced.

    The shuffle by case is paid once, here. What is read back by ``read_event_table`` is dealt by case already, so frames
    and cases are made where the buckets lie. Each bucket is one file for a data set, so its events stay in order.
    ``buckets`` counts when the table is made; later data sets are dealt to as many.
    """
    spark = events.sparkSession
    named = events.withColumn("dataset_id", F.lit(dataset))
    if not spark.catalog.tableExists(table):
        named.limit(0).write.partitionBy("dataset_id").bucketBy(buckets, "case_id").sortBy("case_id", "timestamp", "source_row").format("parquet").saveAsTable(table)
    own = next(int(r.data_type) for r in spark.sql(f"DESCRIBE FORMATTED {table}").collect() if r.col_name == "Num Buckets")
    into = spark.table(table).columns
    mode = "spark.sql.sources.partitionOverwriteMode"  # a table takes it from the session alone
    before = spark.conf.get(mode)
    try:
        spark.conf.set(mode, "dynamic")
        named.repartition(own, "case_id").select(*into).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def read_event_table(spark: SparkSession, table: str, dataset: str) -> DataFrame:
    """The events of a data set, dealt by case as they were stored."""
    return spark.table(table).where(F.col("dataset_id") == dataset).drop("dataset_id")
