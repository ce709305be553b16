"""Tables that are small enough to be constants of a plan, and rows dealt so that no task holds too many."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a table of constants may have.
MOST_ROWS = 20_000
#: Rows that one task should sort.
TASK_ROWS = 500_000


def bounded(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df`` as a table of constants if it has at most ``most`` rows, else as it is.

    One job reads at most ``most`` + 1 rows. Joins with constants are broadcast by Spark, since their size is known; a
    larger table is joined by a shuffle.
    """
    rows = df.limit(most + 1).toArrow()
    return df if rows.num_rows > most else df.sparkSession.createDataFrame(rows, df.schema)


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` rows, dealt by ``key`` so that a task holds about TASK_ROWS of them.

    Left to itself, Spark deals a table to a number of tasks that does not grow with it. Up to TASK_ROWS for each core that
    is left so; what comes then needs no other shuffle by ``key``.
    """
    tasks = -(-rows // TASK_ROWS)
    return df if tasks <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(tasks, key)
