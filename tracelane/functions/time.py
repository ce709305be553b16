"""Time as exact microseconds, without going through the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR_US = 3_600_000_000


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP, a TIMESTAMP_NTZ (taken as UTC) or a DATE column."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("long") * F.lit(86_400_000_000)
    return F.expr(f"CAST(CAST(CAST(`{name}` - TIMESTAMP_NTZ '1970-01-01' AS INTERVAL SECOND) AS DECIMAL(20, 6)) * 1000000 AS BIGINT)")


def hours(us: Column | str) -> Column:
    """Microseconds (a long, a sum or an average of longs) as hours."""
    return (F.col(us) if isinstance(us, str) else us) / F.lit(float(HOUR_US))


def iso_time(us: str) -> Column:
    """Microseconds since 1970 as ISO 8601 text in UTC, whatever the session's zone; a fraction only where there is one."""
    utc = F.expr(f"TIMESTAMP_NTZ '1970-01-01' + make_dt_interval(0, 0, 0, CAST(`{us}` / 1000000BD AS DECIMAL(18, 6)))")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col(us) % 1_000_000 != 0, F.date_format(utc, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def mean_hours(us: str) -> Column:
    """Mean of a long column in hours, as an exact sum divided once."""
    return F.sum(us) / F.count(us) / F.lit(float(HOUR_US))
