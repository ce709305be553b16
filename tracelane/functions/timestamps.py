"""Timestamps in the layouts that people and programs write, read by the shape of each value, in built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelane.functions.text import strip

#: Fixed values.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_CLOCK = r"(?i)(?<![\d:])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(?:([ap])\.?m\.?)?(?![\d:])"
_HOUR = r"(?i)(?<![\d:])(\d{1,2})()()()\s*([ap])\.?m\.?(?![a-z])"
_PACKED = r"^\d{8}[tT ]?(\d{2})(\d{2})(\d{2})?()()$"
_OFFSET = r"(?i)(?<=[\d\s.m])\s*(z|utc|gmt|[+-]\d{2}:?\d{2})$"
_WEEKDAY = rf"(?i)\b(?:{'|'.join(f'{d[:3]}(?:{d[3:]})?' for d in DAYS)}|tues|thurs?)\b\.?,?"
_MONTH = rf"({'|'.join(f'{m[:3]}(?:{m[3:]})?' if len(m) > 3 else m for m in MONTHS)}|sept)\.?"
_YEAR, _ONE, _SIGN = r"(\d{4}|\d{2})", r"(\d{1,2})(?:st|nd|rd|th)?", r"[-/.,\s]*"
#: Shapes of a date: pattern, and which of its groups are year, month and day.
_DATES = (
    (r"^(\d{4})([-/.\s])(\d{1,2})\2(\d{1,2})$", (1, 3, 4)), (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)), (rf"(?i)^{_ONE}{_SIGN}{_MONTH}{_SIGN}{_YEAR}$", (3, 2, 1)),
    (rf"(?i)^{_MONTH}{_SIGN}{_ONE}[-/.,\s]+{_YEAR}$", (3, 1, 2)), (rf"(?i)^(\d{{4}}){_SIGN}{_MONTH}{_SIGN}{_ONE}$", (1, 2, 3)),
)
_NUMBERS = r"^(\d{1,2})([-/.\s])(\d{1,2})\2(\d{4}|\d{2})$"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _two(x: Column) -> Column:
    return F.lpad(F.coalesce(F.nullif(x, F.lit("")), F.lit("0")), 2, "0")


def _year(x: Column) -> Column:
    """Four digits; of two digits the year nearest to this one, less than 50 years ahead."""
    near = F.lit(2000) + x.try_cast("int")
    return F.when(F.length(x) == 4, x).otherwise((near - F.when(near >= F.year(F.current_date()) + 50, 100).otherwise(0)).cast("string"))


def _month(x: Column) -> Column:
    """A number of two digits for a month's name, its first three letters or more, or its number."""
    names = F.array(*[F.lit(m[:3]) for m in MONTHS])
    return F.when(x.rlike(r"^\d+$"), _two(x)).otherwise(_two(F.array_position(names, F.lower(F.substring(x, 1, 3))).cast("string")))


def _date(d: Column) -> Column:
    """``yyyy-mm-dd`` of a date's text, null for none. Of two numbers before the year the month comes first where it can be."""
    out = F.lit(None).cast("string")
    first, second, year = (F.regexp_extract(d, _NUMBERS, i) for i in (1, 3, 4))
    day_first = first.try_cast("int") > 12
    numbers = F.concat_ws("-", _year(year), _two(F.when(day_first, second).otherwise(first)), _two(F.when(day_first, first).otherwise(second)))
    year_first = F.concat_ws("-", _year(first), _two(second), _two(year))  # no day is over 31
    out = F.when(d.rlike(_NUMBERS), F.when((first.try_cast("int") > 31) & (F.length(year) == 2), year_first).otherwise(numbers))
    for pattern, (y, m, day) in _DATES:
        out = out.when(d.rlike(pattern), F.concat_ws("-", _year(F.regexp_extract(d, pattern, y)), _month(F.regexp_extract(d, pattern, m)), _two(F.regexp_extract(d, pattern, day))))
    return out


def _time(s: Column, pattern: str) -> Column:
    """``hh:mm:ss.ffffff`` of the first clock time of that pattern, null where its hour cannot be."""
    hour, minute, second, part, half = (F.regexp_extract(s, pattern, i) for i in range(1, 6))
    h = hour.try_cast("int")
    of_day = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
    whole = F.concat(_two(of_day.cast("string")), F.lit(":"), _two(minute), F.lit(":"), _two(second), F.lit("."), F.rpad(F.substring(part, 1, 6), 6, "0"))
    return F.when(of_day.isNotNull(), whole)


def _by_shape(s: Column, local: Callable[[Column], Column]) -> Column:
    """The slow way: offset, clock and date are told apart, and each is read by its own shape."""

    def read(p: Column) -> Column:
        moment = F.concat(p["date"], F.lit(" "), p["time"])
        offset = F.when(p["offset"].rlike("(?i)^(z|utc|gmt)$"), F.lit("Z")).otherwise(F.regexp_replace(p["offset"], r"^(...)(\d\d)$", "$1:$2"))
        return F.when(p["offset"] == "", local(F.concat(moment, F.lit("Z")).try_cast("timestamp"))).otherwise(F.concat(moment, offset).try_cast("timestamp"))

    def divided(p: Column) -> Column:
        rest, packed = p["rest"], p["rest"].rlike(_PACKED)
        time = F.when(packed, _time(rest, _PACKED)).when(rest.rlike(_CLOCK), _time(rest, _CLOCK)).when(rest.rlike(_HOUR), _time(rest, _HOUR)).otherwise(F.lit("00:00:00.000000"))
        date = F.when(packed, F.substring(rest, 1, 8)).when(rest.rlike(_CLOCK), F.regexp_replace(rest, _CLOCK, " ")).otherwise(F.regexp_replace(rest, _HOUR, " "))
        date = F.regexp_replace(F.regexp_replace(date, _WEEKDAY, " "), r"(?i)^[\s,]+|(?<=\d)t(?=\s*$)|\bat\b|[\s,]+$", "")
        date = F.regexp_replace(date, r"(?i)(?<=\d)t\s*$|[\s,]+$", "")
        return _let(F.struct(_let(date, _date).alias("date"), time.alias("time"), p["offset"].alias("offset")), read)

    clocked = s.rlike(":") | s.rlike(_HOUR) | s.rlike(r"^\d{8}[tT ]?\d{4}")
    offset = F.when(clocked, F.regexp_extract(s, _OFFSET, 1)).otherwise(F.lit(""))
    rest = F.when(offset != "", F.regexp_replace(s, _OFFSET, "")).otherwise(s)
    return _let(F.struct(rest.alias("rest"), offset.alias("offset")), divided)


def parse_stripped(s: Column, zone: str = "UTC") -> Column:
    """``parse_time`` of a text without white space at its ends."""
    hour = F.expr("INTERVAL 1 HOUR")

    def local(t: Column) -> Column:
        if zone == "UTC":
            return t
        utc = F.to_utc_timestamp(t, zone)
        back = lambda x: F.from_utc_timestamp(x, zone)
        return F.when((back(utc) == t) & (back(utc + hour) != t) & (back(utc - hour) != t), utc)

    at = lambda i: F.substring(s, i, 1)
    day = (at(5) == "-") & (at(8) == "-")
    read = lambda more: local(F.concat(s, F.lit(more)).try_cast("timestamp"))
    quick = (
        F.when(day & (at(14) == ":") & (at(17) == ":"), F.when(F.substring(s, -1, 1) == "Z", s.try_cast("timestamp")).otherwise(read("Z")))
        .when(day & (F.length(s) == 16) & (at(14) == ":"), read(":00Z")).when(day & (F.length(s) == 10), read(" 00:00:00Z"))
    )
    return F.coalesce(quick, F.when(s.rlike("[0-9]"), _by_shape(s, local)))


def parse_time(text: Column, zone: str = "UTC") -> Column:
    """A timestamp from text, null where it cannot be read.

    Read are ISO 8601 and any combination of a date (year first; two numbers before the year, the month first where both
    can be meant; a month's name with day and year in any usual order; eight digits), a clock time (with seconds, fractions,
    am or pm, or packed behind eight digits), an offset (Z, UTC, GMT, +hh:mm), a weekday's name, and usual signs between.

    A value without an offset is wall-clock time of ``zone``; where that time does not exist or exists twice, null. The
    session's zone plays no part. Values in ISO 8601 are cast at once; only others are taken apart by their shape.
    """
    return parse_stripped(strip(text), zone)
