"""Text functions on columns: activity spelling, trace text, export safety, checks of written answers."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wordings that claim a cause. Fixed values.
CAUSAL_TERMS = (
    r"\bbecause\b", r"\bdue to\b", r"\bcaused by\b", r"\bresults? from\b", r"\bthe reason\b", r"\bunderstaffed\b",
    r"\bunderperform\w*", r"\blazy\b", r"\bincompeten\w*", r"\binefficient (?:staff|employee|person)\b",
)
#: A number that is not part of a word or of a longer number. Fixed value.
NUMBER = r"(?<![\w.])\d[\d,]*(?:\.\d+)?"


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without Unicode white space at both ends; a text that begins and ends with plain letters or signs is not searched."""
    c = _column(x)
    plain = lambda at: F.ascii(F.substring(c, at, 1)).between(33, 126)
    return F.when(plain(1) & plain(-1), c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def casefold(x: Column | str) -> Column:
    """Full Unicode case folding, which lower-casing is not (``ß`` and ``SS``). Meant for distinct labels, not for events."""

    @F.arrow_udf("string")
    def fold(values: pa.Array) -> pa.Array:
        return pa.array([v if v is None else v.casefold() for v in values.to_pylist()], pa.string())

    return fold(_column(x))


def likeness(x: Column | str, wanted: str) -> Column:
    """Ratcliff-Obershelp ratio of a text to ``wanted``, from 0 to 1. Meant for distinct labels."""

    @F.arrow_udf("double")
    def ratio(values: pa.Array) -> pa.Array:
        matcher = difflib.SequenceMatcher(b=wanted)  # what it learns about the second text serves all first ones
        out = []
        for v in values.to_pylist():
            matcher.set_seq1(v or "")
            out.append(matcher.ratio())
        return pa.array(out, pa.float64())

    return ratio(_column(x))


def activity_key(x: Column | str) -> Column:
    """What spellings of one activity share: runs of white space, ``_`` and ``-`` are one blank, and case is folded."""
    return casefold(strip(F.regexp_replace(_column(x), r"(?U)[\s_\-]+", " ")))


def tidy(x: Column | str) -> Column:
    """White space collapsed, spelling kept."""
    return strip(F.regexp_replace(_column(x), r"(?U)\s+", " "))


def trace_text(trace: Column | str) -> Column:
    return F.array_join(_column(trace), " → ")


def escape_formula(x: Column | str) -> Column:
    """Text that a spreadsheet would run as a formula gets an apostrophe in front."""
    return F.regexp_replace(_column(x), r"^([=+\-@\t\r])", "'$1")


def causal_terms(x: Column | str) -> Column:
    """Sorted distinct causal wordings in a text, lower-cased; none for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_column(x), F.lit(""))), F.lit("|".join(CAUSAL_TERMS)), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def _plain(numbers: Column) -> Column:
    """Texts of numbers, each with two decimals at most and no trailing zeros, its binary value rounded correctly, ties to even.

    All digits of a large value are written, which the JVM's formatter fills up with zeros from the 17th on.
    """

    @F.arrow_udf("array<string>")
    def plain(values: pa.Array) -> pa.Array:
        return pa.array([v if v is None else [n if n is None else _two_decimals(float(n)) for n in v] for v in values.to_pylist()], pa.list_(pa.string()))

    return plain(numbers)


def _two_decimals(x: float) -> str:
    out = f"{x:.2f}"
    return out.rstrip("0").rstrip(".") if "." in out else out


def fact_value(value: Column | str, unit: Column | str) -> Column:
    """A figure for people: thousands separators, two decimals at most without trailing zeros, then its unit; ``%`` without a blank."""
    x, u = _column(value), F.coalesce(_column(unit), F.lit(""))
    plain = F.get(_plain(F.array(F.abs(x).cast("string"))), F.lit(0))
    whole = F.regexp_replace(F.regexp_extract(plain, r"^\d+", 0), r"(?<=\d)(?=(\d{3})+$)", ",")
    shown = F.concat(F.when((x < 0) & (plain != "0"), F.lit("-")).otherwise(F.lit("")), whole, F.regexp_extract(plain, r"\..*$", 0))
    return F.concat(shown, F.when(u.isin("", "%"), u).otherwise(F.concat(F.lit(" "), u)))


def numbers_in(x: Column | str) -> Column:
    """Sorted distinct numbers of a text without thousands separators, with two decimals at most."""
    found = F.regexp_extract_all(F.coalesce(_column(x), F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.array_sort(F.array_distinct(_plain(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(""))))))


def unverified_numbers(answer: Column | str, source: Column | str) -> Column:
    """Numbers of ``answer`` that ``source`` has neither as they are nor rounded to one decimal or none. Single digits pass."""
    known = numbers_in(source)
    rounded = F.flatten(F.array(
        F.transform(known, lambda n: F.regexp_replace(F.format_string("%.1f", n.try_cast("double")), r"\.0$", "")),
        F.transform(known, lambda n: F.format_string("%d", F.rint(n.try_cast("double")).cast("long"))),
    ))
    open_ = F.array_except(numbers_in(answer), F.concat(known, rounded))
    return F.filter(open_, lambda n: F.length(F.replace(n, F.lit("."), F.lit(""))) > 1)
