"""Exact quantiles whose state does not grow with a group: order statistics are looked up by rank in value cells."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.functions.size import bounded
from tracelane.functions.time import HOUR_US

#: Width of a cell as a power of two: 2^26 microseconds are 67 seconds.
CELL_BITS = 26
#: The same where cells are counted before values: 2^31 microseconds are 36 minutes.
COARSE_BITS = 31
#: Rows whose distinct values may be held in one aggregate.
FEW_ROWS = 5_000_000
#: The shares that the spreads hold, in this order.
SHARES = (0.25, 0.5, 0.75, 0.9, 0.95)
#: What a spread of events can tell: the measured column and the columns that are its group.
EVENT_KINDS = {"pair": ("gap_us", "prev_activity", "activity"), "wait": ("wait_us", "activity", None), "proc": ("proc_us", "activity", None), "log": ("wait_us", None, None), "resource": ("wait_us", "resource", None)}


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: Iterable[float] = SHARES, size: int | None = None, kept: bool = False) -> DataFrame:
    """``keys`` and ``q``: for each group the quantiles of a long column, by linear interpolation between neighbours.

    Null values do not count; a group without a value has no row. Keys may be null. ``size``: how many rows there are at
    most, if that is known. Up to FEW_ROWS of them one aggregate does it all, since its state is bounded by that; the
    results are the same.

    Otherwise equal values of a group are counted before anything is shuffled. Counts are summed up within cells of
    2^CELL_BITS and then over the cells of a group, so each wanted rank is found in one cell. Everything is a hash
    aggregate or a sorted running sum, which spill; no task holds a group.

    ``kept``: ``rows`` are persisted, so that they can be read twice. Then rows are counted by cell first, by a job of its
    own, and only the values of cells that hold a wanted rank are counted and shuffled, if these cells are few.
    """
    shares = [float(s) for s in shares]
    wanted = f"array({', '.join(f'{s!r}D' for s in shares)})"
    long = rows.select(*keys, F.col(value).cast("long").alias("__v")).where("__v IS NOT NULL")
    if size is not None and size <= FEW_ROWS:
        return long.groupBy(*keys).agg(F.expr(f"percentile(__v, {wanted})").alias("q"))
    own = [f"__k{i}" for i in range(len(keys))]  # joins need keys that are never null
    long = long.select(*[F.struct(k).alias(o) for k, o in zip(keys, own, strict=True)], "__v", F.expr(f"shiftright(__v, {COARSE_BITS if kept else CELL_BITS}) AS __cell"))
    counted = long.groupBy(*own, "__cell", "__v").agg(F.count("*").alias("__n"))
    by, group = ", ".join([*own, "__cell"]), ", ".join(own) or "0"
    upto = f"sum(__n) OVER (PARTITION BY {by} ORDER BY __v ROWS UNBOUNDED PRECEDING)"
    counted = counted.withColumn("__upto", F.expr(upto))
    sized = long.groupBy(*own, "__cell").agg(F.count("*").alias("__size")) if kept else counted.groupBy(*own, "__cell").agg(F.sum("__n").alias("__size"))
    cells = sized.selectExpr(
        *own, "__cell", f"sum(__size) OVER (PARTITION BY {group} ORDER BY __cell ROWS UNBOUNDED PRECEDING) - __size AS __begin", "__size", f"sum(__size) OVER (PARTITION BY {group}) AS __total"
    )
    place = "s * (__total - 1)"
    ranks = f"transform({wanted}, (s, i) -> named_struct('i', i, 'low', floor({place}), 'high', ceil({place}), 'part', {place} - floor({place})))"
    inside = lambda x, begin, end: f"({x} >= {begin} AND {x} < {end})"
    hit = lambda begin, end: f"filter(__ranks, x -> {inside('x.low', begin, end)} OR {inside('x.high', begin, end)}) AS __ranks"
    cells = cells.selectExpr("*", f"{ranks} AS __ranks").selectExpr(*own, "__cell", "__begin", hit("__begin", "__begin + __size")).where("size(__ranks) > 0")
    if kept:
        cells = bounded(cells)
        wanted_cells = cells.select(*own, "__cell")
        counted = long.join(wanted_cells, [*own, "__cell"], "left_semi").groupBy(*own, "__cell", "__v").agg(F.count("*").alias("__n"))
        counted = counted.withColumn("__upto", F.expr(upto))
    found = counted.join(cells, [*own, "__cell"]).selectExpr(*own, "__v", "__begin + __upto - __n AS __low", "__begin + __upto AS __high", "__ranks")
    found = found.selectExpr(*own, "__v", "__low", "__high", hit("__low", "__high")).where("size(__ranks) > 0").selectExpr(*own, "__v", "__low", "__high", "explode(__ranks) AS r")
    at = lambda i, x: f"max(if(r.i = {i} AND {inside(f'r.{x}', '__low', '__high')}, __v, NULL))"
    q = ", ".join(f"{at(i, 'low')} + ({at(i, 'high')} - {at(i, 'low')}) * max(if(r.i = {i}, r.part, NULL))" for i in range(len(shares)))
    return found.groupBy(*own).agg(F.expr(f"array({q})").alias("q")).select(*[F.col(f"`{o}`.`{k}`").alias(k) for k, o in zip(keys, own, strict=True)], "q")


def event_spread(frame: DataFrame, kinds: Iterable[str] = tuple(EVENT_KINDS), size: int | None = None, kept: bool = False) -> DataFrame:
    """``kind``, ``a``, ``b``, ``q``: the quantiles of all asked kinds of an event frame, from one pass over it.

    ``size``: how many events there are at most, if that is known; ``kept``: the frame is persisted.
    """
    kinds = [k for k in kinds if k != "resource" or "resource" in frame.columns]
    text = lambda c: "CAST(NULL AS STRING)" if c is None else c
    measures = ", ".join(f"named_struct('kind', '{k}', 'a', {text(a)}, 'b', {text(b)}, 'v', {v})" for k, (v, a, b) in EVENT_KINDS.items() if k in kinds)
    long = frame.selectExpr(f"explode(array({measures})) AS x").selectExpr("x.*").where("v IS NOT NULL AND (a IS NOT NULL OR kind = 'log')")
    return quantiles(long, ["kind", "a", "b"], "v", size=None if size is None else size * len(kinds), kept=kept)


def of_kind(spread: DataFrame, kind: str, names: dict[str, float], a: str | None = None, b: str | None = None) -> DataFrame:
    """One kind of a spread with its group columns named ``a`` and ``b`` and its quantiles in hours by name."""
    keys = [F.col(k).alias(c) for k, c in (("a", a), ("b", b)) if c]
    return spread.where(F.col("kind") == kind).select(*keys, *[in_hours(F.col("q"), s).alias(n) for n, s in names.items()])


def in_hours(q: Column, share: float) -> Column:
    return micros(q, share) / F.lit(float(HOUR_US))


def micros(q: Column, share: float) -> Column:
    return F.get(q, F.lit(SHARES.index(share)))
