"""Period slots (G-1, G-2) and the slot key of a fact date.

A week slot is keyed by the Sunday that starts it, so the partial last week of one year
and week 0 of the next are the same slot (G-4 falls out of the grouping). Its label is
``week0`` of the slot's Saturday, or of the range end when that comes first. A month slot
is keyed by the first day of the month.

The slot list of a request is an array expression built from two literal dates; its
length is fixed by the request (about 52 per year of range), never by the data.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pursewise.functions.dates import month_num, parse_day, py_week_start, week0, week_start

GRAINS = ("week", "month")


def _grain(grain: str) -> str:
    g = grain.lower()
    if g not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")
    return g


def slot_of(date_col: str | Column, grain: str) -> Column:
    """Slot key of a fact date."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    return week_start(d) if _grain(grain) == "week" else F.trunc(d, "MM")


def slot_bounds(start, end, grain: str) -> tuple[_dt.date, _dt.date]:
    s, e = parse_day(start), parse_day(end)
    if _grain(grain) == "week":
        return py_week_start(s), py_week_start(e)
    return s.replace(day=1), e.replace(day=1)


def slot_count(start, end, grain: str) -> int:
    """Number of slots a request covers (known on the driver, before any job)."""
    a, b = slot_bounds(start, end, grain)
    if b < a:
        return 0
    if _grain(grain) == "week":
        return (b - a).days // 7 + 1
    return (b.year - a.year) * 12 + b.month - a.month + 1


def slot_array(start, end, grain: str) -> Column:
    """The ordered slot keys of a request as an ``array<date>`` literal expression."""
    a, b = slot_bounds(start, end, grain)
    if b < a:
        return F.array().cast("array<date>")
    step = F.expr("interval 7 days") if _grain(grain) == "week" else F.expr("interval 1 month")
    return F.sequence(F.lit(a), F.lit(b), step)


def slot_label(slot: Column, end, grain: str) -> Column:
    """Week number (E-1) of the slot's last day inside the range, or the month number."""
    if _grain(grain) == "week":
        return week0(F.least(F.date_add(slot, 6), F.lit(parse_day(end))))
    return month_num(slot)


def slots(spark: SparkSession, start, end, grain: str) -> DataFrame:
    """G-1 / G-2: (pos, slot_start, label) for a request; a parameter table of bounded size."""
    g = _grain(grain)
    return (
        spark.range(1)
        .select(F.posexplode(slot_array(start, end, g)).alias("pos", "slot_start"))
        .select(F.col("pos").cast("int").alias("pos"), "slot_start",
                slot_label(F.col("slot_start"), end, g).alias(g))
    )


def slots_covering(df: DataFrame, date_col: str, grain: str) -> DataFrame:
    """G-1 / G-2 over the data: the slots from a table's first to its last date.

    The bounds are one partial ``min``/``max`` aggregate; the slot list is generated
    from them on an executor (its length is set by the date span, not the row count).
    """
    g = _grain(grain)
    d = F.col(date_col)
    bounds = df.agg(F.min(d).alias("_s"), F.max(d).alias("_e"))
    first = week_start(F.col("_s")) if g == "week" else F.trunc(F.col("_s"), "MM")
    last = week_start(F.col("_e")) if g == "week" else F.trunc(F.col("_e"), "MM")
    step = F.expr("interval 7 days") if g == "week" else F.expr("interval 1 month")
    grid = bounds.filter(F.col("_s").isNotNull()).select(
        "_e", F.posexplode(F.sequence(first, last, step)).alias("pos", "slot_start"))
    label = (week0(F.least(F.date_add(F.col("slot_start"), 6), F.col("_e"))) if g == "week"
             else month_num(F.col("slot_start")))
    return grid.select(F.col("pos").cast("int").alias("pos"), "slot_start", label.alias(g))
