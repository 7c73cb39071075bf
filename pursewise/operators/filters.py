"""Filters and predicates (F-1 .. F-6).

IN lists arrive as text (``"'0011', '0022'"`` or ``"11, 22"``). They are parsed on the
driver into literal members and turned into ``isin`` predicates; nothing is ever spliced
into SQL text. Quoted members compare as text; bare members compare as numbers against a
``try_cast`` of the column (a text code ``'0011'`` equals the number ``11``), which never
raises under ANSI mode.
"""

from __future__ import annotations

import datetime as _dt
import re
from collections.abc import Mapping
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursewise.functions.dates import parse_day, try_as_date
from pursewise.functions.text import DAY_PATTERN, matches_day_pattern

_MEMBER = re.compile(
    r"""\s*(?:'((?:[^']|'')*)'|"((?:[^"]|"")*)"|([^,]*?))\s*(?:,|$)"""
)

# The accepted ranges.
VIS_RANGES = ("Week", "Month")


class InvalidParams(ValueError):
    """Raised on the driver for a request that must not reach Spark."""


def parse_in_list(text: str) -> tuple[list[str], list[Decimal]]:
    """Split an IN-list text into (quoted text members, bare numeric members)."""
    quoted: list[str] = []
    bare: list[Decimal] = []
    pos = 0
    text = text.strip()
    while pos < len(text):
        m = _MEMBER.match(text, pos)
        if m is None or m.end() == pos:
            raise InvalidParams(f"cannot parse IN list: {text!r}")
        pos = m.end()
        if m.group(1) is not None:
            quoted.append(m.group(1).replace("''", "'"))
        elif m.group(2) is not None:
            quoted.append(m.group(2).replace('""', '"'))
        else:
            token = m.group(3).strip()
            if token == "":
                continue
            try:
                bare.append(Decimal(token))
            except InvalidOperation as err:
                raise InvalidParams(f"not a number or quoted text: {token!r}") from err
    return quoted, bare


def _resolve(df: DataFrame, key: str) -> str:
    lowered = {c.lower(): c for c in df.columns}
    if key.lower() not in lowered:
        raise InvalidParams(f"unknown column in filters: {key!r}")
    return lowered[key.lower()]


def in_predicate(col: Column, text: str) -> Column:
    """F-2 for one key: ``col IN (members)`` with MySQL-like mixed comparison."""
    quoted, bare = parse_in_list(text)
    preds = []
    if quoted:
        # compared as text, so a quoted member never forces a cast of the column (ANSI)
        preds.append(col.cast("string").isin(quoted))
    if bare:
        preds.append(col.try_cast("decimal(38,10)").isin([F.lit(b).cast("decimal(38,10)") for b in bare]))
    if not preds:
        return F.lit(False)
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return out


def filters_of(payload: Mapping | None) -> Mapping[str, str]:
    """Accept ``{"filters": {...}}``, a bare mapping, or nothing (Q-7: no payload = no filter)."""
    if not payload:
        return {}
    if "filters" in payload and isinstance(payload["filters"], Mapping):
        return payload["filters"]
    return payload


def apply_filters(df: DataFrame, payload: Mapping | None, single: bool = False) -> DataFrame:
    """F-2 / F-3 / F-4: AND of one IN filter per key.

    ``single=True`` is the weekly-spending form (F-3): the whole value is one quoted member.
    """
    for key, value in filters_of(payload).items():
        name = _resolve(df, key)
        if single:
            df = df.filter(F.col(name).cast("string") == F.lit(str(value)))
        else:
            df = df.filter(in_predicate(F.col(name), str(value)))
    return df


# Partition column of stored fact tables: year * 100 + month of the date column.
MONTH_KEY = "month_key"


def month_key(d: Column) -> Column:
    return (F.year(d) * 100 + F.month(d)).cast("int")


def date_range(df: DataFrame, col: str, start, end, month_col: str | None = None) -> DataFrame:
    """F-1: both ends included, compared as dates (Q-9).

    A timestamp column is compared through ``cast(col as date)``, so the whole end day
    counts; the optimizer still turns that into bounds on the column at the scan. For a
    table stored by ``io.write_fact_table`` name its month column (``MONTH_KEY``): the same
    range on it prunes the scan to the months' folders.
    """
    s, e = parse_day(start), parse_day(end)
    c = F.col(col)
    if df.schema[col].dataType.typeName() in ("timestamp", "timestamp_ntz"):
        c = c.cast("date")
    out = df.filter(c.between(F.lit(s), F.lit(e)))
    if month_col is not None:
        out = out.filter(F.col(month_col).between(s.year * 100 + s.month, e.year * 100 + e.month))
    return out


# Fixed value: the column that holds a tender's class.
CLASS_COLUMN = "tender/classification/id"


def classified(df: DataFrame, col: str = CLASS_COLUMN) -> DataFrame:
    """F-5: ``col != ''`` drops empty and null alike."""
    return df.filter(F.col(f"`{col}`") != F.lit(""))


def validate(start=None, end=None, vis_range: str | None = None,
             need_range: bool = False) -> tuple[_dt.date, _dt.date]:
    """F-6 on the driver: start/end required as ``%Y-%m-%d``; range ``Week`` or ``Month``."""
    if start is None or end is None:
        raise InvalidParams("start and end date is required")
    try:
        s, e = parse_day(start), parse_day(end)
    except ValueError as err:
        raise InvalidParams(str(err)) from err
    if need_range and vis_range not in VIS_RANGES:
        raise InvalidParams("please specify correct vis range (Week, Month)")
    return s, e


def validate_receipt_date(text: str | None) -> str:
    """F-6 for the receipts crawl date: ``dd/mm/yyyy`` matched at the start (like re.match)."""
    if not text or re.match(DAY_PATTERN, text) is None:
        raise InvalidParams("Wrong date format, please use dd/mm/yyyy!")
    return text


def receipt_date_rejects(requests: DataFrame, date: str = "date") -> DataFrame:
    """F-6 / E-13 for a table of receipt requests: adds ``reject`` unless the date starts with
    ``dd/mm/yyyy``."""
    ok = F.coalesce(matches_day_pattern(date), F.lit(False))
    return requests.withColumn("reject", F.when(~ok, F.lit("invalid date")))


def request_rejects(requests: DataFrame, start: str = "start", end: str = "end",
                    vis_range: str | None = "range") -> DataFrame:
    """F-6 for a table of requests: adds ``reject`` (null when the request is valid)."""
    # one or two digits of month and day, like the driver form
    s, e = try_as_date(start, "yyyy-M-d"), try_as_date(end, "yyyy-M-d")
    reason = (
        F.when(F.col(start).isNull() | F.col(end).isNull(), F.lit("start and end date is required"))
        .when(s.isNull() | e.isNull() | ~F.col(start).rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")
              | ~F.col(end).rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.lit("invalid date"))
    )
    if vis_range is not None:
        reason = reason.when(~F.coalesce(F.col(vis_range).isin(list(VIS_RANGES)), F.lit(False)),
                             F.lit("invalid range"))
    return requests.withColumn("reject", reason)
