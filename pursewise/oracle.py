"""DuckDB SQL builders for the correctness check.

These write each query a second, independent way, in plain SQL, over the same parquet
views: ``strftime('%U')`` for weeks, ``generate_series`` for slots, a cross join of keys
and slots for the fill. They are the oracle, not the implementation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pursewise.functions.dates import parse_day
from pursewise.operators.facts import FactSpec
from pursewise.operators.filters import filters_of, parse_in_list
from pursewise.operators.periods import slot_bounds
from pursewise.sources.fixtures import oracle_with


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_filters(filters: Mapping | None, single: bool = False) -> str:
    out = []
    for key, value in filters_of(filters).items():
        if single:
            out.append(f"{key} = {q(str(value))}")
            continue
        quoted, bare = parse_in_list(str(value))
        parts = []
        if quoted:
            parts.append(f"{key} in ({', '.join(q(v) for v in quoted)})")
        if bare:
            parts.append(f"try_cast({key} as decimal(38,10)) in ({', '.join(str(b) for b in bare)})")
        out.append("(" + " or ".join(parts or ["false"]) + ")")
    return "".join(f" and {p}" for p in out)


def sql_date(d) -> str:
    return f"date '{parse_day(d).isoformat()}'"


def sql_week0(expr: str) -> str:
    return f"cast(strftime({expr}, '%U') as int)"


def sql_sums(view: str, spec: FactSpec, grain: str, start, end,
             filters: Mapping | None = None, single: bool = False,
             by: Sequence[str] | None = None) -> str:
    keys = list(spec.by if by is None else by)
    d = spec.date_col
    period = sql_week0(d) if grain == "week" else f"cast(month({d}) as int)"
    sums = ", ".join(f"cast(sum({m}) as double) as {m}" for m in spec.measures)
    sel = ", ".join([*keys, f"{period} as {grain}", sums])
    grp = ", ".join([*keys, period])
    return oracle_with(
        f"select {sel} from {view} where {d} between {sql_date(start)} and {sql_date(end)}"
        f"{sql_filters(filters, single)} group by {grp}",
        view,
    )


def sql_series(view: str, spec: FactSpec, grain: str, start, end,
               filters: Mapping | None = None, by: Sequence[str] | None = None) -> str:
    keys = list(spec.by if by is None else by)
    d = spec.date_col
    a, b = slot_bounds(start, end, grain)
    if grain == "week":
        slot = f"{d} - cast(dayofweek({d}) as int)"
        step = "interval 7 day"
        label = sql_week0(f"least(sl.slot_start + 6, {sql_date(end)})")
    else:
        slot = f"cast(date_trunc('month', {d}) as date)"
        step = "interval 1 month"
        label = "cast(month(sl.slot_start) as int)"
    ms = spec.measures
    key_sel = "".join(f"{k}, " for k in keys)
    body = f"""with f as (
  select {key_sel}{slot} as slot_start, {', '.join(ms)} from {view}
  where {d} between {sql_date(start)} and {sql_date(end)}{sql_filters(filters)}),
agg as (select {key_sel}slot_start, {', '.join(f'sum({m}) as {m}' for m in ms)}
  from f group by {key_sel}slot_start),
sl as (select cast(row_number() over (order by s) - 1 as int) as pos, cast(s as date) as slot_start
  from generate_series({sql_date(a)}, {sql_date(b)}, {step}) t(s))
select {''.join(f'k.{k}, ' for k in keys)}sl.pos, sl.slot_start, {label} as {grain},
  {', '.join(f'cast(coalesce(a.{m}, 0) as double) as {m}' for m in ms)}
"""
    if keys:
        on = " and ".join([*(f"a.{k} = k.{k}" for k in keys), "a.slot_start = sl.slot_start"])
        body += (f"from (select distinct {', '.join(keys)} from agg) k cross join sl "
                 f"left join agg a on {on}")
    else:
        body += "from sl left join agg a on a.slot_start = sl.slot_start"
    return oracle_with(body, view)
