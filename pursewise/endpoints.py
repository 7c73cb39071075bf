"""One function per request the reference serves, over DataFrames.

Each takes the table (a DataFrame) and the request's own parameters: ``start``/``end``
as ``%Y-%m-%d``, ``vis_range`` ``Week``/``Month``, and the JSON body
``{"filters": {column: "v1, v2"}}`` as text or a dict. Parameters are validated on the
driver (F-6) before any Spark work; results are lazy DataFrames. Nothing is collected:
write the result, or turn it into JSON lines with ``shaping.result_json``.

Routes of the reference and their functions here:

    exp_summary -> expenditure_summary        allocation_exp_summary -> allocation_summary
    detail_exp_week / _month -> allocation_week / allocation_month
    treasury_exp_week -> spending_week        treasury_exp, treasury_exp_temp -> spending_series
    treasury_rec -> treasury_receipts_series  schemes -> schemes_series
    detail_receipts_week / _month -> receipts_week / receipts_month
    acc_heads -> account_heads                acc_heads_test -> account_heads_tree
    acc_heads_desc -> account_heads_desc_tree acc_heads_receipts -> receipts_heads_tree
    acc_heads_treasury -> spending_heads_tree acc_heads_treasury_rec -> treasury_receipts_heads_tree
    acc_heads_schemes -> schemes_heads_tree   heads_temp -> heads_combinations
    unique_acc_heads -> unique_heads          unique_acc_heads_treasury -> unique_heads_stored
    unique_acc_heads_treasury_rec -> unique_heads_treasury_receipts
    unique_acc_heads_schemes -> unique_heads_schemes
    covid_summary -> covid_spending           procurement_tenders -> tenders
    procurement_awards -> awards
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame

from pursewise.operators import facts as FA
from pursewise.operators import heads as HE
from pursewise.operators import joins as JO
from pursewise.operators import shaping as SH
from pursewise.operators.filters import CLASS_COLUMN, InvalidParams, validate


def parse_payload(body: str | bytes | Mapping | None) -> Mapping:
    """E-15: the request body; empty or missing means no filters (Q-7, Q-7b)."""
    if body is None or body == "" or body == b"":
        return {}
    if isinstance(body, Mapping):
        return body
    try:
        out = json.loads(body)
    except ValueError as err:
        raise InvalidParams(f"body is not JSON: {err}") from err
    if not isinstance(out, Mapping):
        raise InvalidParams("body must be a JSON object")
    return out


def _grain(vis_range: str) -> str:
    validate("2000-01-01", "2000-01-01", vis_range, need_range=True)
    return vis_range.lower()


# ---------------------------------------------------------------- allocation, spending, receipts

def allocation_week(allocation: DataFrame, start: str, end: str, body=None) -> DataFrame:
    return FA.sums_of(allocation, FA.ALLOCATION, "week", start, end, parse_payload(body))


def allocation_month(allocation: DataFrame, start: str, end: str, body=None) -> DataFrame:
    return FA.sums_of(allocation, FA.ALLOCATION, "month", start, end, parse_payload(body))


def spending_week(spending: DataFrame, start: str, end: str, body=None) -> DataFrame:
    """Weekly spending without districts; each filter value is one quoted member (F-3)."""
    return FA.sums_of(spending, FA.SPENDING, "week", start, end, parse_payload(body), by=(),
                      single=True)


def spending_series(spending: DataFrame, start: str, end: str, vis_range: str, body=None) -> DataFrame:
    """Per district, every week or month of the range, zeros where nothing was spent."""
    return FA.series(spending, FA.SPENDING, _grain(vis_range), start, end, parse_payload(body))


def treasury_receipts_series(receipts: DataFrame, start: str, end: str, vis_range: str,
                             body=None) -> DataFrame:
    return FA.series(receipts, FA.TREASURY_RECEIPTS, _grain(vis_range), start, end,
                     parse_payload(body))


def schemes_series(schemes: DataFrame, start: str, end: str, vis_range: str, body=None) -> DataFrame:
    return FA.series(schemes, FA.SCHEMES, _grain(vis_range), start, end, parse_payload(body))


def receipts_week(receipts: DataFrame, start: str, end: str, body=None) -> DataFrame:
    return FA.series(receipts, FA.BUDGET_RECEIPTS, "week", start, end, parse_payload(body))


def receipts_month(receipts: DataFrame, start: str, end: str, body=None) -> DataFrame:
    return FA.series(receipts, FA.BUDGET_RECEIPTS, "month", start, end, parse_payload(body))


def record_count(result: DataFrame) -> DataFrame:
    return FA.record_count(result)


# ---------------------------------------------------------------- heads

def account_heads(allocation: DataFrame) -> DataFrame:
    return HE.heads_flat(allocation)


def account_heads_tree(allocation: DataFrame) -> DataFrame:
    return HE.heads_tree(allocation, HE.ALLOCATION_HEADS)


def account_heads_desc_tree(allocation: DataFrame) -> DataFrame:
    return HE.heads_tree(allocation, HE.ALLOCATION_DESC_LEVELS)


def receipts_heads_tree(receipts: DataFrame) -> DataFrame:
    return HE.heads_tree(receipts, HE.RECEIPT_LEVELS)


def spending_heads_tree(spending: DataFrame, params: Mapping | None = None) -> DataFrame:
    """Query-string parameters are IN filters (F-4); none means the whole table."""
    return HE.heads_tree(spending, HE.SPENDING_LEVELS, params or None)


def treasury_receipts_heads_tree(receipts: DataFrame, params: Mapping | None = None) -> DataFrame:
    return HE.heads_tree(receipts, HE.TREASURY_RECEIPT_LEVELS, params or None)


def schemes_heads_tree(schemes: DataFrame, params: Mapping | None = None) -> DataFrame:
    return HE.heads_tree(schemes, HE.SCHEME_LEVELS, params or None)


def unique_heads(allocation: DataFrame) -> DataFrame:
    return HE.unique_heads(allocation, HE.head_columns(allocation, until="soe"))


def unique_heads_treasury_receipts(receipts: DataFrame) -> DataFrame:
    return HE.unique_heads(receipts, HE.TREASURY_RECEIPT_UNIQUE)


def unique_heads_schemes(schemes: DataFrame) -> DataFrame:
    return HE.unique_heads(schemes, HE.SCHEME_UNIQUE)


def unique_heads_stored(spark, dimensions_path: str, heads=None) -> DataFrame:
    return HE.read_dimensions(spark, dimensions_path, heads or HE.DIMENSION_HEADS)


# ---------------------------------------------------------------- summaries, procurement

def expenditure_summary(summary: DataFrame) -> DataFrame:
    return SH.expenditure_summary(summary)


def allocation_summary(summary: DataFrame) -> DataFrame:
    return SH.allocation_by_year(summary)


def covid_spending(covid: DataFrame) -> DataFrame:
    return SH.covid_rows(covid)


def tenders(tenders_df: DataFrame, class_col: str = CLASS_COLUMN) -> DataFrame:
    return SH.tender_rows(tenders_df, class_col=class_col)


def awards(awards_df: DataFrame, tenders_df: DataFrame, class_col: str = CLASS_COLUMN) -> DataFrame:
    return JO.awards_with_tenders(awards_df, tenders_df, class_col=class_col)


def heads_combinations(spending: DataFrame, export_path: str | None = None) -> DataFrame:
    """Distinct head combinations (H-11); with ``export_path`` also written to CSV (S-8)."""
    out = HE.head_combinations(spending)
    if export_path:
        from pursewise.sources.io import export_heads

        export_heads(out, export_path)
    return out


# The temporary copy of the spending series route serves the same query.
spending_series_temp = spending_series
