"""Planning which datasets to collect (P-1 .. P-7), as set operations.

The reference decides one request at a time inside its crawler. Here the plan is a
table: treasuries joined to their latest DDO snapshot, anti-joined with the files already
collected. Whatever captures the responses works through the plan; a re-run plans only
what is still missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursewise.functions.text import file_part, url_encode

# Request parameter names in the order the site expects them.
TREASURY_PARAMS = ("from_date", "To_date", "ddlquery", "HODCode", "Str")
BUDGET_PARAMS = ("from_date", "To_date", "ddlquery", "HODCode", "Str", "Unit")
# Amount units: expenditure factors (rupees, thousands, lakhs) and receipt unit indexes.
EXPENDITURE_UNITS = {"rupees": "1", "thousands": ".001", "lakhs": ".00001"}
RECEIPT_UNITS = {"rupees": "0", "thousands": "1", "lakhs": "2"}
ALL_MAJORS = "0000"


def plan_treasury_requests(treasuries: DataFrame, ddos: DataFrame, query: DataFrame,
                           start: str, end: str, treasury_key: str = "treasury_id",
                           ddo_treasury_key: str = "treasury_code", ddo_col: str = "ddo_code") -> DataFrame:
    """P-1: one request per (treasury, DDO of its latest snapshot) for the range and query.

    ``treasuries`` has (treasury_id, treasury_name); ``ddos`` (treasury_code, ddo_code);
    ``query`` is the one row (query_id, query_name) of the option asked for (X-7): without
    it there is nothing to plan. The equi-join is planned by size (broadcast under the
    threshold, else shuffled).
    """
    d = ddos.select(F.col(ddo_treasury_key).alias(treasury_key), F.col(ddo_col).alias("ddo_code"))
    plan = treasuries.select(treasury_key, "treasury_name").join(d, treasury_key)
    plan = plan.join(F.broadcast(_one_query(query)), F.lit(True))
    return plan.select(
        F.lit(start).alias("start"), F.lit(end).alias("end"), "query_id", "query_name",
        treasury_key, "treasury_name", "ddo_code",
        F.concat_ws("-", F.col(treasury_key), F.col("ddo_code")).alias("hod_code"))


def _one_query(query: DataFrame) -> DataFrame:
    """The query option as one row at most (a form offers one option at an index)."""
    one = query.agg(F.min(F.struct("query_id", "query_name")).alias("q")).where("q is not null")
    return one.select("q.query_id", "q.query_name")


def plan_budget_request(departments: DataFrame, query: DataFrame, date: str, unit: str) -> DataFrame:
    """P-2: one request for the first department (position 0) with start = end = date."""
    first = departments.filter(F.col("position") == 0).join(F.broadcast(_one_query(query)), F.lit(True))
    return first.select(
        F.lit(date).alias("date"), "query_id", "query_name", F.col("value").alias("hod_name"),
        F.lit(unit).alias("unit"))


def plan_receipt_requests(dates: DataFrame, major_codes: DataFrame | None = None,
                          date_col: str = "date", unit: str = "rupees") -> DataFrame:
    """P-3: step 1 asks every day for all majors (``0000``) under both head kinds; step 2
    asks once per major code found in a step-1 response, keeping its head kind. Each request
    names its unit by index (P-7)."""
    unit_index = F.lit(RECEIPT_UNITS[unit]).alias("unit")
    first = dates.select(F.col(date_col).alias("date")).distinct().select(
        F.lit(1).alias("step"), F.explode(F.array(F.lit("0"), F.lit("1"))).alias("public_head_bool"),
        "date", F.lit(ALL_MAJORS).alias("major_code"), unit_index)
    if major_codes is None:
        return first
    second = major_codes.select(F.lit(2).alias("step"), "public_head_bool", "date", "major_code", unit_index)
    return first.unionByName(second)


def dataset_file_name(parts: Sequence[Column]) -> Column:
    """P-4 / E-10: ``a_b_c_d.csv`` with commas removed and blanks/slashes as ``_``."""
    return file_part(F.concat(F.concat_ws("_", *parts), F.lit(".csv")))


def dataset_path(plan: DataFrame, crawl_name: str) -> DataFrame:
    """P-4: ``<kind>/<crawl>_<treasury>_<ddo>_<start>-<end>.csv``; kind is the crawl
    name's last ``_`` part (``expenditures`` or ``receipts``)."""
    kind = crawl_name.split("_")[-1]
    name = dataset_file_name([F.lit(crawl_name), F.col("treasury_name"), F.col("ddo_code"),
                              F.concat_ws("-", F.col("start"), F.col("end"))])
    return plan.withColumn("path", F.concat(F.lit(kind + "/"), name))


def budget_path(crawl_name: str, date: Column) -> Column:
    """P-4 for budget crawls: ``<kind>/<crawl>_<date>.csv`` (slashes of a date as ``_``)."""
    kind = crawl_name.split("_")[-1]
    return F.concat(F.lit(kind + "/"), dataset_file_name([F.lit(crawl_name), date]))


def missing(plan: DataFrame, collected: DataFrame, path_col: str = "path") -> DataFrame:
    """P-5: planned datasets that are not collected yet.

    ``collected`` has (path, n_rows), as ``io.collected_datasets`` lists it. A dataset counts
    when it has a data row: empty and header-only files are collected again (Q-14).
    """
    done = collected.filter(F.col("n_rows") > 0).select(F.col("path").alias(path_col))
    return plan.join(done, path_col, "left_anti")


def request_url(plan: DataFrame, base: str, params: Sequence[tuple[str, str]]) -> DataFrame:
    """P-6: ``base?k=v&...`` in the given key order, form-encoded like ``urlencode``.

    ``params`` pairs a request key with the plan column that holds its value.
    """
    pairs = [F.concat(F.lit(k + "="), url_encode(F.col(c).cast("string"))) for k, c in params]
    return plan.withColumn("url", F.concat(F.lit(base + "?"), F.concat_ws("&", *pairs)))


def budget_request_url(plan: DataFrame, base: str) -> DataFrame:
    """P-6 for the budget crawl: start and end are the one date, and the unit is named."""
    return request_url(plan, base, list(zip(
        BUDGET_PARAMS, ("date", "date", "query_id", "hod_name", "query_name", "unit"))))


def scale(df: DataFrame, cols: Sequence[str], unit: str) -> DataFrame:
    """P-7: amounts in rupees, thousands or lakhs, by name, factor or receipt index ('0', '1',
    '2'); exact decimal factor."""
    names = {index: name for name, index in RECEIPT_UNITS.items()}
    factor = Decimal(EXPENDITURE_UNITS.get(names.get(unit, unit), unit))
    digits, exponent = factor.as_tuple().digits, factor.as_tuple().exponent
    sc = max(0, -exponent)
    lit = F.lit(str(factor)).cast(f"decimal({max(len(digits), sc) + 1},{sc})")
    return df.select(*[(F.col(c) * lit).alias(c) if c in cols else F.col(c) for c in df.columns])


def requests_to_make(treasuries: DataFrame, ddos: DataFrame, collected: DataFrame, query: DataFrame,
                     start: str, end: str, crawl_name: str, base_url: str) -> DataFrame:
    """One run of a treasury crawl, as a plan: P-1 (requests), P-4 (their file paths),
    P-5 (drop those already collected) and P-6 (the URL of each remaining request)."""
    plan = plan_treasury_requests(treasuries, ddos, query, start, end)
    todo = missing(dataset_path(plan, crawl_name), collected)
    return request_url(todo, base_url, list(zip(
        TREASURY_PARAMS, ("start", "end", "query_id", "hod_code", "query_name"))))
