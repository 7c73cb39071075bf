"""Representative tables built from the driver's TPC-H-like parquet (S-1 and views).

Each view is one SQL text with ``{table}`` placeholders. Spark binds the placeholders to
DataFrames (``spark.sql(text, **frames)``); the DuckDB oracle formats them with the view
names it already has. One definition therefore feeds both engines.

Nothing here is collected: every view is a lazy plan over the parquet scans, so the
optimizer prunes columns and pushes date filters down to ``lineitem``/``orders``.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from pursewise.operators.shaping import TENDER_COLUMNS

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# The view definitions that give each reference table its shape.
VIEW_SQL: dict[str, str] = {
    "spending": """
select n_name as district,
  concat('T', lpad(cast(r_regionkey as string), 2, '0')) as treasury_code, r_name as treasury,
  lpad(cast(s_suppkey as string), 4, '0') as ddo_code, s_name as ddo_desc,
  lpad(cast(p_size as string), 2, '0') as demand, p_type as demand_desc,
  lpad(regexp_extract(p_brand, '[0-9]+', 0), 4, '0') as major, p_brand as major_desc,
  lpad(cast(l_linenumber as string), 2, '0') as sub_major, concat('line ', cast(l_linenumber as string)) as sub_major_desc,
  l_returnflag as minor, concat('flag ', l_returnflag) as minor_desc,
  l_linestatus as sub_minor, concat('status ', l_linestatus) as sub_minor_desc,
  case when l_quantity > 25 then 'HIGH' else 'LOW' end as budget,
  o_orderstatus as voted_charged,
  case when l_discount > 0.05 then 'P' else 'N' end as plan_nonplan,
  substr(o_orderpriority, 1, 1) as soe, substr(o_orderpriority, 3) as soe_description,
  cast(l_shipdate as date) as transdate,
  cast(l_extendedprice as decimal(18,2)) as gross,
  cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)) as agded,
  cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) as btded,
  cast(l_extendedprice as decimal(18,2)) * (cast(1 as decimal(4,2)) - cast(l_discount as decimal(4,2)) - cast(l_tax as decimal(4,2))) as netpayment
from {lineitem}
join {orders} on l_orderkey = o_orderkey
join {part} on l_partkey = p_partkey
join {supplier} on l_suppkey = s_suppkey
join {nation} on s_nationkey = n_nationkey
join {region} on n_regionkey = r_regionkey
""",
    "allocation": """
select lpad(cast(p_size as string), 2, '0') as demand, p_type as demand_desc,
  lpad(regexp_extract(p_brand, '[0-9]+', 0), 4, '0') as major, p_brand as major_desc,
  lpad(cast(l_linenumber as string), 2, '0') as sub_major, concat('line ', cast(l_linenumber as string)) as sub_major_desc,
  l_returnflag as minor, concat('flag ', l_returnflag) as minor_desc,
  l_linestatus as sub_minor, concat('status ', l_linestatus) as sub_minor_desc,
  case when l_quantity > 25 then 'HIGH' else 'LOW' end as budget,
  case when l_tax > 0.04 then 'V' else 'C' end as voted_charged,
  case when l_discount > 0.05 then 'P' else 'N' end as plan_nonplan,
  lpad(cast(l_linenumber as string), 2, '0') as soe, concat('object ', cast(l_linenumber as string)) as soe_description,
  cast(l_shipdate as date) as date,
  cast(l_extendedprice as decimal(18,2)) as sanction,
  cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) as addition,
  cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)) as saving,
  cast(l_extendedprice as decimal(18,2)) * (cast(1 as decimal(4,2)) + cast(l_tax as decimal(4,2)) - cast(l_discount as decimal(4,2))) as revised
from {lineitem} join {part} on l_partkey = p_partkey
""",
    "budget_receipts": """
select lpad(cast(c_nationkey as string), 4, '0') as major, c_mktsegment as major_desc,
  o_orderstatus as sub_major, substr(o_orderpriority, 1, 1) as minor,
  lpad(cast(c_custkey % 10 as string), 2, '0') as sub_minor, substr(o_orderpriority, 3) as sub_minor_desc,
  cast(o_orderdate as date) as date, cast(o_totalprice as decimal(18,2)) as total_receipt
from {orders} join {customer} on o_custkey = c_custkey
""",
    "treasury_receipts": """
select n_name as district, concat('T', lpad(cast(r_regionkey as string), 2, '0')) as treasury_code, r_name as treasury,
  lpad(cast(c_custkey as string), 6, '0') as ddo_code, c_name as ddo_desc,
  lpad(cast(c_nationkey as string), 4, '0') as major_code, c_mktsegment as major_desc,
  o_orderstatus as sub_major_code, substr(o_orderpriority, 1, 1) as minor_code,
  lpad(cast(c_custkey % 10 as string), 2, '0') as sub_minor_code, substr(o_orderpriority, 3) as sub_minor_desc,
  cast(o_orderdate as date) as bookdate, cast(o_totalprice as decimal(18,2)) as netreceipt
from {orders} join {customer} on o_custkey = c_custkey
join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
""",
    "schemes": """
select p_type as schemes, l_returnflag as type, n_name as district,
  concat('T', lpad(cast(r_regionkey as string), 2, '0')) as treasury_code, r_name as treasury,
  lpad(cast(s_suppkey as string), 4, '0') as ddo_code, s_name as ddo_desc,
  lpad(cast(p_size as string), 2, '0') as demand, concat('size ', cast(p_size as string)) as demand_desc,
  lpad(regexp_extract(p_brand, '[0-9]+', 0), 4, '0') as major, p_brand as major_desc,
  lpad(cast(l_linenumber as string), 2, '0') as sub_major, concat('line ', cast(l_linenumber as string)) as sub_major_desc,
  l_returnflag as minor, concat('flag ', l_returnflag) as minor_desc,
  l_linestatus as sub_minor, concat('status ', l_linestatus) as sub_minor_desc,
  case when l_quantity > 25 then 'HIGH' else 'LOW' end as budget,
  case when l_tax > 0.04 then 'V' else 'C' end as voted_charged,
  case when l_discount > 0.05 then 'P' else 'N' end as plan_nonplan,
  lpad(cast(l_linenumber as string), 2, '0') as soe, concat('object ', cast(l_linenumber as string)) as soe_description,
  cast(l_shipdate as date) as transdate,
  cast(l_extendedprice as decimal(18,2)) as gross,
  cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)) as agded,
  cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) as btded,
  cast(l_extendedprice as decimal(18,2)) * (cast(1 as decimal(4,2)) - cast(l_discount as decimal(4,2)) - cast(l_tax as decimal(4,2))) as netpayment
from {lineitem} join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey
join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
""",
    "exp_summary": """
select lpad(cast(p_size as string), 2, '0') as demand, concat('size ', cast(p_size as string)) as demand_description,
  sum(case when year(l_shipdate) = 1997 then cast(l_extendedprice as decimal(18,2)) else cast(0 as decimal(18,2)) end) as sanction_previous,
  sum(case when year(l_shipdate) = 1998 then cast(l_extendedprice as decimal(18,2)) else cast(0 as decimal(18,2)) end) as sanction_current
from {lineitem} join {part} on l_partkey = p_partkey group by p_size
""",
    "allocation_summary": """
select concat(cast(fy as string), '-', cast(fy + 1 as string)) as financial_year,
  lpad(cast(p_size as string), 2, '0') as demand, concat('size ', cast(p_size as string)) as demand_description,
  sum(cast(l_extendedprice as decimal(18,2))) as sanction,
  sum(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2))) as addition
from (select l_partkey, l_extendedprice, l_tax,
        case when month(l_shipdate) >= 4 then year(l_shipdate) else year(l_shipdate) - 1 end as fy from {lineitem}) l
join {part} on l_partkey = p_partkey group by fy, p_size
""",
    "covid": """
select c_mktsegment as department, cast(o_totalprice as decimal(18,2)) as funds_sanctioned,
  o_orderstatus as funds_sanctioned_from, cast(o_orderdate as date) as date, o_orderpriority as purpose,
  o_orderkey as row_id
from {orders} join {customer} on o_custkey = c_custkey
""",
}


def _tender_column(i: int, name: str) -> str:
    """An expression for each published column: the keys and amounts the operators use, dates
    and amounts by the end of the name, otherwise text with some nulls."""
    known = {
        "ocid": "cast(o_orderkey as string)",
        "id": "concat('tender-', cast(o_orderkey as string), '-', cast(lot as string))",
        "date": "cast(o_orderdate as date)",
        "tender/value/amount": "cast(o_totalprice as decimal(18,2))",
        "buyer/name": "c_name",
        "tender/classification/id": "case when o_orderpriority = '4-NOT SPECIFIED' then '' "
                                    "when o_orderpriority = '5-LOW' then null else substr(o_orderpriority, 1, 1) end",
    }
    if name in known:
        return known[name]
    if name.endswith("value/amount"):
        return f"cast(case when o_orderkey % {i + 2} = 0 then null else o_totalprice end as decimal(18,2))"
    if name.endswith("Date") or name.endswith("/date") or name.endswith("datePublished"):
        return f"case when o_orderkey % {i + 2} = 0 then null else cast(o_orderdate as date) end"
    return f"case when o_orderkey % {i + 2} = 0 then null else concat('{i}/', o_orderstatus) end"


# Every tenth tender comes in two lots: two rows with one ocid.
VIEW_SQL["tenders"] = (
    "select concat('u-', cast(o_orderkey as string), '-', cast(lot as string)) as uuid,\n  "
    + ",\n  ".join(f"{_tender_column(i, c)} as `{c}`" for i, c in enumerate(TENDER_COLUMNS))
    + "\nfrom (select *, 1 as lot from {orders} union all select *, 2 as lot from {orders} where o_orderkey % 10 = 0) o\n"
      "join {customer} on o_custkey = c_custkey")

VIEW_SQL["awards"] = """
select concat('a-', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as uuid,
  cast(case when l_linenumber = 7 then l_orderkey + 100000000 else l_orderkey end as string) as ocid,
  concat('award-', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_suppkey as string)) as id,
  cast(l_shipdate as date) as date, case when l_linenumber = 1 then 'buyer' else 'supplier' end as `parties/0/roles`,
  cast(l_linenumber as string) as `awards/0/id`, cast(l_suppkey as string) as `awards/0/suppliers/0/id`,
  cast(s_nationkey as string) as `parties/0/id`, concat('desk ', l_returnflag) as `parties/0/contactPoint/name`,
  s_name as `awards/0/suppliers/0/name`, 'INR' as `awards/0/value/currency`,
  cast(l_extendedprice as decimal(18,2)) as `awards/0/value/amount`
from {lineitem} join {supplier} on l_suppkey = s_suppkey
"""

_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> dict[str, DataFrame]:
    """S-1: bind the base tables of a directory, lazily (no rows are read here)."""
    return {n: spark.read.parquet(table_path(sf_dir, n)) for n in names}


@lru_cache(maxsize=None)
def _view_inputs(name: str) -> tuple[str, ...]:
    return tuple(sorted(set(_PLACEHOLDER.findall(VIEW_SQL[name]))))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One representative table as a lazy DataFrame over the base parquet files."""
    frames = load_tables(spark, sf_dir, _view_inputs(name))
    return spark.sql(VIEW_SQL[name], **frames)


def oracle_view_sql(name: str) -> str:
    """The same view for DuckDB, where the base tables are registered by name and quoted
    names stand in double quotes."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), VIEW_SQL[name]).replace("`", '"')


def oracle_with(sql: str, *views: str) -> str:
    """Prefix ``sql`` with CTEs for the named views (DuckDB side of the check)."""
    ctes = ",\n".join(f"{v} as ({oracle_view_sql(v)})" for v in views)
    body = sql.strip()
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
