"""Plan shapes the design relies on (read from the executed plan, no timing)."""

import re

from conftest import SF_SMALL

from pursewise.registry import QUERIES


def _plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()  # run it, so the AQE plan is final
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(plan, table):
    return [line for line in plan.splitlines() if "FileScan" in line and f"/{table}.parquet" in line]


def test_series_reads_facts_once_with_date_bounds(spark):
    plan = _plan(spark, "spending_series_week")
    scans = _scans(plan, "lineitem")
    assert len(scans) == 1, scans
    assert "GreaterThanOrEqual(l_shipdate" in scans[0] and "LessThan(l_shipdate" in scans[0]
    assert "l_returnflag" not in scans[0] and "l_quantity" not in scans[0]  # pruned: unused by G-5
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unique_heads_is_one_pass(spark):
    plan = _plan(spark, "unique_heads_allocation")
    assert len(_scans(plan, "lineitem")) == 1


def test_every_query_is_free_of_cartesian_products(spark):
    for name in ("spending_series_month", "receipts_series_week", "keys_by_slots", "awards_with_tenders",
                 "heads_tree_spending", "treasury_counters"):
        plan = _plan(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_stored_dimensions_prune_partitions(spark):
    plan = _plan(spark, "head_dimensions_pruned")
    assert "PartitionFilters: [isnotnull(head" in plan or "PartitionFilters: [head" in plan, plan


def test_only_odd_pages_go_to_the_parser(spark):
    plan = _plan(spark, "html_table_rows")
    calls = re.findall(r"ArrowEvalPython \[(.{30})", plan)
    assert calls and all(c.startswith("_parsed_pages(CASE WHEN ") for c in calls), calls
    assert "MapInPandas" not in plan and "BatchEvalPython" not in plan


def test_partial_sums_before_any_exchange(spark):
    plan = _plan(spark, "spending_series_week")
    lines = plan.splitlines()
    partial = [i for i, l in enumerate(lines) if "partial_sum" in l]
    # the tree is printed root first: the partial aggregate sits below (after) an exchange line
    exchanges = [i for i, l in enumerate(lines) if "Exchange hashpartitioning(district" in l]
    assert partial and exchanges and min(exchanges) < max(partial)


def test_edge_distinct_hashes_on_the_whole_edge(spark):
    plan = _plan(spark, "heads_tree_codes")
    hashed = [l for l in plan.splitlines() if "Exchange hashpartitioning(level" in l]
    assert hashed and all("parent_id" in l and "label" in l and "path" not in l for l in hashed), hashed


def test_tree_document_reads_the_facts_once(spark):
    from pursewise.registry import QUERIES

    df = QUERIES["heads_tree_json_spending"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    scans = [l for l in final.splitlines() if "FileScan parquet" in l and "lineitem.parquet" in l]
    assert len(scans) == 1, final


def test_stored_fact_table_prunes_months_and_gives_the_same_series(spark, tmp_path):
    from pursewise.operators.facts import SPENDING, series
    from pursewise.sources.fixtures import view
    from dataclasses import replace

    from pursewise.operators.filters import MONTH_KEY
    from pursewise.sources.io import write_fact_table

    path = str(tmp_path / "spending")
    write_fact_table(view(spark, SF_SMALL, "spending"), path, "transdate")
    stored = spark.read.parquet(path)
    a = series(stored, replace(SPENDING, month_col=MONTH_KEY), "week", "1997-04-01", "1998-03-31")
    b = series(view(spark, SF_SMALL, "spending"), SPENDING, "week", "1997-04-01", "1998-03-31")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_key" in plan and "(month_key" in plan


def test_document_fragments_carry_a_number_and_no_row(spark):
    from pursewise.operators.shaping import columnar_json_fragments

    tenders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    df = columnar_json_fragments(tenders, tenders.columns, "o_custkey").orderBy("s1", "s2", "s3", "pos")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    sort = next(l for l in plan.splitlines() if "Sort [" in l)
    assert [n in sort for n in ("s1#", "s2#", "s3#", "pos#")] == [True] * 4 and sort.count("#") == 4
    assert [f.name for f in df.schema.fields] == ["s1", "s2", "s3", "pos", "fragment"]
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in final and "orders.parquet" not in final  # the numbered rows are read, the table is not sorted again
