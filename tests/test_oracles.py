"""Every registered query against its DuckDB oracle (the driver's check, locally)."""

import pytest
from conftest import SF_SMALL

from harness import compare, duck
from pursewise.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    r = compare(spark, name, SF_SMALL, con)
    assert r["status"] == "match", r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0


def test_every_query_has_stable_schema(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["district", "pos", "slot_start", "week", "gross", "agded", "btded", "netpayment"]
    assert df.count() > 0
    assert set(e.queries()) >= set(e.oracle_sql())
