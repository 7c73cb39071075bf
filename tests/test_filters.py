import pytest
from pyspark.sql import functions as F

from pursewise.operators.filters import (InvalidParams, apply_filters, parse_in_list,
                                         request_rejects, validate, validate_receipt_date)


def test_parse_in_list():
    q, b = parse_in_list("'0011', '0022'")
    assert q == ["0011", "0022"] and b == []
    q, b = parse_in_list("11, 22")
    assert q == [] and [int(x) for x in b] == [11, 22]
    q, b = parse_in_list("'a, b', 3, \"it''s\"")
    assert q == ["a, b", "it''s"] and [int(x) for x in b] == [3]
    with pytest.raises(InvalidParams):
        parse_in_list("1; drop table x")


def _codes(spark):
    return spark.createDataFrame([("0011",), ("0022",), ("11",), ("abc",), (None,)], "major string")


def test_quoted_members_compare_as_text(spark):
    out = apply_filters(_codes(spark), {"filters": {"major": "'0011', '0022'"}})
    assert sorted(r[0] for r in out.collect()) == ["0011", "0022"]


def test_bare_members_compare_as_numbers_without_raising(spark):
    # '0011' and '11' both equal the number 11; 'abc' is not a number and must not raise.
    out = apply_filters(_codes(spark), {"filters": {"MAJOR": "11"}})
    assert sorted(r[0] for r in out.collect()) == ["0011", "11"]


def test_single_member_form(spark):
    df = spark.createDataFrame([("a, b",), ("a",)], "v string")
    assert [r[0] for r in apply_filters(df, {"filters": {"v": "a, b"}}, single=True).collect()] == ["a, b"]


def test_no_payload_is_no_filter(spark):
    # Q-7 / Q-7b: no body and an empty filter map both leave the rows alone.
    df = _codes(spark)
    assert apply_filters(df, None).count() == 5
    assert apply_filters(df, {"filters": {}}).count() == 5


def test_unknown_column_rejected(spark):
    with pytest.raises(InvalidParams):
        apply_filters(_codes(spark), {"filters": {"major; drop": "1"}})


def test_validate():
    assert str(validate("2019-04-01", "2020-03-31")[0]) == "2019-04-01"
    for bad in [(None, "2020-01-01"), ("2019-13-01", "2020-01-01")]:
        with pytest.raises(InvalidParams):
            validate(*bad)
    with pytest.raises(InvalidParams):
        validate("2019-01-01", "2019-02-01", "Year", need_range=True)
    assert validate_receipt_date("01/04/2019x") == "01/04/2019x"  # prefix match
    with pytest.raises(InvalidParams):
        validate_receipt_date("2019-04-01")


def test_request_table_rejects(spark):
    df = spark.createDataFrame([("2019-04-01", "2019-05-01", "Week"), ("2019-04-01", None, "Week"),
                                ("2019-4-x", "2019-05-01", "Month"), ("2019-04-01", "2019-05-01", "Year")],
                               "start string, end string, range string")
    got = [r["reject"] for r in request_rejects(df).collect()]
    assert got[0] is None and got[1] and got[2] and got[3] == "invalid range"


def test_quoted_members_on_numeric_column_do_not_raise(spark):
    df = spark.createDataFrame([(1,), (2,), (11,)], "n int")
    assert sorted(r[0] for r in apply_filters(df, {"filters": {"n": "'1', 'abc'"}}).collect()) == [1]
    assert sorted(r[0] for r in apply_filters(df, {"filters": {"n": "11, 2"}}).collect()) == [2, 11]


def test_date_range_on_timestamps_keeps_the_whole_end_day(spark):
    import datetime as dt

    from pursewise.operators.filters import date_range

    df = spark.createDataFrame([(dt.datetime(2019, 4, 30, 18, 0),), (dt.datetime(2019, 5, 1, 0, 0),)],
                               "ts timestamp_ntz")
    assert date_range(df, "ts", "2019-04-01", "2019-04-30").count() == 1
    plan = date_range(df.sparkSession.read.parquet("/root/testdata/sf0.001/lineitem.parquet"),
                      "l_shipdate", "1997-04-01", "1998-03-31")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan
