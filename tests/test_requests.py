from urllib.parse import urlencode

from pyspark.sql import functions as F

from pursewise.plans import requests as PL


def test_request_url_matches_urlencode(spark):
    vals = ("20190401", "20190430", "010", "T01-0007", "Report / all * ~x & y, z")
    df = spark.createDataFrame([vals], "a string, b string, c string, d string, e string")
    url = PL.request_url(df, "http://h/p.asp", list(zip(PL.TREASURY_PARAMS, "abcde"))).first()["url"]
    assert url == "http://h/p.asp?" + urlencode(dict(zip(PL.TREASURY_PARAMS, vals)))


def test_dataset_paths(spark):
    cases = {
        ("Shimla, Urban / North", "0007"): "expenditures/treasury_expenditures_Shimla_Urban___North_0007_20190401-20190430.csv",
        ("Una", "0100"): "expenditures/treasury_expenditures_Una_0100_20190401-20190430.csv",
        (",,a,,b", "1"): "expenditures/treasury_expenditures_ab_1_20190401-20190430.csv",
    }
    df = spark.createDataFrame([(*k, "20190401", "20190430") for k in cases],
                               "treasury_name string, ddo_code string, start string, end string")
    got = PL.dataset_path(df, "treasury_expenditures").collect()
    assert {(r.treasury_name, r.ddo_code): r.path for r in got} == cases


def test_missing_goes_by_data_rows(spark):
    plan = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    files = spark.createDataFrame([("a", 0), ("c", 5)], "path string, n_rows long")
    assert sorted(r[0] for r in PL.missing(plan, files).collect()) == ["a", "b", "d"]


def test_plan_without_the_query_option_is_empty(spark):
    t = spark.createDataFrame([("T1", "One")], "treasury_id string, treasury_name string")
    d = spark.createDataFrame([("T1", "07")], "treasury_code string, ddo_code string")
    q = spark.createDataFrame([("010", "Report")], "query_id string, query_name string")
    assert PL.plan_treasury_requests(t, d, q, "20190401", "20190430").first()["hod_code"] == "T1-07"
    assert PL.plan_treasury_requests(t, d, q.where("false"), "20190401", "20190430").count() == 0


def test_receipt_requests_name_their_unit(spark):
    days = spark.createDataFrame([("01/04/2019",)], "date string")
    got = PL.plan_receipt_requests(days, unit="lakhs").collect()
    assert [(r.public_head_bool, r.major_code, r.unit) for r in got] == [("0", "0000", "2"), ("1", "0000", "2")]


def test_scale_is_exact(spark):
    df = spark.createDataFrame([("x",)], "k string").select(F.lit(123456.78).cast("decimal(18,2)").alias("v"))
    from decimal import Decimal

    assert PL.scale(df, ["v"], "lakhs").first()["v"] == Decimal("1.2345678")
    assert PL.scale(df, ["v"], "2").first()["v"] == Decimal("1.2345678")  # by receipt index
    assert PL.scale(df, ["v"], "thousands").first()["v"] == Decimal("123.45678")
