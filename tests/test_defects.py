"""One test per defect of the reference that changes a result: the intended meaning."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from pursewise.operators import facts as FA
from pursewise.operators.heads import TREASURY_RECEIPT_LEVELS, heads_tree


def _facts(spark, rows):
    return spark.createDataFrame(
        [(d, dt.date.fromisoformat(t), Decimal(v)) for d, t, v in rows],
        "district string, transdate date, gross decimal(18,2)")


SPEC = FA.FactSpec("transdate", ("gross",), ("district",))


def _series(spark, rows, start, end, grain="week"):
    out = FA.series(_facts(spark, rows), SPEC, grain, start, end).orderBy("district", "pos").collect()
    return [(r["district"], r[grain], r["gross"]) for r in out]


def test_q4_year_end_fold_stays_in_its_district(spark):
    # 2019-12-29..2020-01-04 is one calendar week: 52 in 2019, 0 in 2020.
    rows = [("A", "2019-12-30", 5), ("A", "2020-01-02", 7), ("B", "2019-12-31", 100)]
    got = _series(spark, rows, "2019-12-20", "2020-01-10")
    assert got == [("A", 50, 0.0), ("A", 51, 0.0), ("A", 0, 12.0), ("A", 1, 0.0),
                   ("B", 50, 0.0), ("B", 51, 0.0), ("B", 0, 100.0), ("B", 1, 0.0)]


def test_q10_sum_equal_to_a_period_number_keeps_its_slot(spark):
    rows = [("A", "1998-05-04", 19)]  # a sum of 19 in week 18
    got = _series(spark, rows, "1998-05-01", "1998-05-29")
    assert [w for _, w, _ in got] == [17, 18, 19, 20, 21]
    assert [g for _, w, g in got if w == 18] == [19.0]


def test_q5_month_inside_one_month_sums_once(spark):
    rows = [("A", "1998-05-04", 3), ("A", "1998-05-20", 4)]
    assert _series(spark, rows, "1998-05-01", "1998-05-29", "month") == [("A", 5, 7.0)]


def test_q11_bare_week_merges_years_but_series_do_not(spark):
    rows = [("A", "1997-05-05", 1), ("A", "1998-05-04", 2)]
    sums = FA.period_sums(_facts(spark, rows), "transdate", ["gross"], "week", "1997-01-01", "1998-12-31",
                          by=("district",)).collect()
    assert [(r["week"], r["gross"]) for r in sums] == [(18, 3.0)]
    series = FA.series(_facts(spark, rows), SPEC, "week", "1997-01-01", "1998-12-31")
    assert series.filter(F.col("gross") > 0).count() == 2


def test_district_without_data_gets_no_series_and_no_payload_means_no_filter(spark):
    rows = [("A", "1998-05-04", 1)]
    got = FA.series(_facts(spark, rows), SPEC, "week", "1998-05-01", "1998-05-29", filters=None)
    assert {r["district"] for r in got.collect()} == {"A"}


def test_q8_treasury_receipt_tree_uses_sub_minor_code(spark):
    df = spark.createDataFrame(
        [("D", "T1", "Tr", "001", "ddo", "0020", "maj", "01", "101", "07", "desc")],
        "district string, treasury_code string, treasury string, ddo_code string, ddo_desc string, "
        "major_code string, major_desc string, sub_major_code string, minor_code string, "
        "sub_minor_code string, sub_minor_desc string")
    leaf = heads_tree(df, TREASURY_RECEIPT_LEVELS).filter(F.col("level") == 7).first()["label"]
    assert leaf == "07-desc"


def test_q6_schemes_week_and_month_both_work(spark):
    from conftest import SF_SMALL

    from pursewise import endpoints as EP
    from pursewise.sources.fixtures import view

    sch = view(spark, SF_SMALL, "schemes")
    w = EP.schemes_series(sch, "1997-04-01", "1998-03-31", "Week")
    m = EP.schemes_series(sch, "1997-04-01", "1998-03-31", "Month")
    # keyed by district (never overwritten by period), every district has every slot
    assert w.groupBy("district").count().select("count").distinct().collect()[0][0] == 53
    assert m.groupBy("district").count().select("count").distinct().collect()[0][0] == 12


def test_q9_start_day_is_included(spark):
    rows = [("A", "1998-05-01", 4), ("A", "1998-05-29", 6), ("A", "1998-05-30", 100)]
    sums = FA.period_sums(_facts(spark, rows), "transdate", ["gross"], "month", "1998-05-01", "1998-05-29",
                          by=("district",)).collect()
    assert [(r["month"], r["gross"]) for r in sums] == [(5, 10.0)]
