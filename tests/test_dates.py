"""Week arithmetic: E-1 against %U for every day 2000-2039, and the slot rules."""

import datetime as dt

from pyspark.sql import functions as F

from pursewise.functions.dates import last_saturday, py_week0, week0, week_start
from pursewise.operators.periods import slot_count, slots


def test_week0_equals_percent_u_every_day(spark):
    start, end = dt.date(2000, 1, 1), dt.date(2039, 12, 31)
    df = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("d"))
    got = {r["d"]: (r["w"], r["s"], r["sat"]) for r in
           df.select("d", week0("d").alias("w"), week_start("d").alias("s"),
                     last_saturday("d").alias("sat")).collect()}
    assert len(got) == (end - start).days + 1
    for d, (w, s, sat) in got.items():
        assert w == int(d.strftime("%U")), d
        assert s.weekday() == 6 and 0 <= (d - s).days < 7, d
        assert sat.weekday() == 5 and 0 <= (d - sat).days < 7, d


def _labels(spark, start, end, grain="week"):
    return [r[grain] for r in slots(spark, start, end, grain).orderBy("pos").collect()]


def test_april_to_march_weeks(spark):
    # 13..51 then 0..13: week 52 of 2019 and week 0 of 2020 are one calendar week.
    assert _labels(spark, "2019-04-01", "2020-03-31") == list(range(13, 52)) + list(range(0, 14))


def test_december_range_is_not_a_year_end(spark):
    # Q-3: a range ending in December stays in its year.
    assert _labels(spark, "2019-12-01", "2019-12-31") == [48, 49, 50, 51, 52]


def test_range_ending_saturday_has_no_extra_week(spark):
    # Q-2: 1998-05-30 is a Saturday.
    assert _labels(spark, "1998-05-01", "1998-05-30") == [17, 18, 19, 20, 21]


def test_year_starting_friday(spark):
    # Q-1: 2021 starts on a Friday; the first days are week 0 and still get a slot.
    assert _labels(spark, "2021-01-01", "2021-01-20") == [0, 1, 2, 3]
    assert py_week0(dt.date(2021, 1, 1)) == 0


def test_month_slots_inside_one_month(spark):
    # Q-5: one slot, not thirteen.
    assert _labels(spark, "1998-05-01", "1998-05-29", "month") == [5]
    assert _labels(spark, "2019-04-01", "2020-03-31", "month") == list(range(4, 13)) + [1, 2, 3]
    assert slot_count("1998-05-01", "1998-05-29", "month") == 1


def test_slots_covering_data_and_empty_input(spark):
    from pursewise.operators.periods import slots_covering

    df = spark.createDataFrame([(dt.date(2019, 12, 30),), (dt.date(2020, 1, 14),)], "d date")
    got = [(r["pos"], str(r["slot_start"]), r["week"]) for r in
           slots_covering(df, "d", "week").orderBy("pos").collect()]
    assert got == [(0, "2019-12-29", 0), (1, "2020-01-05", 1), (2, "2020-01-12", 2)]
    assert slots_covering(df.filter("false"), "d", "month").count() == 0


def test_head_columns_by_name(spark):
    from pursewise.operators.heads import head_columns

    df = spark.createDataFrame([tuple("abcde")], "x string, demand string, major string, SOE string, after string")
    assert head_columns(df, until="soe", start=1) == ["demand", "major", "SOE"]
