import pytest
from conftest import SF_SMALL

from pursewise import endpoints as EP
from pursewise.operators.filters import InvalidParams
from pursewise.sources.fixtures import view


def test_series_request_week_and_month(spark):
    sp = view(spark, SF_SMALL, "spending")
    w = EP.spending_series(sp, "1997-04-01", "1998-03-31", "Week", '{"filters": {"major": "11, 22"}}')
    m = EP.spending_series(sp, "1997-04-01", "1998-03-31", "Month", b"")
    assert "week" in w.columns and "month" in m.columns
    assert m.select("pos").distinct().count() == 12


def test_bad_requests_raise_before_spark(spark):
    sp = view(spark, SF_SMALL, "spending")
    with pytest.raises(InvalidParams):
        EP.spending_series(sp, "1997-04-01", "1998-03-31", "Year")
    with pytest.raises(InvalidParams):
        EP.spending_series(sp, "1997-04-01", "1998/03/31", "Week")
    with pytest.raises(InvalidParams):
        EP.allocation_week(view(spark, SF_SMALL, "allocation"), "1997-04-01", "1998-03-31", "{not json")


def test_heads_endpoints(spark):
    sp = view(spark, SF_SMALL, "spending")
    all_edges = EP.spending_heads_tree(sp).count()
    some = EP.spending_heads_tree(sp, {"district": "'NATION_3', 'NATION_8'"}).count()
    assert 0 < some < all_edges
    assert EP.unique_heads(view(spark, SF_SMALL, "allocation")).count() > 0


def test_every_route_has_a_function():
    import re

    doc = EP.__doc__
    for name in re.findall(r"-> (\w+)", doc):
        assert callable(getattr(EP, name)), name


def test_heads_combinations_export(spark):
    import os
    import tempfile

    from pursewise.sources.io import read_csv

    out = os.path.join(tempfile.mkdtemp(prefix="pw-heads-"), "heads")
    df = EP.heads_combinations(view(spark, SF_SMALL, "spending"), out)
    assert read_csv(spark, out, "combination string").count() == df.count() > 0
