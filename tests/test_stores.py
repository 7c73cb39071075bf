"""Stored layouts: clustered facts, bucketed procurement tables, dimensions kept up by loads."""

import glob

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from pursewise.operators import heads as HE
from pursewise.operators.filters import apply_filters
from pursewise.operators.joins import awards_with_tenders
from pursewise.sources import stores as ST
from pursewise.sources.fixtures import view

HEADS = ("major", "district")


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "spending")
    ST.write_clustered(view(spark, SF_SMALL, "spending"), path, HEADS, files=128)
    return path


@pytest.mark.parametrize("column", ["major", "district"])
def test_in_filter_skips_row_groups_of_the_clustered_table(spark, clustered, column, tmp_path):
    stored = spark.read.parquet(clustered)
    total = stored.count()
    value = stored.groupBy(column).count().orderBy(F.desc("count")).first()[column]
    payload = {"filters": {column: f"'{value}'"}}
    df = apply_filters(stored, payload)
    rows = df.collect()
    scanned = ST.rows_scanned(df)
    assert len(rows) <= scanned < total / 3, (len(rows), scanned, total)
    plain = str(tmp_path / "plain")  # as many files, rows as they come
    view(spark, SF_SMALL, "spending").repartition(128).write.parquet(plain)
    unclustered = apply_filters(spark.read.parquet(plain), payload)
    unclustered.collect()
    assert 2 * scanned < ST.rows_scanned(unclustered)
    want = apply_filters(view(spark, SF_SMALL, "spending"), payload)
    assert sorted(map(str, rows)) == sorted(map(str, want.select(*stored.columns).collect()))


def test_absent_value_reads_no_row(spark, clustered):
    df = apply_filters(spark.read.parquet(clustered), {"filters": {"major": "'no such code'"}})
    assert df.collect() == [] and ST.rows_scanned(df) == 0


def test_clustered_table_holds_every_row_with_nulls_empty_and_extra_columns(spark, tmp_path):
    rows = [(None, "a", 1, 1), ("", "a", 2, 1), ("x", None, 3, 1), ("x", "é", 4, 1), ("x", "a", 5, 1)] * 3
    df = spark.createDataFrame(rows, "major string, district string, z int, h int")  # names of the helper columns
    for n, part in enumerate((df, df.where("false"))):
        ST.write_clustered(part, str(tmp_path / f"t{n}"), ("major", "district"), files=3)
        got = spark.read.schema(df.schema).parquet(str(tmp_path / f"t{n}")).collect()
        assert sorted(map(str, got)) == sorted(map(str, part.collect()))
    with pytest.raises(ValueError):
        ST.write_clustered(df, str(tmp_path / "no"), ())


def test_ranks_follow_the_order_of_the_values(spark):
    df = spark.createDataFrame([(f"NATION_{i:02d}",) for i in range(64)] * 2, "d string")
    bounds = ST.cluster_bounds(df, ["d"])
    assert bounds["d"][0] == len("NATION_") and len(bounds["d"][1]) == 15
    keys = [r["z"] for r in df.select("d", ST.cluster_key(bounds).alias("z")).orderBy("d").collect()]
    assert keys == sorted(keys) and set(keys) == set(range(16))


def _procurement(spark):
    awards = [("hot", i) for i in range(300)] + [(None, i) for i in range(200)] + [(f"o{i}", i) for i in range(100)]
    tenders = [("hot", "c1"), ("hot", "c2"), ("hot", ""), (None, "c"), ("o3", "c"), ("o3", "c"), ("o4", None), ("x", "c")]
    return (spark.createDataFrame(awards, "ocid string, id int"),
            spark.createDataFrame(tenders, "ocid string, `tender/classification/id` string"))


def test_bucketed_join_has_no_exchange_and_the_same_rows(spark, tmp_path):
    awards, tenders = _procurement(spark)
    names = ST.store_awards_and_tenders(awards, tenders, str(tmp_path), 4)
    df = ST.stored_awards_with_tenders(spark, *names, award_columns=("ocid", "id"))
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(map(tuple, awards_with_tenders(awards, tenders, ("ocid", "id")).collect())) and len(got) == 602
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    stored = spark.table(names[0])
    assert stored.count() == 600 and stored.where("ocid = 'hot'").select(ST.SLICE).distinct().count() > 1
    hot = [r["count"] for r in stored.where("ocid = 'hot'").groupBy(F.input_file_name()).count().collect()]
    assert len(hot) > 1 and max(hot) < 200  # no bucket holds the hot key whole


def test_bucketed_join_of_the_given_tables(spark, tmp_path):
    awards, tenders = view(spark, SF_SMALL, "awards"), view(spark, SF_SMALL, "tenders")
    df = ST.stored_awards_with_tenders(spark, *ST.store_awards_and_tenders(awards, tenders, str(tmp_path), 8))
    assert sorted(map(str, df.collect())) == sorted(map(str, awards_with_tenders(awards, tenders).collect()))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_second_load_writes_only_unseen_values(spark, tmp_path):
    heads, path = ("a", "b"), str(tmp_path / "dims")
    first = spark.createDataFrame([("1", "x"), ("1", None), ("2", "x")], "a string, b string")
    second = spark.createDataFrame([("2", None), ("3", "x"), (None, "x"), ("3", "")], "a string, b string")
    HE.build_dimensions(first, path, heads)
    before = set(glob.glob(f"{path}/*/*.parquet"))
    HE.load_dimensions(second, path, heads)
    new = set(glob.glob(f"{path}/*/*.parquet")) - before
    written = spark.read.option("basePath", path).parquet(*sorted(new))
    assert {tuple(r) for r in written.select("head", "value").collect()} == {("a", "3"), ("a", None), ("b", "")}
    assert written.count() == 3
    HE.load_dimensions(second, path, heads)  # the same load again, after a failure for example
    assert set(glob.glob(f"{path}/*/*.parquet")) - before == new
    rebuilt = str(tmp_path / "rebuilt")
    HE.build_dimensions(first.unionByName(second), rebuilt, heads)
    assert sorted(map(str, HE.read_dimensions(spark, path).collect())) == sorted(map(str, HE.read_dimensions(spark, rebuilt).collect()))


def test_clustering_works_the_rows_out_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    df = spark.range(200).select("id", F.udf(seen, "string")(F.col("id").cast("string")).alias("major"))
    ST.write_clustered(df, str(tmp_path / "t"), ("major",))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == list(range(200))
    assert made.value == 200
