import os
import tempfile
import time

from pyspark.sql import functions as F

from pursewise.sources import io as IO
from pursewise.sources import manifest
from pursewise.streaming.ingest import ingest


def _tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="pw-io-"), name)


def test_blank_cell_survives_csv_round_trip(spark):
    df = spark.createDataFrame([("k", " ", "a,b", 'say "x"')], "key string, a string, b string, c string")
    path = _tmp("ds")
    IO.write_datasets(df, path, ("key",))
    back = IO.read_csv(spark, path, "a string, b string, c string, key string").first()
    assert (back["a"], back["b"], back["c"]) == (" ", "a,b", 'say "x"')


def test_dynamic_overwrite_keeps_other_datasets(spark):
    path = _tmp("ds")
    IO.write_datasets(spark.createDataFrame([("k1", "1"), ("k2", "2")], "key string, v string"), path, ("key",))
    IO.write_datasets(spark.createDataFrame([("k1", "9")], "key string, v string"), path, ("key",))
    got = sorted(tuple(r) for r in IO.read_csv(spark, path, "v string, key string").collect())
    assert got == [("2", "k2"), ("9", "k1")]


def test_latest_snapshot_by_file_time(spark):
    path = _tmp("ddo")
    for day, codes in (("2020-01-01", ["1", "2", "3"]), ("2020-01-02", ["1", "2"])):
        df = spark.createDataFrame([("T1", day, c, "n" + c) for c in codes],
                                   "treasury_code string, snapshot_date string, `DDO Code` string, `DDO Name` string")
        IO.write_snapshot(df.withColumn("snapshot_date", F.to_date("snapshot_date")), path)
        time.sleep(1.1)
    read = IO.ddo_codes(spark, path)
    latest = IO.latest_snapshot(read)  # by file time
    assert sorted(r["DDO Code"] for r in latest.collect()) == ["1", "2"]


def test_snapshot_of_several_part_files(spark):
    path = _tmp("ddo")
    codes = spark.range(8).select(F.lit("T1").alias("treasury_code"), F.col("id").cast("string").alias("DDO Code"),
                                  F.lit("n").alias("DDO Name"))
    IO.write_snapshot(codes, path)  # the day of the run
    day = os.listdir(f"{path}/treasury_code=T1")
    assert [d for d in day if d == time.strftime("snapshot_date=%Y-%m-%d")] == day
    more = codes.repartition(4).write.mode("append").options(**IO.CSV_OPTIONS)
    more.csv(f"{path}/treasury_code=T1/{day[0]}")
    assert IO.latest_snapshot(IO.ddo_codes(spark, path)).count() == 16


def test_ingest_takes_each_file_once(spark):
    root = tempfile.mkdtemp(prefix="pw-ingest-")
    drops, out, ckpt = f"{root}/in", f"{root}/out", f"{root}/ck"
    os.makedirs(drops)
    schema = "a string, b int"
    with open(f"{drops}/one.csv", "w") as f:
        f.write("a,b\nx,1\ny,2\n")
    ingest(spark, drops, out, ckpt, schema)
    ingest(spark, drops, out, ckpt, schema)  # nothing new: nothing added
    with open(f"{drops}/two.csv", "w") as f:
        f.write("a,b\nz,3\n")
    old = time.time() - 400 * 86_400  # a copy that kept its time
    os.utime(f"{drops}/two.csv", (old, old))
    ingest(spark, drops, out, ckpt, schema)
    got = sorted((r["a"], r["b"], r["source_file"]) for r in spark.read.parquet(out).collect())
    assert got == [("x", 1, "one.csv"), ("y", 2, "one.csv"), ("z", 3, "two.csv")]


def test_ingest_replaces_a_dataset_collected_again(spark):
    root = tempfile.mkdtemp(prefix="pw-again-")
    drops, out, ckpt = f"{root}/in", f"{root}/out", f"{root}/ck"
    for values in ([("d1", 1), ("d1", 2), ("d2", 9)], [("d1", 1), ("d1", 3)]):
        IO.write_datasets(spark.createDataFrame(values, "dataset string, v int"), drops, ("dataset",))
        ingest(spark, drops, out, ckpt, "v int, dataset string")
    got = sorted((r["dataset"], r["v"]) for r in spark.read.parquet(out).collect())
    assert got == [("d1", 1), ("d1", 3), ("d2", 9)]


def test_missing_against_collected_files(spark):
    from pursewise.plans import requests as PL

    root = tempfile.mkdtemp(prefix="pw-files-")
    os.makedirs(f"{root}/receipts")
    header = ",".join(IO.RECEIPTS_HEADER) + "\n"
    with open(f"{root}/receipts/budget_receipts_01_04_2019.csv", "w") as f:
        f.write(header + "0020-00-101-01 [x],01/04/2019,12.50\n")
    with open(f"{root}/receipts/budget_receipts_02_04_2019.csv", "w") as f:
        f.write(header)  # header only: must be collected again (Q-14)
    open(f"{root}/receipts/budget_receipts_03_04_2019.csv", "w").close()  # empty
    plan = spark.createDataFrame([(f"0{d}/04/2019",) for d in range(1, 6)], "date string").select(
        "date", PL.budget_path("budget_receipts", F.col("date")).alias("path"))
    IO.write_collected(plan.where("date = '05/04/2019'"), root)  # written by S-5
    todo = PL.missing(plan, IO.collected_datasets(spark, root))
    assert sorted(r["date"] for r in todo.collect()) == ["02/04/2019", "03/04/2019", "04/04/2019"]


def test_database_reader_checks_partitions(spark):
    import pytest

    with pytest.raises(ValueError):
        IO.read_database_table(spark, "jdbc:none://x", "t", "id", 0, 10, 0)


def test_empty_null_and_blank_survive_csv(spark):
    df = spark.createDataFrame([("k", "", None, " ")], "key string, e string, n string, b string")
    path = _tmp("csv")
    IO.write_datasets(df, path, ("key",))
    back = IO.read_csv(spark, path, "e string, n string, b string, key string").first()
    assert (back["e"], back["n"], back["b"]) == ("", None, " ")


def _dropped(spark, root, values, emptied=(), glob="*.csv"):
    """Write the datasets of ``values`` and header-only ones, then run one catch-up pass."""
    if values:
        IO.write_datasets(spark.createDataFrame(values, "dataset string, v int"), f"{root}/in", ("dataset",))
    for name in emptied:
        folder = f"{root}/in/dataset={name}"
        for f in os.listdir(folder):
            os.remove(f"{folder}/{f}")
        with open(f"{folder}/again.csv", "w") as f:
            f.write("v\n")
    ingest(spark, f"{root}/in", f"{root}/out", f"{root}/ck", "v int, dataset string")
    return sorted((r["dataset"], r["v"]) for r in spark.read.parquet(f"{root}/out").collect())


def test_a_dataset_collected_again_without_rows_is_empty(spark):
    import shutil

    root = tempfile.mkdtemp(prefix="pw-empty-")
    start = [("a", 1), ("a", 2), ("b b/%", 3), ("c", 4), ("d", 5)]
    assert _dropped(spark, root, start) == start
    assert _dropped(spark, root, [("e", 6)], emptied=("a",)) == [*start[2:], ("e", 6)]
    shutil.rmtree(f"{root}/in/dataset=c")  # taken away
    assert _dropped(spark, root, []) == [("b b/%", 3), ("d", 5), ("e", 6)]
    name = next(f for f in os.listdir(f"{root}/in/dataset=d") if f.endswith(".csv"))
    crc = f"{root}/in/dataset=d/.{name}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    with open(f"{root}/in/dataset=d/{name}", "w") as f:  # overwritten in place, under its name
        f.write("v\n50\n51\n")
    assert _dropped(spark, root, []) == [("b b/%", 3), ("d", 50), ("d", 51), ("e", 6)]
    assert _dropped(spark, root, [("a", 9)]) == [("a", 9), ("b b/%", 3), ("d", 50), ("d", 51), ("e", 6)]
    known = manifest.entries(spark, f"{root}/out").collect()
    counts = {}
    for r in known:
        counts[r["dataset"]] = counts.get(r["dataset"], 0) + r["n_rows"]
    assert counts == {"a": 1, "b b/%": 1, "c": 0, "d": 2, "e": 1}
    assert all(r["removed"] for r in known if r["dataset"] == "c")
    version = max(r["version"] for r in known)
    assert _dropped(spark, root, []) and max(r["version"] for r in manifest.entries(spark, f"{root}/out").collect()) == version


def test_ingest_reads_only_touched_datasets(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="pw-touched-")
    _dropped(spark, root, [("a", 1), ("b", 2)])
    read = []
    plain = manifest.as_globs
    monkeypatch.setattr(manifest, "as_globs", lambda paths: read.extend(paths) or plain(paths))
    _dropped(spark, root, [("b", 3), ("b", 4)])
    assert read and all("/dataset=b/" in p for p in read)


def test_planning_reads_the_manifest_only(spark):
    root = tempfile.mkdtemp(prefix="pw-plan-")
    df = spark.createDataFrame([("x/a.csv", "1"), ("x/a.csv", "two\nlines"), ("x/b+ %.csv", "2")], "path string, v string")
    IO.write_collected(df, root)
    got = IO.collected_datasets(spark, root)
    assert sorted(tuple(r) for r in got.collect()) == [("x/a.csv", 2), ("x/b+ %.csv", 1)]
    assert got.inputFiles() and all(f"/{manifest.FOLDER}/" in f for f in got.inputFiles())
    IO.write_collected(spark.createDataFrame([("x/a.csv", "3")], "path string, v string"), root)
    os.makedirs(f"{root}/receipts")
    with open(f"{root}/receipts/[odd] {{name}}.csv", "w") as f:
        f.write("v\n1\n2\n3\n")
    again = {r["path"]: r["n_rows"] for r in IO.collected_datasets(spark, root).collect()}
    assert again == {"x/a.csv": 1, "x/b+ %.csv": 1, "receipts/[odd] {name}.csv": 3}
    os.remove(f"{root}/receipts/[odd] {{name}}.csv")
    assert "receipts/[odd] {name}.csv" not in {r["path"] for r in IO.collected_datasets(spark, root).collect()}


def test_many_small_datasets_are_written_by_many_tasks(spark):
    """The bytes of small datasets make one task; creating their files is the work (F4)."""
    rows = spark.range(1200).select((F.col("id") % 30).cast("string").alias("ddo"), (F.col("id") % 300).cast("string").alias("period"), "id")
    path = _tmp("many")
    IO.write_datasets(rows, path, ("ddo", "period"))
    back = IO.read_csv(spark, path, "id long, ddo string, period string")
    files = back.groupBy("ddo", "period").agg(F.collect_set("_metadata.file_name").alias("f"), F.count(F.lit(1)).alias("n"))
    files = files.collect()
    assert len(files) == 300 and all(len(r["f"]) == 1 and r["n"] == 4 for r in files)
    assert len({f.split("-")[1] for r in files for f in r["f"]}) > 3
    assert sorted(r["id"] for r in back.collect()) == list(range(1200))


def test_large_datasets_are_shared_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(IO, "ROWS_AT_ONCE", 100)
    key = F.when(F.col("id") < 1000, F.lit("big")).when(F.col("id") < 1010, F.lit(None)).otherwise(F.col("id").cast("string"))
    rows = spark.range(1050).select(F.lit("g").alias("group"), key.alias("key"), "id")
    path = _tmp("large")
    IO.write_datasets(rows, path, ("group", "key"))
    files = [os.listdir(f"{path}/group=g/{d}") for d in os.listdir(f"{path}/group=g")]
    assert len(files) == 42
    assert sorted(len([f for f in fs if f.endswith(".csv")]) for fs in files)[-2:] != [1, 1]
    back = IO.read_csv(spark, path, "id long, group string, key string")
    assert sorted(r["id"] for r in back.collect()) == list(range(1050))


def test_many_folders_are_listed_by_few_tasks(spark):
    root = tempfile.mkdtemp(prefix="pw-listing-")
    sc, key = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    most, was = 4 * sc.defaultParallelism, spark.conf.get(key)
    values = [(f"d{i:04d}", i) for i in range(most + 40)]
    sc.setJobGroup(root, "ingest")
    try:
        assert _dropped(spark, root, values) == values
        sc.setJobGroup(f"{root}-pass", "ingest")
        ingest(spark, f"{root}/in", f"{root}/out", f"{root}/ck", "v int, dataset string")
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(f"{root}-pass")]
    finally:
        sc._jsc.sc().clearJobGroup()
    stages = [sc.statusTracker().getStageInfo(s) for j in jobs if j for s in j.stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= most
    assert spark.conf.get(key) == was


def _odd_datasets(spark):
    keys = ["a", "a/b", "a%2Fb", "a b", "x=1", "", None, "é:?*[]{}'\"\\^#", "tab\there", "+"]
    texts = ["plain", "", " ", None, 'a "quoted", one', "two\nlines", "\\N", "x,y", "back\\slash", " lead and trail "]
    rows = [(g, k, n, texts[(n + i) % len(texts)], texts[n]) for i, k in enumerate(keys) for g in ("g1", "g 2") for n in range(len(texts))]
    return spark.createDataFrame(rows, "group string, key string, `n o` int, t string, `u,v` string")


def _texts(root):
    return {os.path.relpath(d, root): sorted(open(f"{d}/{f}", encoding="utf-8", newline="").read() for f in names if f.startswith("part-"))
            for d, _, names in os.walk(root) if any(f.startswith("part-") for f in names)}


def test_datasets_by_file_calls_are_those_of_sparks_writer(spark):
    """Same folders and same text as Spark's writer makes, without its file of check sums beside each."""
    root = tempfile.mkdtemp()
    df = _odd_datasets(spark).repartition(1).sortWithinPartitions("group", "key", "n o")
    IO.write_datasets(df, f"{root}/here", ("group", "key"))
    (df.where("key is null or key <> ''").write.options(**IO.CSV_OPTIONS).partitionBy("group", "key").csv(f"{root}/spark"))
    def rows(found):
        return {k: sorted("".join(v).split("\n")) for k, v in found.items() if "HIVE" not in k}
    assert rows(_texts(f"{root}/here")) == rows(_texts(f"{root}/spark"))
    assert set(_texts(f"{root}/here")) == set(_texts(f"{root}/spark"))
    assert not [f for _, _, names in os.walk(f"{root}/here") for f in names if f.endswith(".crc")]
    assert not [f for f in os.listdir(f"{root}/here") if f.startswith(".")]  # nothing is left of the staging


def test_datasets_read_back_by_file_names(spark):
    root = tempfile.mkdtemp()
    df = _odd_datasets(spark)
    schema = "group string, key string, `n o` int, t string, `u,v` string"
    IO.write_datasets(df, root, ("group", "key"))
    IO.write_datasets(df.where("group = 'g1' and key = 'a'").withColumn("t", F.lit("new")), root, ("group", "key"))
    got, want = IO.read_datasets(spark, root, schema, ("group", "key")), IO.read_csv(spark, root, schema)
    assert got.columns == want.columns == ["n o", "t", "u,v", "group", "key"]
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, want.collect())) and len(rows) >= df.count()
    assert {(r["group"], r["key"]) for r in got.collect()} == {(r["group"], r["key"] or None) for r in df.collect()}
    assert {r["t"] for r in got.where("group = 'g1' and key = 'a' and t is not null").collect()} == {"new"}
    days = spark.createDataFrame([(1, "2024-02-01")], "v int, day string")
    IO.write_datasets(days, f"{root}-days", ("day",))
    assert IO.read_datasets(spark, f"{root}-days", "v int, day date", ("day",)).first()["day"].isoformat() == "2024-02-01"


def test_reading_many_datasets_infers_no_folders(spark):
    """Spark's reading of keys from folders takes time with the square of their number."""
    root = tempfile.mkdtemp()
    IO.write_datasets(spark.range(6).selectExpr("id % 2 as g", "id as k", "id as v"), root, ("g", "k"))
    df = IO.read_datasets(spark, root, "g int, k int, v int", ("g", "k"))
    scan = df._jdf.queryExecution().optimizedPlan().collectLeaves().head()
    assert scan.relation().location().partitionSchema().isEmpty()
    assert sorted(map(tuple, df.select("g", "k", "v").collect())) == [(i % 2, i, i) for i in (0, 2, 4)] + [(1, i, i) for i in (1, 3, 5)]


def _ingested(spark, values):
    root = tempfile.mkdtemp()
    IO.write_datasets(spark.createDataFrame(values, "dataset string, v int"), f"{root}/in", ("dataset",))
    ingest(spark, f"{root}/in", f"{root}/out", f"{root}/ck", "v int, dataset string")
    got = spark.read.schema("v int, dataset string").parquet(f"{root}/out").select("dataset", "v").collect()
    assert sorted(map(tuple, got)) == sorted(values)
    return [f"{d}/{f}" for d, _, names in os.walk(f"{root}/out") for f in names if "dataset=" in d and f.startswith("part-")]


def test_many_small_datasets_of_a_batch_are_written_by_many_tasks(spark, monkeypatch):
    """One file a dataset, made by a few tasks a core and not by the one task that their bytes ask for;
    a dataset of very many rows is shared by several."""
    import pursewise.streaming.ingest as module

    values = [(f"d{i}", i) for i in range(80)]
    files = _ingested(spark, values)
    assert len(files) == 80
    assert len({os.path.basename(f).split("-")[1] for f in files}) >= min(4, spark.sparkContext.defaultParallelism)
    monkeypatch.setattr(IO, "ROWS_AT_ONCE", 50)
    monkeypatch.setattr(module, "ROWS_AT_ONCE", 50)
    files = _ingested(spark, [("hot", i) for i in range(400)] + values[:5])
    assert len([f for f in files if "dataset=hot" in f]) > 1
    assert len(files) - len([f for f in files if "dataset=hot" in f]) == 5
