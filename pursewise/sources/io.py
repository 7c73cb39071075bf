"""Sources and sinks (S-3 .. S-8; S-1 is ``fixtures.load_tables``, S-10 is in ``streaming``).

Files are written by Spark's partitioned writers, never through one shared handle:
one directory per dataset key, overwritten per partition (dynamic overwrite), header
row included. Blank cells survive a CSV round trip only with the whitespace options off
on both sides, so writer and reader here always set them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pursewise.functions.dates import today_text
from pursewise.sources import localfiles, manifest

# CSV headers the collected files carry.
DDO_HEADER = ("DDO Code", "DDO Name")
RECEIPTS_HEADER = ("Maj-Smj-Min-Smn [Sub Minor Head]", "date", "Total Receipt")

# Null is written as \N (the MySQL convention), so an empty field always means '' and
# both survive a round trip; blank cells need the two whitespace options off.
CSV_OPTIONS = {
    "header": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "escape": '"',
    "nullValue": "\\N",
}


def _writer(df: DataFrame, partition_cols: Sequence[str]):
    """Partitioned CSV writer. The ``rebalance`` hint on the dataset key gives one file per
    dataset (as the crawler's one file per dataset) while AQE still splits a key that
    holds a large share of the rows over several tasks and files."""
    if partition_cols:
        df = df.hint("rebalance", *partition_cols)
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**CSV_OPTIONS)
    return w.partitionBy(*partition_cols) if partition_cols else w


#: Folders one task writes: a small file costs its creation, not its bytes, by which AQE sizes tasks.
FOLDERS_AT_ONCE = 64
#: Rows of one dataset or folder of datasets above which several tasks share it.
ROWS_AT_ONCE = 500_000


def spread(df: DataFrame, keys: Sequence[str], folders: int, shares: DataFrame | None = None) -> DataFrame:
    """``df`` dealt over tasks of about FOLDERS_AT_ONCE datasets each, however few bytes they hold.

    A dataset goes to one task whole, and the datasets that differ in the last key only stay
    together, so a commit moves whole folders. ``shares`` (the keys as ``_k0``, ``_k1``, ..., then ``_apart``,
    ``_shares``) lists the exceptions: datasets to be dealt on their own (``_apart``) and, of those,
    the ones whose rows go to ``_shares`` tasks.
    """
    least = min(folders, 2 * df.sparkSession.sparkContext.defaultParallelism)
    tasks = max(1, least, -(-folders // FOLDERS_AT_ONCE))
    group = [F.col(f"`{k}`") for k in (keys[:-1] or keys)]
    if shares is None:
        return df.repartition(tasks, *group)
    columns = [F.col(f"`{c}`") for c in df.columns]
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    deal = F.when(F.col("_apart"), F.struct(F.xxhash64(F.col(f"`{keys[-1]}`")).alias("key"), F.when(
        F.col("_shares") > 1, F.pmod(F.monotonically_increasing_id(), F.col("_shares"))).alias("share")))
    dealt = df.join(F.broadcast(shares), same, "left").select(*columns, deal.alias("_deal"))
    return dealt.repartition(tasks, *group, "_deal").drop("_deal")


def dataset_shares(df: DataFrame, keys: Sequence[str]) -> tuple[int, DataFrame | None]:
    """The number of datasets, and the ``shares`` for ``spread`` of those in large groups, if any."""
    names = [f"_k{i}" for i in range(len(keys))]
    sizes = df.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("_n"))
    groups = sizes.groupBy(*(names[:-1] or names)).agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_folders"))
    large = (F.col("_rows") > ROWS_AT_ONCE) | (F.col("_folders") > 4 * FOLDERS_AT_ONCE)
    total = groups.agg(F.sum("_folders"), F.count_if(large)).first()
    if not total[1]:
        return total[0] or 0, None
    wide = groups.where(large).select(*[F.col(n).alias(f"{n}_") for n in (names[:-1] or names)])
    within = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in (names[:-1] or names)]
    parts = F.ceil(F.col("_n") / ROWS_AT_ONCE)
    return total[0], sizes.join(wide, within, "left_semi").select(*names, F.lit(True).alias("_apart"), parts.alias("_shares"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             by_header: bool = True) -> DataFrame:
    """Read collected CSV with an explicit schema; ``by_header`` checks the header names
    against the schema instead of trusting column positions."""
    r = spark.read.schema(schema).options(**CSV_OPTIONS)
    if by_header:
        r = r.option("enforceSchema", "false")
    return r.csv(path)


def read_datasets(spark: SparkSession, path: str, schema: StructType | str, partition_cols: Sequence[str]) -> DataFrame:
    """All that ``write_datasets`` wrote under ``path``, as ``read_csv`` gives it: the keys (in ``schema`` too) come last.

    For very many datasets: Spark's own reading of keys from folders takes time with the square of
    the number of folders, on the driver. Here they are read from each row's file name, and the folders above the
    last key are listed in one job. A filter on a key does not leave files out.
    """
    fields = spark.createDataFrame([], schema).schema
    r = (spark.read.schema(StructType([f for f in fields if f.name not in partition_cols])).options(**CSV_OPTIONS)
         .option("enforceSchema", "false").option("recursiveFileLookup", "true"))
    above = manifest.folders(spark, path, "/".join(f"{c}=*" for c in partition_cols[:-1])) if partition_cols[1:] else []
    with manifest.few_listing_tasks(spark):
        rows = r.csv(manifest.as_globs(above) or path)
    keys = [manifest.key_of(F.col("_metadata.file_path"), c).cast(fields[c].dataType).alias(c) for c in partition_cols]
    return rows.select("*", *keys)


def write_datasets(df: DataFrame, path: str, partition_cols: Sequence[str]) -> None:
    """S-5: header plus rows, one directory per dataset key, overwriting that key only.

    The tasks are sized by folders as well as rows (``spread``), since many small datasets take
    their time by the file. A dataset is one file, unless it holds more than ROWS_AT_ONCE rows:
    several tasks share it then. ``df`` is read twice, so store rows first that are costly to work out.
    On a file system of the machines the files are made by plain file calls (``localfiles``).
    """
    folders, shares = dataset_shares(df, partition_cols)
    out = spread(df, partition_cols, folders, shares)
    local = localfiles.local_path(df.sparkSession, path)
    if local:
        localfiles.write_csv(out, local, partition_cols, CSV_OPTIONS)
        return
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**CSV_OPTIONS)
     .partitionBy(*partition_cols).csv(path))


def ddo_codes(spark: SparkSession, path: str) -> DataFrame:
    """S-3: DDO snapshot CSVs read by header name, with their partition values."""
    schema = "treasury_code string, snapshot_date date, `DDO Code` string, `DDO Name` string"
    return read_csv(spark, path, schema)


def latest_snapshot(df: DataFrame, key: str = "treasury_code", ts: str | None = None,
                    snapshot: str = "folder") -> DataFrame:
    """S-4: per key, only the rows of its newest snapshot.

    With ``ts`` (a column such as the snapshot day) the newest value per key wins.
    Without it, the file modification time decides, and a snapshot is a folder, as
    ``write_snapshot`` makes it (any number of part files), or, with ``snapshot="file"``,
    one file. The newest time per key is a small partial aggregate; rows are then kept by a
    semi join, so a key that holds a third of the rows is never gathered into one task (as a
    window over the key would). A key without any snapshot simply has no rows.
    """
    if ts is not None:
        newest = df.groupBy(key).agg(F.max(ts).alias(ts))
        return df.join(newest, [key, ts], "left_semi")
    path = F.col("_metadata.file_path")
    snap = path if snapshot == "file" else F.regexp_replace(path, "/[^/]*$", "")
    tagged = df.withColumn("_snapshot", snap).withColumn(
        "_mtime", F.col("_metadata.file_modification_time"))
    newest = tagged.groupBy(key).agg(F.max(F.struct("_mtime", "_snapshot"))["_snapshot"].alias("_snapshot"))
    return tagged.join(newest, [key, "_snapshot"], "left_semi").drop("_snapshot", "_mtime")


def write_snapshot(df: DataFrame, path: str) -> None:
    """S-6: (DDO Code, DDO Name) per treasury and day, header included. Rows without a
    snapshot_date column are a snapshot of the day of the run (E-16)."""
    if "snapshot_date" not in df.columns:
        df = df.withColumn("snapshot_date", today_text())
    _writer(df.select("treasury_code", "snapshot_date", *[F.col(f"`{c}`") for c in DDO_HEADER]),
            ("treasury_code", "snapshot_date")).csv(path)


def write_receipts(kinds: Sequence[DataFrame], path: str, day_col: str = "day") -> None:
    """S-7: receipt rows of both head kinds for a day in one partition, fixed header.

    ``kinds`` are DataFrames with ``head, date, total`` and the day key; they are
    unioned and written once, so no shared file handle is needed.
    """
    rows = kinds[0]
    for k in kinds[1:]:
        rows = rows.unionByName(k)
    out = rows.select(F.col(day_col), *[F.col(src).alias(dst) for src, dst in
                                          zip(("head", "date", "total"), RECEIPTS_HEADER)])
    _writer(out, (day_col,)).csv(path)


def read_receipts(spark: SparkSession, path: str, day_col: str = "day") -> DataFrame:
    schema = (f"{day_col} string, `{RECEIPTS_HEADER[0]}` string, `{RECEIPTS_HEADER[1]}` string, "
              f"`{RECEIPTS_HEADER[2]}` string")
    return read_csv(spark, path, schema)


def export_heads(df: DataFrame, path: str) -> None:
    """S-8: the distinct head combinations (H-11) to CSV, no index column."""
    _writer(df, ()).csv(path)


def write_collected(df: DataFrame, root: str, path_col: str = "path") -> None:
    """S-5 under the P-4 paths: one folder ``dataset=<path>`` for each collected dataset, noted
    in the manifest of ``root`` with its data rows."""
    out = df.withColumnRenamed(path_col, "dataset") if path_col != "dataset" else df
    write_datasets(out, root, ("dataset",))
    note_collected(df.sparkSession, root)


def note_collected(spark: SparkSession, root: str) -> None:
    """Note in the manifest of ``root`` what changed among its files since the last time.

    Only new and changed files are read, and of those one column, so that rows with line breaks
    count once. A header-only or empty file has 0 rows.
    """
    def rows_of(paths: list[str]) -> DataFrame:
        rows = spark.read.schema("c string").options(**CSV_OPTIONS).option("multiLine", "true").csv(paths)
        return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))

    manifest.refresh(spark, root, rows_of)


def collected_datasets(spark: SparkSession, root: str) -> DataFrame:
    """(path, n_rows): the datasets under ``root`` by their P-4 path, with their data rows.

    A dataset is a folder ``dataset=<path>`` of part files (``write_collected``) or one file
    ``<kind>/<name>``. The rows come from the manifest: files are listed, and read only if they
    came there by another way than ``write_collected`` since the last call. A header-only or an
    empty file counts 0 rows; a removed one is not listed.
    """
    note_collected(spark, root)
    return (manifest.entries(spark, root).where("not removed").groupBy(F.col("dataset").alias("path"))
            .agg(F.sum("n_rows").alias("n_rows")))


def read_database_table(spark: SparkSession, url: str, table: str, partition_column: str,
                        lower_bound, upper_bound, num_partitions: int,
                        properties: dict | None = None) -> DataFrame:
    """S-1 for tables kept in a database (as the reference keeps them): a JDBC read split
    into ``num_partitions`` range queries on ``partition_column`` (numeric, date or
    timestamp), so the executors read in parallel instead of one connection pulling the
    whole table. Bounds only set the stride; rows outside them are still read.
    """
    if num_partitions < 1:
        raise ValueError("num_partitions must be at least 1")
    opts = {"url": url, "dbtable": table, "partitionColumn": partition_column,
            "lowerBound": str(lower_bound), "upperBound": str(upper_bound),
            "numPartitions": str(num_partitions)}
    opts.update({k: str(v) for k, v in (properties or {}).items()})
    return spark.read.format("jdbc").options(**opts).load()


def write_fact_table(df: DataFrame, path: str, date_col: str) -> None:
    """Store a fact table as parquet partitioned by ``month_key`` of its date column, so a
    date range prunes the scan to its months (see ``filters.date_range``). Rebalanced on
    the month: AQE splits a month that holds a large share of the rows."""
    from pursewise.operators.filters import MONTH_KEY, month_key

    out = df.withColumn(MONTH_KEY, month_key(F.col(date_col))).hint("rebalance", MONTH_KEY)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH_KEY).parquet(path)
