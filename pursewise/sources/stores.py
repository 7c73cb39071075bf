"""Stored layouts for repeated queries: facts clustered by their heads (F-2, F-4) and the
procurement tables bucketed by ``ocid`` (J-1).

Both are written once and read by many queries. A clustered table lets an IN filter on any of its
head columns skip row groups; a bucketed pair is joined without an exchange.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pursewise.operators.filters import CLASS_COLUMN
from pursewise.operators.joins import AWARD_COLUMNS, awards_with_tenders
from pursewise.session import scratch

CODE_BYTES = 6  # bytes of a value that rank it, behind the prefix common to all values
SLICE = "_slice"
SLICES_PER_SHARE = 4  # slices a hot key gets for each bucket's share of rows; more slices lie more evenly


def _code(c: str, prefix: int) -> Column:
    """The value's bytes behind ``prefix`` as a number in the order of the values (null: null)."""
    raw = F.col(f"`{c}`").cast("string").cast("binary").substr(prefix + 1, CODE_BYTES)
    return F.conv(F.hex(F.rpad(raw, CODE_BYTES, F.lit(b"\x00"))), 16, 10).cast("long")


def _common_bytes(a: str | None, b: str | None) -> int:
    x, y = (a or "").encode(), (b or "").encode()
    same = 0
    while same < min(len(x), len(y)) and x[same] == y[same]:
        same += 1
    return same


def cluster_bounds(df: DataFrame, columns: Sequence[str], bits: int = 4) -> dict[str, tuple[int, list[int]]]:
    """Per column (bytes of the common prefix, at most ``2 ** bits - 1`` bounds): equal shares of the rows.

    Two partial aggregates over the columns. What reaches the driver is one row of a
    fixed size. A value that many rows share is one bound only, so a column with few
    values is cut between them.
    """
    names = [F.col(f"`{c}`").cast("string") for c in columns]
    ends = df.agg(*[f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    # all values lie between the least and the greatest, so they share what those two share
    prefix = [_common_bytes(ends[f"lo{i}"], ends[f"hi{i}"]) for i in range(len(columns))]
    shares = [k / 2 ** bits for k in range(1, 2 ** bits)]
    cuts = df.agg(*[F.percentile_approx(_code(c, p), shares).alias(f"c{i}") for i, (c, p) in enumerate(zip(columns, prefix))]).first()
    return {c: (p, sorted(set(cuts[f"c{i}"] or []))) for i, (c, p) in enumerate(zip(columns, prefix))}


def cluster_key(bounds: dict[str, tuple[int, list[int]]], bits: int = 4) -> Column:
    """The interleaved bits of the columns' ranks, highest bits first (a Z order) as a long."""
    ranks = []
    for c, (prefix, cuts) in bounds.items():
        above = [F.when(_code(c, prefix) >= cut, 1).otherwise(0) for cut in cuts]
        ranks.append(sum(above, F.lit(0)).cast("long"))
    key = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for r in ranks:
            key = F.shiftleft(key, 1) + F.shiftright(r, b).bitwiseAND(F.lit(1))
    return key


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], bits: int = 4, files: int | None = None) -> None:
    """Store a fact table clustered by several head columns at once, with Parquet bloom filters
    on them.

    Rows are range-partitioned and sorted by the interleaved ranks of the columns and, within
    equal ranks, by a hash of the row, so the rows of a hot head fill many files. Every file and row group holds a
    narrow range of each column: an IN filter on any of them skips the others by their least and greatest
    values, dictionaries and bloom filters. ``files`` fixes the number of range partitions;
    without it AQE sizes them. The rows are read four times (ends, bounds, ranges, layout), so
    they are stored plainly first, and what ``df`` is made of is worked out once.
    """
    if not columns or len(columns) * bits > 62:
        raise ValueError("one to 62 / bits columns can be interleaved")
    plain = scratch(df.sparkSession, "unclustered")
    df.write.parquet(plain)
    df = df.sparkSession.read.schema(df.schema).parquet(plain)
    z = cluster_key(cluster_bounds(df, columns, bits), bits)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), z.alias("z"),
                     F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))
    dealt = rows.repartitionByRange(files, "z", "h") if files else rows.repartitionByRange("z", "h")
    w = dealt.sortWithinPartitions("z", "h").select("row.*").write.mode("overwrite")
    for c in columns:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)


def rows_scanned(df: DataFrame) -> int:
    """The rows the file scans of ``df`` handed on when it last ran, from the scans' own metric: what is
    left after skipped row groups. Run the DataFrame (``collect``) first."""
    def walk(node) -> int:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        metric = node.metrics().get("numOutputRows")
        own = metric.get().value() if name.endswith("FileSourceScanExec") and metric.isDefined() else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def hot_slices(awards: DataFrame, key: str, buckets: int) -> DataFrame:
    """(key, slices): the keys that hold more than a bucket's share of the rows, and over how many slices
    they go. Their shares sum to at most one, so there are fewer of them than buckets."""
    counts = awards.groupBy(F.col(f"`{key}`").alias("hot_key")).agg(F.count(F.lit(1)).alias("n"))
    total = awards.agg(F.count(F.lit(1)).alias("total"))
    return (counts.join(F.broadcast(total), F.col("n") * buckets > F.col("total"))
            .select("hot_key", F.ceil(F.col("n") * (buckets * SLICES_PER_SHARE) / F.col("total")).cast("int").alias("slices")))


def store_awards_and_tenders(awards: DataFrame, tenders: DataFrame, root: str, buckets: int,
                             key: str = "ocid") -> tuple[str, str]:
    """Store both tables under ``root``, bucketed alike by (key, slice); returns their table names.

    A slice is 0 but for keys that hold more than a bucket's share of the awards (or of the
    tenders' missing keys, which join nothing). Such a key's awards are dealt over slices by a hash of the row, and its
    tenders are stored once in each slice. So no bucket holds a hot key whole, and every pair of an
    award and a tender still meets in exactly one bucket. One file is written per bucket.
    """
    spark = awards.sparkSession
    folder = f"{root.rstrip('/')}/hot-keys"
    hot_slices(awards, key, buckets).write.mode("overwrite").parquet(folder)  # counted once, read by both sides
    hot = F.broadcast(spark.read.parquet(folder))

    def with_slices(df: DataFrame) -> DataFrame:
        return df.join(hot, F.col(f"`{key}`").eqNullSafe(F.col("hot_key")), "left").withColumn(
            "slices", F.coalesce("slices", F.lit(1))).drop("hot_key")

    row = F.xxhash64(*[F.col(f"`{c}`") for c in awards.columns])
    sides = {"awards": with_slices(awards).withColumn(SLICE, F.pmod(row, "slices").cast("int")),
             "tenders": with_slices(tenders).withColumn(SLICE, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))}
    names = []
    for what, df in sides.items():
        name = f"pursewise_{what}_{uuid.uuid4().hex}"
        (df.drop("slices").repartition(buckets, F.col(f"`{key}`"), F.col(SLICE)).write.bucketBy(buckets, key, SLICE)
         .sortBy(key, SLICE).option("path", f"{root.rstrip('/')}/{what}").saveAsTable(name))
        names.append(name)
    return names[0], names[1]


def stored_awards_with_tenders(spark: SparkSession, awards_table: str, tenders_table: str,
                               award_columns: Sequence[str] = AWARD_COLUMNS, key: str = "ocid",
                               class_col: str = CLASS_COLUMN) -> DataFrame:
    """J-1 on the bucketed tables: buckets are merged pairwise where they lie, nothing is shuffled."""
    return awards_with_tenders(spark.table(awards_table), spark.table(tenders_table).hint("merge"), award_columns,
                               (key, SLICE), class_col)
