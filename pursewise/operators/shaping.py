"""Shaping results (S-2, R-1, R-4 .. R-7).

Results stay rows. Nested forms are built per key on the executors and only where the
group is bounded by the request or a small dimension (slots of a range, demands of a
year); a whole table is never folded into one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pursewise.functions.text import json_value
from pursewise.operators.filters import CLASS_COLUMN, classified
from pursewise.session import scratch


def expenditure_summary(summary: DataFrame) -> DataFrame:
    """S-2: demand, description, previous and current sanction, percent change.

    The stored percent change has no formula in the reference; it is
    ``(current - previous) / previous * 100``, null when previous is 0.
    """
    prev = F.col("sanction_previous").cast("double")
    cur = F.col("sanction_current").cast("double")
    return summary.select(
        F.col("demand"), F.col("demand_description"),
        prev.alias("sanction_previous"), cur.alias("sanction_current"),
        F.when(prev == 0, F.lit(None).cast("double"))
        .otherwise((cur - prev) / prev * F.lit(100.0)).alias("pct_change"),
    )


def by_key_series(series_df: DataFrame, measures: Sequence[str], label: str,
                  key: str = "district") -> DataFrame:
    """R-1: one row per key, ``[(pos, label, sums)]`` in slot order.

    Each array holds one entry per requested slot, so its size is set by the request.
    """
    entry = F.struct(F.col("pos"), F.col(label).alias("label"),
                     F.array(*[F.col(m) for m in measures]).alias("sums"))
    return series_df.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("series"))


def allocation_by_year_flat(summary: DataFrame, values: Sequence[str] = ("sanction", "addition")
                            ) -> DataFrame:
    """R-4, flat: (financial_year, ``demand-description``, values...)."""
    return summary.select(
        "financial_year",
        F.concat_ws("-", "demand", "demand_description").alias("demand_label"),
        *[F.col(v).cast("double").alias(v) for v in values],
    )


def allocation_by_year(summary: DataFrame, values: Sequence[str] = ("sanction", "addition")
                       ) -> DataFrame:
    """R-4, nested: ``{financial_year: {demand-desc: [values]}}`` as one row per year.

    A repeated (year, demand) raises (map key dedup policy EXCEPTION) instead of letting
    row order pick the survivor.
    """
    flat = allocation_by_year_flat(summary, values)
    return flat.groupBy("financial_year").agg(
        F.map_from_entries(F.collect_list(F.struct(
            F.col("demand_label"), F.array(*[F.col(v) for v in values])))).alias("demands")
    )


def covid_rows(covid: DataFrame) -> DataFrame:
    """R-5: the table's five published columns, money as double at the edge."""
    return covid.select(
        "department", F.col("funds_sanctioned").cast("double").alias("funds_sanctioned"),
        "funds_sanctioned_from", "date", "purpose",
    )


# The columns the tender table publishes, in order.
TENDER_COLUMNS = (
    "ocid", "id", "date", "tender/id", "tag", "tender/participationFees/0/value/currency",
    "tender/participationFees/0/value/amount", "tender/participationFees/0/paymentAddress/locality",
    "tender/datePublished", "tender/awardPeriod/startDate", "tender/documentAvailabilityPeriod/startDate",
    "tender/documentAvailabilityPeriod/endDate", "tender/enquiryPeriod/startDate", "tender/enquiryPeriod/endDate",
    "tender/tenderPeriod/startDate", "tender/tenderPeriod/endDate", "tender/title", "tender/description",
    "tender/value/currency", "tender/value/amount", "tender/items/id", "tender/items/description", "initiationType",
    "tender/process", "tender/tenderPeriod/durationInDays", "tender/contractPeriod/durationInDays",
    "parties/0/address/locality", "tender/bidOpening/address/streetAddress", "tender/allowPreferentialBidder",
    "tender/participationFees/1/value/currency", "tender/participationFees/1/value/amount",
    "tender/participationFees/1/exemptionAllowed", "tender/participationFees/1/description",
    "tender/participationFees/0/payee/name", "buyer/id", "buyer/name", "tender/externalReference",
    "tender/procurementMethod", "tender/contractType", "tender/mainProcurementCategory",
    "tender/evaluation/generalTechnicalEvaluationAllowed", "tender/evaluation/itemWiseTechnicalEvaluationAllowed",
    "tender/participationFee/0/multiCurrencyAllowed", "tender/allowTwoStageBid", "tender/procuringEntity/id",
    "tender/procuringEntity/name", "parties/0/id", "parties/0/roles", "parties/0/contactPoint/name",
    "parties/0/address/streetAddress", "parties/0/address/postalCode", "tender/participationFees/0/description",
    "tender/participationFees/0/methodOfPayment", "award/date", "tender/numberOfTenderers",
    "tender/classification/scheme", "tender/classification/id", "tender/classification/description",
)


def tender_rows(tenders: DataFrame, drop: Sequence[str] = ("uuid",), class_col: str = CLASS_COLUMN) -> DataFrame:
    """R-6: classified tenders, every column but the surrogate id; decimals as double."""
    t = classified(tenders, class_col)
    cols = []
    for f in t.schema.fields:
        if f.name in drop:
            continue
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "decimal":
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return t.select(*cols)


def result_json(df: DataFrame) -> DataFrame:
    """R-7: one JSON record per row (``value``); write it out, do not collect it."""
    # null fields are written as null, as json.dumps does (Spark drops them by default)
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                               {"ignoreNullFields": "false"}).alias("value"))


def _numbered(df: DataFrame, key: str, cells: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, total): every row as ``(pos, cells)`` with its place in the document, and one row
    with the count ``n``.

    The key orders the document (nulls first); rows with equal keys are ordered by the digest
    of their cell texts, and equal rows are interchangeable. Rows are dealt to range partitions
    by (key, digest, copy), three narrow values, so a hot key and a row repeated very often
    are split as well. They are sorted there and stored once with their place in
    the partition. A row's number is that place plus the rows of all partitions before it: a running sum
    over one row per partition. The places are read back from the stored table and never
    computed twice, so a task that runs again cannot see other range borders.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").alias("k"), cells.alias("cells")).groupBy("k", "cells").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("k", F.md5(F.concat_ws(",", "cells")).alias("digest"),
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"), "cells")
    order = ("k", "digest", "copy")
    path = scratch(spark, "numbered")
    # an id of Spark's: partition number in the upper 31 bits, place in the partition below
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
     .select(F.monotonically_increasing_id().alias("at"), "cells").write.parquet(path))
    at = spark.read.schema("at long, cells array<string>").parquet(path).withColumn("part", F.shiftright("at", 33))
    parts = at.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per range partition: a fixed size, whatever the table holds
    placed = at.join(F.broadcast(starts), "part").select((F.col("start") + place).alias("pos"), "cells")
    return placed, parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _comma(text: Column) -> Column:
    """The text with a comma in front of it, but for the first row."""
    return F.when(F.col("pos") == 0, text).otherwise(F.concat(F.lit(","), text))


def columnar_json_fragments(df: DataFrame, columns: Sequence[str], key: str,
                            names: Sequence[str] | None = None) -> DataFrame:
    """R-5 / R-6 document ``{"records": {name: [values in key order], ...}, "count": n}``
    as ordered fragments ``(s1, s2, s3, pos, fragment)``; concatenated in the order
    (s1, s2, s3, pos) they are the document.

    Each row gives one fragment per column, which carries the row's number and nothing else
    of the row; no column is gathered into one task. Keys may repeat or be null (see ``_numbered``,
    which stores the numbered rows when this is called).
    """
    names = list(names or columns)
    rows, total = _numbered(df, key, F.array(*[json_value(F.col(f"`{c}`")) for c in columns]))
    fixed = [(0, 0, 0, F.lit('{"records":{'))]
    for i, name in enumerate(names):
        fixed.append((1, i, 0, F.concat(F.lit("," if i else ""), json_value(F.lit(name)), F.lit(":["))))
        fixed.append((1, i, 2, F.lit("]")))
    fixed.append((2, 0, 0, F.concat(F.lit('},"count":'), F.col("n").cast("string"), F.lit("}"))))
    frame = total.select(F.inline(F.array(*[F.struct(F.lit(s1).alias("s1"), F.lit(s2).alias("s2"), F.lit(s3).alias("s3"),
                                                     text.alias("fragment")) for s1, s2, s3, text in fixed])))
    values = rows.select("pos", F.posexplode("cells").alias("s2", "cell")).select(
        F.lit(1).alias("s1"), "s2", F.lit(1).alias("s3"), "pos", _comma(F.col("cell")).alias("fragment"))
    return values.unionByName(frame, allowMissingColumns=True)


def write_columnar_json(df: DataFrame, path: str, columns: Sequence[str], key: str,
                        names: Sequence[str] | None = None) -> None:
    """Write the columnar document as ordered text part files (a range-partitioned sort);
    read in part order they concatenate to the JSON."""
    frags = columnar_json_fragments(df, columns, key, names)
    frags.orderBy("s1", "s2", "s3", "pos").select("fragment").write.mode("overwrite").text(path)


def records_json_fragments(df: DataFrame, key: str) -> DataFrame:
    """R-7 document ``{"records": [row, ...], "count": n}`` as ordered fragments
    ``(s1, pos, fragment)``: one per row plus the opening and the count, in the order
    (s1, pos). Written like the columnar document; nothing is gathered."""
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    rows, total = _numbered(df, key, F.array(record))
    close = F.concat(F.lit('],"count":'), F.col("n").cast("string"), F.lit("}"))
    frame = total.select(F.inline(F.array(F.struct(F.lit(0).alias("s1"), F.lit('{"records":[').alias("fragment")),
                                          F.struct(F.lit(2).alias("s1"), close.alias("fragment")))))
    values = rows.select(F.lit(1).alias("s1"), "pos", _comma(F.col("cells")[0]).alias("fragment"))
    return values.unionByName(frame, allowMissingColumns=True)
