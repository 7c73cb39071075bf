"""Account heads: distinct combinations, trees, unique values (H-1 .. H-12, S-9).

All unique-value queries are one pass over the table: the head columns are unpivoted
into ``(head, value)`` with one generator and de-duplicated together, instead of one
scan per column. Trees are the label rows of ``tree.tree_nodes``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursewise.operators.filters import apply_filters
from pursewise.operators.tree import pair_label, tree_nodes

# Head columns and tree levels of each table, in the reference's order.
ALLOCATION_HEADS = ("demand", "major", "sub_major", "minor", "sub_minor", "budget",
                    "voted_charged", "plan_nonplan", "soe")

ALLOCATION_DESC_LEVELS = (("demand", "demand_desc"), ("major", "major_desc"),
                          ("sub_major", "sub_major_desc"), ("minor", "minor_desc"),
                          ("sub_minor", "sub_minor_desc"), "budget", "voted_charged",
                          "plan_nonplan", ("soe", "soe_description"))
RECEIPT_LEVELS = (("major", "major_desc"), "sub_major", "minor", ("sub_minor", "sub_minor_desc"))
SPENDING_LEVELS = ("district", ("treasury_code", "treasury"), ("ddo_code", "ddo_desc"),
                   ("demand", "demand_desc"), ("major", "major_desc"),
                   ("sub_major", "sub_major_desc"), ("minor", "minor_desc"),
                   ("sub_minor", "sub_minor_desc"), "budget", "voted_charged", "plan_nonplan",
                   ("soe", "soe_description"))
TREASURY_RECEIPT_LEVELS = ("district", ("treasury_code", "treasury"), ("ddo_code", "ddo_desc"),
                           ("major_code", "major_desc"), "sub_major_code", "minor_code",
                           ("sub_minor_code", "sub_minor_desc"))
SCHEME_LEVELS = ("schemes", "type", *SPENDING_LEVELS)

TREASURY_RECEIPT_UNIQUE = (("treasury_code", "treasury"), ("ddo_code", "ddo_desc"),
                           ("major_code", "major_desc"), ("sub_minor_code", "sub_minor_desc"),
                           "district", "sub_major_code", "minor_code")
SCHEME_UNIQUE = (("treasury_code", "treasury"), ("ddo_code", "ddo_desc"),
                 ("demand", "demand_desc"), ("major", "major_desc"),
                 ("sub_major", "sub_major_desc"), ("minor", "minor_desc"),
                 ("sub_minor", "sub_minor_desc"), ("soe", "soe_description"),
                 "schemes", "type", "district", "budget", "voted_charged", "plan_nonplan")
DIMENSION_HEADS = ("treasury_code", "ddo_code", "demand", "major", "sub_major", "minor",
                   "sub_minor", "soe", "district", "budget", "voted_charged", "plan_nonplan")
COMBINATION_COLUMNS = ("district", "treasury_code", "treasury", "ddo_code", "ddo_desc",
                       "demand", "demand_desc", "major", "major_desc", "sub_major",
                       "sub_major_desc", "minor", "minor_desc", "sub_minor", "sub_minor_desc",
                       "budget", "voted_charged", "plan_nonplan", "soe", "soe_description")


def level_name(level) -> str:
    return level if isinstance(level, str) else level[0]


def level_column(level) -> Column:
    """A single column, or R-2's ``code-desc`` for a pair."""
    if isinstance(level, str):
        return F.col(level)
    return pair_label(*level)


def head_columns(df: DataFrame, until: str = "soe", start: int = 0) -> list[str]:
    """S-9: column names from ``start`` up to and including ``until``, by name."""
    names = df.columns
    lowered = [n.lower() for n in names]
    return names[start:lowered.index(until.lower()) + 1]


def heads_flat(df: DataFrame, heads: Sequence[str] = ALLOCATION_HEADS) -> DataFrame:
    """H-1: distinct head combinations (GROUP BY without aggregates)."""
    return df.select(*heads).distinct()


def label_rows(df: DataFrame, levels: Sequence, filters: Mapping | None = None) -> DataFrame:
    """Filtered (F-4) rows of level labels, one column per level."""
    df = apply_filters(df, filters)
    return df.select(*[level_column(lv).alias(f"l{i + 1:02d}") for i, lv in enumerate(levels)])


def heads_tree(df: DataFrame, levels: Sequence, filters: Mapping | None = None) -> DataFrame:
    """H-2 .. H-7: the head tree as its distinct nodes ``(level, node_id, parent_id, label)``;
    ``tree.node_paths`` gives the text of the paths.

    ``tree_nodes`` de-duplicates the label rows first (the GROUP BY of the reference): real
    spending has many transactions per head combination, and the map-side partial
    aggregate shrinks them before any id is worked out.
    """
    return tree_nodes(label_rows(df, levels, filters))


def unique_heads(df: DataFrame, heads: Sequence) -> DataFrame:
    """H-8 .. H-10: distinct ``(head, value)`` for every head in one pass.

    A head is a column name or a ``(code, desc)`` pair, labelled ``code-desc`` and keyed
    by the code column's name.
    """
    pairs = F.array(*[F.struct(F.lit(level_name(h)).alias("head"),
                               level_column(h).cast("string").alias("value")) for h in heads])
    return df.select(F.inline(pairs)).distinct()


def head_combinations(df: DataFrame, cols: Sequence[str] = COMBINATION_COLUMNS,
                      keep_columns: bool = False) -> DataFrame:
    """H-11: distinct ``concat_ws('+', ...)`` of the head columns (nulls skipped, which
    shifts the parts). With ``keep_columns`` the separate columns stay beside it, so a
    combination whose parts shifted can still be read back; the columns decide it, so they are
    de-duplicated alone and it is put together afterwards."""
    combo = F.concat_ws("+", *[F.col(c) for c in cols]).alias("combination")
    if keep_columns:
        return df.select(*cols).distinct().select(combo, *cols)
    return df.select(combo).distinct()


def build_dimensions(df: DataFrame, path: str, heads: Sequence[str] = DIMENSION_HEADS) -> None:
    """H-12: write the unique values of every head once, partitioned by head.

    Rebalanced on the head, not repartitioned: a head with very many values (DDO codes)
    is split by AQE over several tasks and files instead of landing in one task.
    """
    (unique_heads(df, heads).hint("rebalance", "head")
     .write.mode("overwrite").partitionBy("head").parquet(path))


def load_dimensions(df: DataFrame, path: str, heads: Sequence[str] = DIMENSION_HEADS) -> None:
    """H-12, incremental: append the values of ``df`` that are not stored yet, head by head.

    One pass over the new rows, then an anti-join of their distinct values with the stored
    ones; stored values are read (two columns) and never written again. A load that failed can
    be repeated: what it stored is found. Loads of one path run one after the other. The
    first load is ``build_dimensions``.
    """
    known = df.sparkSession.read.schema("value string, head string").parquet(path)
    found = unique_heads(df, heads)
    unseen = found.join(known, (found["head"] == known["head"]) & found["value"].eqNullSafe(known["value"]), "left_anti")
    unseen.hint("rebalance", "head").write.mode("append").partitionBy("head").parquet(path)


def read_dimensions(spark, path: str, heads: Sequence[str] | None = None) -> DataFrame:
    """H-12: read the stored values; a head filter prunes partitions (directories)."""
    df = spark.read.parquet(path)
    if heads:
        df = df.filter(F.col("head").isin(list(heads)))
    return df.select("head", "value")
