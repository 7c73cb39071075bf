"""Joins (J-1; J-2 is ``facts.fill_slots``; P-1 and P-5 live in ``plans``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursewise.operators.filters import CLASS_COLUMN, classified

# The award-side columns the awards query names (uuid is dropped).
AWARD_COLUMNS = ("ocid", "id", "date", "parties/0/roles", "awards/0/id", "awards/0/suppliers/0/id", "parties/0/id",
                 "parties/0/contactPoint/name", "awards/0/suppliers/0/name", "awards/0/value/currency",
                 "awards/0/value/amount")


def awards_with_tenders(awards: DataFrame, tenders: DataFrame,
                        award_columns: Sequence[str] = AWARD_COLUMNS,
                        key: str | Sequence[str] = "ocid", class_col: str = CLASS_COLUMN) -> DataFrame:
    """J-1: awards LEFT JOIN tenders ON ocid WHERE classification <> ''.

    The predicate on the right side makes the outer join an inner one, so it is written
    as one: one row per (award, classified tender). Only the tender key is carried into
    the join; the strategy (broadcast when the classified tenders are small enough by
    the planner's size check, else a shuffled sort-merge join, split by AQE on a skewed
    ocid) is left to the optimizer.
    """
    keys = [key] if isinstance(key, str) else list(key)
    t = classified(tenders, class_col).select(*[F.col(f"`{k}`").alias(f"_tkey{i}") for i, k in enumerate(keys)])
    joined = awards.join(t, [awards[f"`{k}`"] == t[f"_tkey{i}"] for i, k in enumerate(keys)], "inner")
    return joined.select(*[awards[f"`{c}`"] for c in award_columns])
